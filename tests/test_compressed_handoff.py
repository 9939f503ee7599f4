from __future__ import annotations

import gzip


def test_handoff_rows_are_compressed(spark, tmp_path):
    from korridor.sources import handoff

    df = spark.createDataFrame([("train", 1, 5, 4, 6, 7, 1)], "split string, case_id long, feature_cutoff_s long, value_available_s long, target_s long, target_available_s long, target int")
    handoff.write_handoff(df, str(tmp_path / "a"), "task", [], compression="gzip")
    (file,) = (tmp_path / "a" / "rows" / "split=train").glob("*.txt.gz")
    assert gzip.decompress(file.read_bytes()).decode().startswith('{"case_id":1,') and handoff.read_handoff(spark, str(tmp_path / "a")).count() == 1
