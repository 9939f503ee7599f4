from __future__ import annotations

from korridor.sources import files


def test_records_of_one_instant_give_the_one_of_fewest_rows(spark, tmp_path):
    rows = [("r", "s", "SUCCESS", 5, 7), ("r", "s", "SUCCESS", 9, 300), ("r", "s", "SUCCESS", 9, 20), ("r", "s", "STARTED", 11, 1), ("r", "s", "SUCCESS", None, 2)]
    for k, some in enumerate((rows, rows[::-1])):
        path = str(tmp_path / str(k))
        spark.createDataFrame(some, "run_id string, stage string, status string, recorded_s long, rows long").coalesce(1).write.json(path)
        assert [tuple(x) for x in files.last_evidence(spark, path, "r", "s").collect()] == [("r", "s", 9, 20)]
