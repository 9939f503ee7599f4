"""Handoffs, eligibility, comparison and reservations on rows worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korridor.operators import eligibility, metrics, whatif
from korridor.plans import contracts
from korridor.sources import files, handoff

COLUMNS = "split string, case_id string, value_available_s long, feature_cutoff_s long, target_s long, target_available_s long, target int, load double"
GOOD = [("train", "a", 1, 2, 3, 4, 0, 0.5), ("train", "b", 2, 2, 2, 2, 1, 1.5), ("test", "c", 0, 5, 6, 9, 1, 2.5)]


def test_handoff_round_trip_and_what_breaks_it(spark, tmp_path):
    df = spark.createDataFrame(GOOD, COLUMNS).repartition(3)
    manifest = handoff.write_handoff(df, str(tmp_path / "a"), "task", ["load"], {"run": "r"})
    assert {k: v["rows"] for k, v in manifest["partitions"].items()} == {"train": 2, "test": 1}
    back = handoff.read_handoff(spark, str(tmp_path / "a"))
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    again = handoff.write_handoff(df.repartition(1), str(tmp_path / "b"), "task", ["load"], {"run": "r"})
    assert again == manifest  # the digest does not depend on order or files
    broken = {"known": ("train", "d", 3, 2, 3, 4, 0, 0.5), "target": ("train", "d", 1, 2, 1, 4, 0, 0.5), "late": ("train", "d", 1, 2, 3, 1, 0, 0.5), "label": ("train", "d", 1, 2, 3, 4, None, 0.5), "finite": ("train", "d", 1, 2, 3, 4, 0, float("nan")), "missing": ("train", "d", 1, 2, 3, 4, 0, None), "repeat": GOOD[0], "id": ("train", None, 1, 2, 3, 4, 0, 0.5)}
    for name, row in broken.items():
        with pytest.raises(ValueError):
            handoff.write_handoff(spark.createDataFrame([*GOOD, row], COLUMNS), str(tmp_path / name), "task", ["load"])
        assert not (tmp_path / name).exists()
    with pytest.raises(FileExistsError):
        handoff.write_handoff(df, str(tmp_path / "a"), "task", ["load"])
    part = next((tmp_path / "b/rows/split=test").glob("part-*"))
    part.write_text(part.read_text().replace("2.5", "2.6"))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        handoff.read_handoff(spark, str(tmp_path / "b"))


def test_tasks_are_written_as_declared(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "i int, s string")
    with pytest.raises(ValueError):
        handoff.write_tasks({"a": df}, {"a", "b"}, str(tmp_path / "x"), F.col("s"))
    handoff.write_tasks({"a": df, "b": df}, {"a", "b"}, str(tmp_path / "y"), F.col("s"), {"b"})
    assert spark.read.parquet(str(tmp_path / "y/task=a/split=train")).count() == 1 and spark.read.parquet(str(tmp_path / "y/task=b")).count() == 2


def test_each_condition_excludes(spark):
    names = "label string, service_date date, trip_id int, seq int, scheduled_s long, cutoff_s long, known_s long, target_available_s long, hour double, weekday double, month double, direction_id double, distance double"
    from datetime import date

    row = ["LATE", date(2020, 1, 1), 1, 1, 100, 100, 50, 150, 1.0, 1.0, 1.0, 0.0, 2.0]
    changes = {0: "NONE", 4: None, 5: 101, 6: 101, 7: 99, 8: float("nan"), 12: float("inf"), 11: None, 2: None}
    rows = [row] + [[*row[:i], v, *row[i + 1 :]] for i, v in changes.items()] + [[*row[:4], 300, 300, *row[6:7], 300, *row[8:]]]
    df = spark.createDataFrame([tuple(r) for r in rows], names)
    rules = eligibility.delay(("LATE",), 0, 200)
    assert eligibility.eligible(df, rules).count() == 1
    why = {r.reason: r.n for r in eligibility.reasons(df, rules).collect()}
    assert why["label known"] == 1 and why["cutoff at schedule"] == 2 and why["hour finite"] == 1 and why["distance finite"] == 1 and why["direction_id finite"] == 1 and why["begins inside"] == 2 and why["outcome inside"] == 1


def test_comparison_policies(spark):
    one = spark.createDataFrame([(i, i * 10, i % 2, i % 2) for i in range(120)], "case long, at_s long, actual int, prediction int")
    other = one.withColumns({"at_s": F.col("at_s") + 18_000, "prediction": F.when(F.col("case") < 12, 1 - F.col("prediction")).otherwise(F.col("prediction"))})
    strict = metrics.certified_comparison(one, other, "case", "strict").first()
    assert (strict.status, strict.misaligned, strict.matches) == ("NOT_READY", 120, None)
    aligned = metrics.certified_comparison(one, other, "case", "normalised", 18_000).first()
    assert (aligned.status, aligned.shared, aligned.matches, aligned.agreement) == ("READY", 120, 108, 0.9)
    few = metrics.certified_comparison(one.limit(99), one, "case", "strict").first()
    assert few.status == "NOT_READY" and few.agreement is None
    with pytest.raises(ValueError):
        metrics.certified_comparison(one, other, "case", "strict", minimum=99)


def test_crowding_threshold(spark):
    s = spark.sql("SELECT array(named_struct('minute', 30.0D, 'capacity', 30.0D), named_struct('minute', 60.0D, 'capacity', 30.0D)) AS trips, array(named_struct('start', 0.0D, 'end', 60.0D, 'passengers', 90.0D)) AS profile")
    assert [whatif.simulate(s, c).first().overcrowding for c in (1.0, 1.5, 2.0)] == [1.0, 0.5, 0.0]


def test_reservation_discovery_and_hooks(spark, tmp_path):
    files.reserve(spark, str(tmp_path / "out"), "run-1")
    with pytest.raises(Exception, match="exist"):
        files.reserve(spark, str(tmp_path / "out"), "run-2")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/b.csv").write_text("x")
    (tmp_path / "t/a.csv.gz").write_text("x")
    (tmp_path / "t/empty.csv").write_text("")
    assert [f.rsplit("/", 1)[1] for f in files.discover(spark, str(tmp_path), ["t"])["t"]] == ["a.csv.gz", "b.csv"]
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path), ["t", "absent"])
    rows = spark.createDataFrame([(None,)], "service_date date")
    assert not contracts.certified("korridor.plans.contracts:every_trip_dated", rows).first().certified
    for spec in ("korridor.plans.contracts", "korridor.plans.contracts:not a name"):
        with pytest.raises(ValueError):
            contracts.certified(spec, rows)
