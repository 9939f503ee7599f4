"""Versions of shards and reused scans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korridor.sources.store import Scans, Shards, Stale


def test_only_touched_shards_are_written(spark, tmp_path):
    x = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.lit(0).alias("n"))
    s = Shards(spark, str(tmp_path / "t"), ["id"], 40)
    assert s.latest() is None and s.create(x) == 0
    patch = spark.createDataFrame([(5, 1), (5000, 2), (99_999, 3)], "id long, n int")
    assert s.patch(patch) == 1
    assert {r.id: r.n for r in s.read().filter("n > 0").collect()} == {5: 1, 5000: 2} and s.read().count() == 20_000
    assert s.read(0).filter("n > 0").count() == 0  # a reader of the old version sees the old rows
    assert 0 < s.bytes_written(1) < 0.12 * s.bytes_written(0)
    assert s.patch(spark.createDataFrame([(7, 9)], "id long, n int")) == 2 and s.read(1).filter("n = 9").count() == 0 and s.read().filter("n = 1").count() == 1


def test_who_comes_second_changes_nothing(spark, tmp_path):
    s = Shards(spark, str(tmp_path / "t"), ["id"], 4)
    s.create(spark.range(100).select("id", F.lit(0).alias("n")))
    one = spark.createDataFrame([(1, 1)], "id long, n int")
    s.patch(one, of=0)
    with pytest.raises(Stale):
        s.patch(spark.createDataFrame([(1, 2)], "id long, n int"), of=0)
    assert s.latest() == 1 and [r.n for r in s.read().filter("id = 1").collect()] == [1]
    with pytest.raises(Exception):
        s.patch(one.withColumn("n", F.raise_error(F.lit("broken"))))
    assert s.latest() == 1 and s.read().count() == 100
    empty = Shards(spark, str(tmp_path / "e"), ["id"], 4)
    empty.create(spark.range(0).select("id", F.lit(0).alias("n")))
    assert empty.read().count() == 0 and empty.patch(one) == 1 and empty.read().columns == ["id", "n"]


def test_scans_are_built_once_for_a_state_of_the_source(spark, tmp_path):
    source, scans = str(tmp_path / "s"), Scans(spark, str(tmp_path / "store"), 2)
    spark.range(50).write.parquet(source)
    total = lambda df: df.agg(F.sum("id").alias("s"))
    assert [scans.get(source, "total", total).first().s for _ in range(3)] == [1225] * 3 and (scans.built, scans.reused) == (1, 2)
    spark.range(50, 60).write.mode("append").parquet(source)  # a changed source is another table
    assert scans.get(source, "total", total).first().s == 1770 and scans.built == 2
    assert scans.get(source, "count", lambda df: df.agg(F.count("*").alias("n"))).first().n == 60 and scans.built == 3
    assert len(scans.files.names(f"{scans.root}/tables")) == 2  # the oldest has gone
    assert scans.get(source, "total", total).first().s == 1770 and scans.reused == 3
    with pytest.raises(Exception):
        scans.get(source, "bad", lambda df: df.select(F.raise_error(F.lit("broken"))))
    assert len(scans.files.names(f"{scans.root}/tables")) == 2
