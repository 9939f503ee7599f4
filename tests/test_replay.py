"""Streams by event time against the batch operators: any order of arrival, and a restart half-way."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from korridor.operators import asof
from korridor.streaming import replay

pytest.importorskip("google.protobuf")


def rows(seed=4, n=160):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b"]), i, at := r.randint(0, 400), r.choice([None, at, at + r.randint(0, 300)]), r.random()) for i in range(n)]


def ran(spark, frame, stream, tmp_path, order, stops):
    """Runs ``stream`` over batches of ``frame`` in the given order, a run for each of ``stops``; the answers."""
    replay.use_event_time_state(spark)
    source, sink, saved = (str(tmp_path / x) for x in ("in", "out", "saved"))
    written = 0
    for stop in stops:
        for part in order[written:stop]:
            frame.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
        written = stop
        made = stream(spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", saved).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert not query.isActive and query.exception() is None
    return spark.read.parquet(sink)


def instant(column):
    return F.timestamp_seconds(F.col(column) + 1000)  # a row at the epoch itself is as late as the first watermark


@pytest.mark.parametrize(("seed", "stops"), [(1, [6]), (2, [3, 6])])
def test_promotions(spark, tmp_path, seed, stops):
    base = spark.createDataFrame(rows(), "key string, row_id long, at long, available long, y double")
    want = {x.row_id: (x.pending, x.promoted) for x in asof.late_promotion(base, "key", "row_id", "at", "available").collect()}
    last = spark.createDataFrame([("flush", -1, 10_000_000, None, 4), ("flush", -2, 20_000_000, None, 5)], "key string, row_id long, at long, available long, part int")
    frame = base.withColumn("part", (F.hash("row_id", F.lit(seed)) % 4 + 4) % 4).drop("y").unionByName(last)
    frame = frame.select("key", "row_id", instant("at").alias("at"), instant("available").alias("available"), "part")
    order = random.Random(seed).sample(range(4), 4) + [4, 5]
    got = ran(spark, frame, lambda s: replay.promotions_stream(s, "1 hour"), tmp_path, order, stops)
    assert {x.row_id: (x.pending, x.promoted) for x in got.collect() if x.row_id >= 0} == want


def test_values(spark, tmp_path):
    r = random.Random(9)
    base = spark.createDataFrame(rows(), "key string, row_id long, at long, available long, y double")
    asked = base.filter("row_id % 3 = 0")
    want = {x.row_id: x.y for x in asof.value_as_of(base.withColumn("revision", F.col("row_id")), asked, "key", "at", "available", "y", "revision", "row_id").collect()}
    tells = base.filter("available is not null").select("key", "row_id", F.col("available").alias("i"), F.lit(False).alias("asks"), F.col("row_id").alias("revision"), F.col("y").alias("value"))
    asks = asked.select("key", "row_id", F.col("at").alias("i"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("revision"), F.lit(None).cast("double").alias("value"))
    last = spark.createDataFrame([("flush", -1, 10_000_000, True, None, None, 3), ("flush", -2, 20_000_000, True, None, None, 4)], "key string, row_id long, i long, asks boolean, revision long, value double, part int")
    frame = tells.unionByName(asks).withColumn("part", (F.hash("row_id", "asks") % 3 + 3) % 3).unionByName(last).withColumn("instant", instant("i")).drop("i")
    got = ran(spark, frame, lambda s: replay.values_stream(s, "1 hour"), tmp_path, r.sample(range(3), 3) + [3, 4], [2, 5])
    assert {x.row_id: x.value for x in got.collect() if x.row_id >= 0} == want
