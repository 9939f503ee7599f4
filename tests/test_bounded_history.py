"""Bounded histories by stretches, without Python."""

from __future__ import annotations

from korridor.operators import asof
from pyspark.sql import functions as F


def test_history_needs_no_python_and_carries_over_stretches(spark):
    df = spark.createDataFrame([(k, "s", 10 * k + 5, 10 * k) for k in range(8)] + [(90, None, 50, 1), (91, "s", None, 2)], "id long, key string, asks long, at long").withColumn("tie", F.col("id"))
    out = asof.earlier(df, ["key"], "id", "asks", "at", F.col("id") < 6, [], ["tie"], 3, 15, 4)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.id: (x.visits, [v.tie for v in x.latest]) for x in out.collect()}
    assert got == {**{k: (min(k + 1, 6), list(range(min(k, 5), -1, -1))[:3]) for k in range(8)}, 90: (0, []), 91: (0, [])}
