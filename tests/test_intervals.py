"""Binned interval joins and running counts against plain loops, also over a busy key."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from korridor.operators import intervals


def data(seed=1, n=400, m=80):
    r = random.Random(seed)
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *[r.randint(-50_000, 50_000)] * 30])) for i in range(n)]
    right = []
    for i in range(m):
        s = r.randint(-50_000, 50_000)
        right.append((i % 60, r.choice([1, 1, 2, 3, 4, None]), r.randint(0, n), r.choice([s, s, s, None]), s + r.choice([-5, 0, 1, 30, 400, 9_000, 60_000, 900_000]), s + r.choice([0, 0, 200])))
    right += [(90, 1, 3, 10, None, 10), (91, 2, 4, -60_000, None, 0)]
    return left, right


def frames(spark, left, right):
    return spark.createDataFrame(left, "row long, key int, at long").repartition(3), spark.createDataFrame(right, "own int, key int, row_of long, s long, e long, k long").repartition(2)


def holds(s, e, k, at, closed, open_end):
    if at is None or s is None or (e is None and not open_end):
        return False
    low = s if k is None else max(s, k)
    return low <= at and (e is None or (at <= e if closed else at < e))


@pytest.mark.parametrize(("closed", "open_end", "known", "width"), [(True, False, True, 100), (False, True, False, 7), (True, True, True, 50_000), (True, True, True, 1)])
def test_pairs(spark, closed, open_end, known, width):
    left, right = data()
    a, b = frames(spark, left, right)
    got = Counter((x.row, x.own, x.e) for x in intervals.pairs(a, b, [("key", "key")], "at", "s", "e", known="k" if known else None, width=width, closed=closed, open_end=open_end).collect())
    want = Counter((i, o, e) for i, key, at in left for o, other, _, s, e, k in right if key is not None and key == other and holds(s, e, k if known else None, at, closed, open_end))
    assert got == want and want


def test_left_pairs_keep_rows_without_any(spark):
    left, right = data(2)
    a, b = frames(spark, left, right)
    out = intervals.left_pairs(a, b, [("key", "key")], "row", "at", "s", "e", width=500)
    assert out.columns == ["row", "key", "at", "own", "row_of", "s", "e", "k"]
    hit = {i: sum(key is not None and key == o and holds(s, e, None, at, True, False) for _, o, _, s, e, _ in right) for i, key, at in left}
    assert Counter(x.row for x in out.collect()) == Counter({i: max(1, n) for i, n in hit.items()})
    assert intervals.left_pairs(a, b.limit(0), [("key", "key")], "row", "at", "s", "e").count() == len(left)
    assert intervals.left_pairs(a.limit(0), b, [("key", "key")], "row", "at", "s", "e").count() == 0


def test_counts_over_scopes(spark):
    """A context in both scopes, and one given twice, counts once."""
    left, right = data(3)
    right = [*right, *right[:20]]
    a, b = frames(spark, left, right)
    got = {x.row: x.n for x in intervals.active_counts(a, b, "row", [("key", "key"), ("row", "row_of")], "own", "at", "s", "e", known="k", width=1000).collect()}
    want = {i: len({o for o, other, of, s, e, k in right if ((key is not None and key == other) or i == of) and holds(s, e, k, at, True, False)}) for i, key, at in left}
    assert got == want and max(want.values()) > 1


def test_a_busy_key_is_dealt_out(spark):
    """Half of all rows on one key, short and very long intervals: no (key, bin, share) has more than twice the rows of the median one of its key."""
    a = spark.range(40_000).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("key"), (F.col("id") * 7919 % 1_000_000).alias("at"))
    b = spark.range(400).select((F.col("id") % 50).alias("key"), (F.col("id") * 2500).alias("_low"), (F.col("id") * 2500 + F.when(F.col("id") % 100 == 0, 900_000).otherwise(3000)).alias("_high"))
    one, other = intervals.dealt(a, b, "at", 3600)
    sizes = [r["count"] for r in one.filter("key = 0").groupBy("key", "_level", "_bin", "_share").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert other.count() < 400 * 3 + 4 * intervals.SPLIT * (intervals.SPLIT + 1)
    plan = intervals.pairs(a, b.withColumnsRenamed({"_low": "s", "_high": "e"}).withColumn("own", F.lit(1)), [("key", "key")], "at", "s", "e", width=3600)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_earlier_keeps_a_bounded_state(spark):
    """Counts, sums and the last rows of all earlier ones, against a plain loop; a busy key in many stretches."""
    from korridor.operators import asof

    r = random.Random(6)
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.choice([None, r.randint(0, 5000), r.randint(0, 5000)]), r.choice([None, r.randint(0, 5000), r.randint(0, 5000)]), r.choice([None, 0, 4, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key int, asks long, at long, y int").repartition(4)
    got = {x.id: (x.visits, x.sum_y, [(v.at, v.id2) for v in x.latest]) for x in asof.earlier(df.withColumn("id2", F.col("id")), ["key"], "id", "asks", "at", F.col("y") > 0, ["y"], ["id2"], 3, 300).collect()}
    for i, key, asks, _, _ in rows:
        past = [(at, j, y) for j, k, _, at, y in rows if key is not None and k == key and asks is not None and at is not None and at < asks and y]
        assert got[i] == (len(past), float(sum(y for *_, y in past)), [(at, j) for at, j, _ in sorted(past, reverse=True)[:3]])
    assert asof.earlier(df.withColumn("id2", F.col("id")).limit(0), ["key"], "id", "asks", "at", F.col("y") > 0, ["y"], ["id2"], 3).count() == 0
