"""Operators against expectations worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import asof, intervals, joins, metrics, quality, transit, whatif, windows
from korridor.schemas import TABLES, schema_for
from korridor.sources import files

MINUTE = 60
START = 1_735_689_600  # 2025-01-01


def at(hhmm):
    return None if hhmm is None else START + int(hhmm[:2]) * 3600 + int(hhmm[3:]) * 60


HISTORY = [
    ("a0", "R1", "08:00", 5.0, "07:59", "T0", None, None), ("a1", "R1", "08:05", 10.0, "08:01", "T1", 5, 5), ("a2", "R1", "08:06", 20.0, "08:12", "T2", 10, 7.5), ("a3", "R1", "08:06", 30.0, "08:07", "T3", 10, 7.5),
    ("a4", "R1", "08:13", 40.0, "08:13", "T4", 30, 16.25), ("a5", "R1", "08:14", None, "08:14", "T5", 40, 21), ("a6", "R1", "08:15", 55.0, None, "T6", 40, 21), ("a7", "R1", "08:30", 99.0, "08:30", "T7", 40, 21),
    ("b0", "R2", "08:02", 7.0, "08:02", "U0", None, None), ("b1", "R2", "08:03", 8.0, "08:03", "U1", 7, 7), ("n0", None, "08:02", 11.0, "08:02", "N0", None, None), ("n1", None, "08:04", 12.0, "08:04", "N1", 11, 11), ("z0", "R1", None, 1.0, "08:00", "Z", None, None),
]


@pytest.mark.parametrize("form", [asof.past_only_history, asof.past_only_history_streamed])
def test_past_only_history(spark, form):
    df = spark.createDataFrame([(i, k, at(c), y, at(a), t) for i, k, c, y, a, t, _, _ in HISTORY], "row_id string, route string, cutoff long, y double, available long, trip string").repartition(3)
    got = {r.row_id: (r.lag_1, r.mean_7) for r in form(df, ["route"], "row_id", "cutoff", "cutoff", "available", "y", ["trip"]).collect()}
    assert got == {h[0]: (h[6], h[7]) for h in HISTORY}


@pytest.mark.parametrize("width", [5])
def test_stretches_change_nothing(spark, width):
    import random

    r = random.Random(width)
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.choice([None, *range(30)]), r.choice([None, 1.0, 2.0, float(i)]), r.choice([None, *range(40)])) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, k long, at long, y double, available long").repartition(4)

    def expect(i, k, at):
        seen = sorted(((a, j, y) for j, g, a, y, p in rows if at is not None and g == k and None not in (a, y, p) and a < at and p <= at), reverse=True)[:7]
        return (seen[0][2], round(sum(x[2] for x in seen) / len(seen), 9)) if seen else (None, None)

    want = {i: expect(i, k, at) for i, k, at, _, _ in rows}
    for form in (asof.past_only_history, asof.past_only_history_streamed):
        got = {x.row_id: (x.lag_1, None if x.mean_7 is None else round(x.mean_7, 9)) for x in form(df, ["k"], "row_id", "at", "at", "available", "y", ["row_id"], width=width).collect()}
        assert got == want
    late = {x.row_id: (x.pending, x.promoted) for x in asof.late_promotion(df, "k", "row_id", "at", "available").collect()}
    for i, k, at, _, _ in rows:
        before = [p for _, g, a, _, p in rows if None not in (k, at, a) and g == k and a < at]
        assert late.get(i) == ((sum(p is not None and p > at for p in before), sum(p is not None and p <= at for p in before)) if before else None)
    spans = [(i, i % 40, r.choice([1, 1, 2, None]), s := r.randint(0, 60), s + r.randint(-1, 9)) for i in range(120)]
    got = {x.trip: x.clashes for x in asof.overlap_counts(spark.createDataFrame(spans, "i long, trip long, v long, s long, e long"), "v", "trip", "s", "e", 3, width).collect()}
    clash = lambda a, b: a[2] is not None and a[2] == b[2] and a[1] != b[1] and a[4] > a[3] and b[4] > b[3] and a[3] < b[4] + 3 and b[3] < a[4] + 3
    want = {t: n for t in range(40) if (n := sum(clash(a, b) for a in spans if a[1] == t for b in spans))}
    assert got == want


def test_interval_join_includes_both_ends(spark):
    trips = spark.createDataFrame([("T1", "R1", 480), ("T2", "R1", 540), ("T3", "R9", 570)], "trip string, route string, start int")
    events = spark.createDataFrame([("E1", "R1", 420, 600, 0), ("E2", "R1", 480, 540, 480), ("E3", "R1", 360, 600, 481)], "event string, route string, starts int, ends int, known int")
    got = sorted((r.trip, r.event or "-") for r in intervals.left_pairs(trips, events, [("route", "route")], "trip", "start", "starts", "ends", known="known", width=60).collect())
    assert got == [("T1", "E1"), ("T1", "E2"), ("T2", "E1"), ("T2", "E2"), ("T2", "E3"), ("T3", "-")]


def test_scopes_plan_to_hash_joins(spark):
    left = spark.range(100).select(F.col("id").alias("row"), (F.col("id") % 5).alias("route"), F.col("id").alias("at"))
    right = spark.range(40).select(F.col("id").alias("context"), (F.col("id") % 5).alias("route"), F.col("id").alias("stop"), (F.col("id") - 3).alias("s"), (F.col("id") + 3).alias("e"), (F.col("id") - 3).alias("k"))
    out = intervals.active_counts(left, right, "row", [("route", "route"), ("row", "stop")], "context", "at", "s", "e", known="k", width=10)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r: sum(1 for c in range(40) if c - 3 <= r <= c + 3 and (c % 5 == r % 5 or c == r)) for r in range(100)}
    assert {r.row: r.n for r in out.collect()} == want


def test_severity_bands_and_occupancy(spark):
    d = spark.createDataFrame([(x,) for x in (0, 1, 60, 61, 180, 181, 300, 301)], "d int").select(transit.severity(F.col("d"), (0, 60, 180, 300)).alias("l"))
    assert [r.l for r in d.collect()] == ["ON_TIME", "MINOR_DELAY", "MINOR_DELAY", "MODERATE_DELAY", "MODERATE_DELAY", "MAJOR_DELAY", "MAJOR_DELAY", "SEVERE_DELAY"]
    o = transit.occupancy(spark.createDataFrame([(12, 10), (3, None), (0, 10), (3, 0)], "load int, cap int"), "load", "cap").collect()
    assert [(r.utilization, r.occupancy_status, r.over_capacity) for r in o] == [(1.2, "AVAILABLE", True), (None, "UNAVAILABLE", None), (0.0, "AVAILABLE", False), (None, "UNAVAILABLE", None)]
    b = spark.createDataFrame([(x,) for x in (0.4, 0.4 + 1e-9, 0.8, 1.0, 1.0 + 1e-9)], "u double").select(transit.occupancy_band(F.col("u")).alias("b"))
    assert [r.b for r in b.collect()] == ["Low", "Moderate", "Moderate", "High", "Overcrowded"]
    k = spark.createDataFrame([(1, 2), (None, 2)], "a int, b int").select(transit.known_at("a", "b").alias("k"))
    assert [r.k for r in k.collect()] == [2, None]


def test_windows(spark):
    v = spark.createDataFrame([("T", 1, 10, 0, 0, 100), ("T", 2, 5, 8, 50, 60), ("T", 4, 0, 7, 90, 95)], "trip string, seq int, on int, off int, s int, e int")
    assert [(r.onboard_arrival, r.onboard_departure) for r in windows.onboard(v, ["trip"], "seq", "on", "off").orderBy("seq").collect()] == [(0, 10), (10, 7), (7, 0)]
    assert all(r.has_gap for r in windows.sequence_gap(v, ["trip"], "seq").collect())
    assert [r.seq for r in windows.overlaps(v, ["trip"], "s", "e", ["seq"]).orderBy("seq").collect()] == [2, 4]  # the nested one too
    h = windows.headway(spark.createDataFrame([("a", 0, 0), ("a", 600, 500)], "r string, act int, sch int"), ["r"], "act", "sch", ["act"]).orderBy("act").collect()
    assert [(x.headway_s, x.headway_deviation_s) for x in h] == [(None, None), (600, 100)]
    q = windows.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int"), [], "n", 10, "k").orderBy("k")
    assert [r.quota for r in q.collect()] == [1, 1, 1]  # no group gets more than it has
    quota = lambda rows, seats, least: [r.quota for r in windows.largest_remainder(spark.createDataFrame(rows, "k string, n int"), [], "n", seats, "k", minimum=least).orderBy("k").collect()]
    assert quota([("a", 2), ("b", 3)], 100, 0) == [2, 3] and quota([("a", 10), ("b", 10), ("c", 10)], 10, 0) == [4, 3, 3]
    assert quota([("a", 1), ("b", 99), ("c", 900)], 10, 1) == [1, 2, 7] and quota([("a", 0), ("b", 5)], 3, 1) == [0, 3]
    settled = lambda budget, **groups: {x.k: x.quota for x in windows.rounded_quotas(spark.createDataFrame(list(groups.items()), "k string, n int"), "n", budget, "k").collect()}
    assert settled(10, train=1, validation=1, test=998) == {"train": 1, "validation": 1, "test": 8}
    assert settled(7, a=5, b=5, c=5) == {"a": 3, "b": 2, "c": 2} and settled(9, a=1, b=1) == {"a": 1, "b": 1}
    assert settled(6, a=1, b=1, c=1, d=40, e=41) == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 1}
    assert settled(13, a=10, b=10, c=10, d=10, e=10) == {"a": 3, "b": 3, "c": 3, "d": 2, "e": 2} and settled(2, a=9, b=9, c=9) == {"a": 1, "b": 1, "c": 1}
    i = windows.islands(spark.createDataFrame([("T", s, s in (2, 3, 6)) for s in range(1, 7)], "t string, seq int, f boolean"), ["t"], "seq", F.col("f"))
    assert sorted((r.first_seq, r.last_seq, r.stops_n) for r in i.collect()) == [(2, 3, 2), (6, 6, 1)]


def state(spark, passengers=60.0):
    return spark.createDataFrame([([(30.0, 30.0), (60.0, 30.0)], [(0.0, 60.0, passengers)], 60.0, 30.0)], "trips array<struct<minute:double,capacity:double>>, profile array<struct<start:double,end:double,passengers:double>>, window double, cycle double")


@pytest.mark.parametrize("kind,change,capacity,served,wait", [
    ("baseline", {}, 60, 60, 15), ("increase_frequency", {"trip_count": 4}, 120, 60, 7.5), ("decrease_frequency", {"trip_count": 1}, 30, 30, 45), ("add_vehicle", {}, 120, 60, 7.5), ("change_vehicle_capacity", {"capacity": 60}, 120, 60, 15),
    ("shift_trip_start_time", {"trip": 1, "minutes": -10}, 60, 50, 19), ("remove_low_demand_trip", {"trip": 1}, 30, 30, 45), ("add_new_stop", {"cycle": 15, "passengers": 30}, 30, 30, 50), ("increase_predicted_demand", {"factor": 2}, 60, 60, 30),
])
def test_scenarios(spark, kind, change, capacity, served, wait):
    r = whatif.simulate(whatif.scenario(state(spark), kind, **change)).first()
    assert (r.capacity, r.served) == (capacity, served) and abs(r.wait_minutes - wait) < 1e-9 and abs(r.served + r.unserved - r.demand) < 1e-9


def test_no_demand_and_baseline(spark):
    r = whatif.simulate(state(spark, 0.0)).first()
    assert r.wait_minutes is None and r.coverage is None and r.served == 0
    r = whatif.simulate(state(spark)).first()
    assert (r.coverage, r.occupancy, r.overcrowding) == (1, 1, 0)


def test_priorities_and_rules(spark):
    x = spark.createDataFrame([(0.0, 1.0), (50.0, 1.1), (200.0, 1.5), (500.0, 2.0)], "p double, s double").select(whatif.priority(F.col("p"), F.col("s"), [50, 200, 500], [1.1, 1.5, 2.0]).alias("x"))
    assert [r.x for r in x.collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    policy = {"minimum_samples": 10, "minimum_days": 2, "overload_ratio": 1.0, "late_fraction": 0.3, "bottleneck_delay_s": 100.0, "headway_cv": 1.0, "passenger_impact_bands": [1, 2, 3], "severity_bands": [1, 2, 3]}
    m = spark.createDataFrame([("a", 20, 5.0, 1.2, 1.5, 3, 0.1, 3, 50.0, None), ("b", 5, 5.0, 1.2, 1.5, 3, 0.5, 3, 500.0, 2.0)], "route string, sample_count int, affected_passengers double, mean_occupancy_ratio double, peak_occupancy_ratio double, overload_days int, late_fraction double, late_days int, mean_delay_s double, headway_cv double")
    got = {(r.route, r.rule): r.status for r in whatif.recommend(m, "route", policy).collect()}
    assert got["a", "increase_frequency"] == "TRIGGERED" and got["a", "modify_schedule"] == "NO_ACTION" and got["a", "improve_headways"] == "NOT_READY"
    assert {v for (route, _), v in got.items() if route == "b"} == {"NOT_READY"}


def test_metrics(spark):
    c = metrics.classification(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "a int, p int"), "a", "p", [0, 1]).first()
    assert c.accuracy == 0.75 and abs(c.macro_f1 - (2 / 3 + 0.8) / 2) < 1e-6
    r = metrics.regression(spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 3.0)], "a double, p double"), "a", "p").first()
    assert (r.mae, r.mape, r.r2) == (0.666667, 12.5, 0.75)
    r = metrics.regression(spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, p double"), "a", "p").first()
    assert r.r2 is None


def test_quality(spark):
    df = spark.createDataFrame([(1, "2025-13-99T25:61:00Z", "VALID"), (2, "2025-01-01T00:39:10.000000Z", "VALID"), (3, None, None)], "id int, issued string, quality_status string")
    got = quality.typed_timestamps(df, ["issued"]).orderBy("id").collect()
    assert [(r.issued is None, r.raw_timestamp__issued, r.quality_status) for r in got] == [(True, "2025-13-99T25:61:00Z", "FLAGGED"), (False, "2025-01-01T00:39:10.000000Z", "VALID"), (True, None, None)]
    bad = F.col("quality_status").isNull() | ~F.col("quality_status").isin(*quality.STATUSES)
    assert quality.issues(df, "id", "X", bad, "quality_status").count() == 1
    with pytest.raises(ValueError):
        quality.assert_none(quality.leaks(spark.createDataFrame([(2, 1)], "a int, c int"), "a", "c"), "leak")


def test_joins(spark):
    one, two = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted((r.k, r.join_status) for r in joins.checked_join(one, two, "k", "many_to_one").collect()) == [(1, "both"), (1, "both"), (2, "left_only")]
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(two, one, "k", "many_to_one").collect()
    with pytest.raises(ValueError):
        joins.require(one, ["missing"])


def test_files(spark, tmp_path):
    schema = schema_for("routes")
    row = dict.fromkeys(schema.names) | {"route_id": "R1", "route_name": 'say "hi", please', "social_service_required": True, "row_ordinal": 3, "raw_record_text": '{"a":"b"}'}
    df = spark.createDataFrame([tuple(row[c] for c in schema.names)], schema)
    files.write_csv(df, str(tmp_path / "routes"))
    assert files.read_csv(spark, str(tmp_path / "routes"), schema).collect() == df.collect()
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "routes"), schema_for("stops")).collect()
    assert len(TABLES) == 21 and [f.dataType.simpleString() for f in files.raw_schema(schema).fields if f.name == "event_time"] == ["string"]
    files.write_once(df, str(tmp_path / "p"), ["service_date"])
    assert files.complete(spark, str(tmp_path / "p"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_once(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.run_path("x", "../a", "b", "c")
    with pytest.raises(ValueError):
        files.bounded(spark.range(11), 10)


def test_scalars(spark):
    r = spark.createDataFrame([("12", "ab", '{"a":{"b/c":[1,7]}}', " =SUM(1)")], "x string, y string, j string, c string")
    r = r.withColumn("id", scalars.composite("x", "y"))
    one, two = scalars.composite_parts("id")
    got = r.select("id", one.alias("one"), two.alias("two"), scalars.pointer("j", "/a/b~1c/1").alias("p"), scalars.neutralised("c").alias("safe")).first()
    assert tuple(got) == ("2:12ab", "12", "ab", "7", "' =SUM(1)")


def test_streamed_history_equals_batch(spark, tmp_path):
    from korridor.streaming.history import history_stream

    rows = []
    for i, k, c, y, a, t, _, _ in HISTORY:
        if k and c:
            rows.append((k, at(c), True, int(i[1]) + (100 if k == "R2" else 0), None, None))
            if y is not None and a:
                rows.append((k, max(at(c) + 1, at(a)), False, 0, at(c), y))
    df = spark.createDataFrame(rows, "key string, s long, asks boolean, row_id long, t long, y double").select("key", F.timestamp_seconds("s").alias("instant"), "asks", "row_id", "t", "y")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = history_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.key, r.row_id): (r.lag_1, r.mean_n) for r in spark.table("history").collect()}
    want = {(k, int(i[1]) + (100 if k == "R2" else 0)): (x, m) for i, k, c, _, _, _, x, m in HISTORY if k and c}
    assert got == want


def test_samples_by_histogram(spark):
    """Quotas under, over and at a group's size, as numbers and as a column, with null groups and repeated ids: the plain ranking."""
    import hashlib

    rows = [(g, i % 900) for g, n in (("a", 2000), ("b", 30), (None, 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(4).withColumn("most", F.when(F.col("g") == "a", 700).otherwise(20))
    for quota, limit in ((F.col("most"), {"a": 700, "b": 20, None: 20}), (30, {"a": 30, "b": 30, None: 30}), (3000, {"a": 2000, "b": 30, None: 500})):
        for buckets in (16, 4096):
            got = windows.ranked_sample(df, ["g"], quota, ["i"], "7", buckets)
            assert got.columns == ["g", "i", "most", "sample_rank"]
            found = {}
            for x in got.collect():
                found.setdefault(x.g, []).append((x.sample_rank, x.i))
            for g, n in limit.items():
                want = sorted((i for h, i in rows if h == g), key=lambda i: (hashlib.sha256(f"7|{i}".encode()).hexdigest(), i))[:n]
                assert [i for _, i in sorted(found[g])] == want and [k for k, _ in sorted(found[g])] == list(range(1, n + 1))
