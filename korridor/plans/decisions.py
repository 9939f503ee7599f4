"""Recommendations, what-if scenarios, corrections, generation and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import allocation, transit, whatif, windows
from korridor.plans.registry import portable, query
from korridor.roles import Roles

POLICY = {"minimum_samples": 30, "minimum_days": 2, "overload_ratio": 1.0, "underutilization_ratio": 0.5, "late_fraction": 0.3, "bottleneck_delay_s": 20_000_000.0, "headway_cv": 1.0, "passenger_impact_bands": [50, 20000, 66000], "severity_bands": [1.1, 1.5, 2.0]}
def states(r: Roles) -> DataFrame:
    """A window of an hour per route: its passengers arrive evenly, two departures of 30 seats."""
    p = r.passengers.groupBy("route_id").agg(F.count("*").cast("double").alias("p"))
    trip = lambda m: F.struct(F.lit(float(m)).alias("minute"), F.lit(30.0).alias("capacity"))
    profile = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), F.col("p").alias("passengers")))
    return p.select("route_id", F.array(trip(30), trip(60)).alias("trips"), profile.alias("profile"), F.lit(60.0).alias("window"), F.lit(30.0).alias("cycle"))


SCENARIOS = {
    "baseline": ({}, "30, 60, 60, 60, 30, 30, 0, 0, 1, 0"), "increase_frequency": ({"trip_count": 4}, "15, 30, 45, 60, 30, 30, 30, 30, 1, 0"), "decrease_frequency": ({"trip_count": 1}, "60, 60, 60, 60, 30, 0, 0, 0, 1, 0"),
    "add_vehicle": ({}, "15, 30, 45, 60, 30, 30, 30, 30, 1, 0"), "change_vehicle_capacity": ({"capacity": 60}, "30, 60, 60, 60, 60, 60, 0, 0, 1, 0"), "shift_trip_start_time": ({"trip": 1, "minutes": -10}, "20, 60, 60, 60, 30, 30, 0, 0, 1, 0"),
    "remove_low_demand_trip": ({"trip": 1}, "60, 60, 60, 60, 30, 0, 0, 0, 1, 0"), "add_new_stop": ({"cycle": 15, "passengers": 30}, "60, 60, 60, 60, 30, 0, 0, 0, 1, 30"), "increase_predicted_demand": ({"factor": 2}, "30, 60, 60, 60, 30, 30, 0, 0, 2, 0"),
}


def _queue_sql(names: list[str]) -> str:
    rows = ", ".join(f"('{n}', {SCENARIOS[n][1]})" for n in names)
    return f"""WITH c(scenario, t1, t2, t3, t4, k1, k2, k3, k4, f, extra) AS (VALUES {rows}),
s AS (SELECT p.route_id, c.*, p.n * c.f::DOUBLE + c.extra AS d FROM (SELECT route_id, count(*) AS n FROM passengers GROUP BY route_id) p, c),
s1 AS (SELECT *, least(d * t1 / 60, k1) AS a1 FROM s), s2 AS (SELECT *, least(d * t2 / 60, a1 + k2) AS a2 FROM s1), s3 AS (SELECT *, least(d * t3 / 60, a2 + k3) AS a3 FROM s2), s4 AS (SELECT *, least(d * t4 / 60, a3 + k4) AS a4 FROM s3)
SELECT route_id, scenario, round(k1 + k2 + k3 + k4, 6)::DOUBLE AS capacity, round(a4, 6) AS served, round(greatest(0, d - a4), 6) AS unserved, round((t1 * a1 + t2 * (a2 - a1) + t3 * (a3 - a2) + t4 * (a4 - a3) - a4 * a4 * 60 / (2 * d)) / a4, 6) AS wait_minutes FROM s4"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("route_id", "scenario", *(F.round(c, 6).alias(c) for c in ("capacity", "served", "unserved", "wait_minutes")))


GAPS = "SELECT *, actual_s - lag(actual_s) OVER (PARTITION BY route_id, direction, stop_id ORDER BY actual_s NULLS LAST, trip_id, seq) AS gap FROM spine"
METRICS = f"""SELECT route_id, count(*) AS sample_count, CAST(sum(boardings) AS DOUBLE) AS affected_passengers, avg(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END) AS mean_occupancy_ratio, max(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END) AS peak_occupancy_ratio,
count(DISTINCT CASE WHEN boardings > capacity THEN service_date END) AS overload_days, avg(CAST(CASE WHEN actual_s > scheduled_s THEN 1 ELSE 0 END AS DOUBLE)) AS late_fraction, count(DISTINCT CASE WHEN actual_s > scheduled_s THEN service_date END) AS late_days, avg(greatest(0, actual_s - scheduled_s)) AS mean_delay_s, stddev_pop(gap) / nullif(avg(gap), 0) AS headway_cv,
count(DISTINCT CASE WHEN capacity > 0 AND CAST(boardings AS DOUBLE) / capacity < 0.5 THEN service_date END) AS underutilized_days FROM ({GAPS}) s GROUP BY route_id"""
#: what the rules need besides: days of uneven headways, stops that other routes serve too, a social mode, the first trip ten minutes earlier
EVIDENCE = f"""SELECT m.*, d.irregular_headway_days, k.coverage_preserved, n.mode = 'AFRICA' AS social_service_required, q.wait_minutes AS w0, a.wait_minutes AS w1 FROM ({METRICS}) m
LEFT JOIN (SELECT route_id, count(CASE WHEN cv >= 1.0 THEN 1 END) AS irregular_headway_days FROM (SELECT route_id, service_date, stddev_pop(gap) / nullif(avg(gap), 0) AS cv FROM ({GAPS}) s GROUP BY route_id, service_date) x GROUP BY route_id) d ON d.route_id = m.route_id
LEFT JOIN (SELECT x.route_id, min(y.n) > 1 AS coverage_preserved FROM (SELECT DISTINCT route_id, stop_id FROM spine) x JOIN (SELECT stop_id, count(DISTINCT route_id) AS n FROM spine GROUP BY stop_id) y ON y.stop_id = x.stop_id GROUP BY x.route_id) k ON k.route_id = m.route_id
LEFT JOIN routes n ON n.route_id = m.route_id
LEFT JOIN ({_queue_sql(["baseline"])}) q ON q.route_id = m.route_id LEFT JOIN ({_queue_sql(["shift_trip_start_time"])}) a ON a.route_id = m.route_id"""


def _rules_sql() -> str:
    # rule: severity, what must be known besides, when it holds
    rules = {
        "increase_frequency": ("mean_occupancy_ratio / 1.0", "overload_days", "mean_occupancy_ratio > 1.0 AND overload_days >= 2"),
        "reduce_underutilized_service": ("CASE WHEN mean_occupancy_ratio IS NOT NULL THEN 1 + greatest(0, 0.5 - mean_occupancy_ratio) / 0.5 END", "underutilized_days + social_service_required::INT + coverage_preserved::INT", "mean_occupancy_ratio < 0.5 AND underutilized_days >= 2 AND NOT social_service_required AND coverage_preserved"),
        "modify_schedule": ("late_fraction / 0.3", "late_days", "late_fraction / 0.3 >= 1 AND late_days >= 2"),
        "higher_capacity_vehicle": ("peak_occupancy_ratio / 1.0", "overload_days", "peak_occupancy_ratio > 1.0 AND overload_days >= 2"),
        "investigate_bottleneck": ("mean_delay_s / 20000000", "late_days", "mean_delay_s / 20000000 >= 1 AND late_days >= 2"),
        "adjust_departure_time": ("CASE WHEN w0 > 0 THEN 1 + (w0 - w1) / w0 WHEN w1 IS NOT NULL THEN w0 * 0 END", "w0 + w1", "w0 > w1"),
        "improve_headways": ("headway_cv / 1.0", "irregular_headway_days", "headway_cv / 1.0 >= 1 AND irregular_headway_days >= 2"),
    }
    parts = [f"SELECT route_id, '{rule}' AS rule, CASE WHEN sample_count < 30 OR ({severity}) IS NULL OR ({known}) IS NULL THEN 'NOT_READY' WHEN {holds} THEN 'TRIGGERED' ELSE 'NO_ACTION' END AS status, {severity} AS severity, affected_passengers AS p FROM m" for rule, (severity, known, holds) in rules.items()]
    banded = "(p >= 50)::INT + (p >= 20000)::INT + (p >= 66000)::INT + (severity >= 1.1)::INT + (severity >= 1.5)::INT + (severity >= 2.0)::INT"
    return f"WITH m AS ({EVIDENCE}), r AS ({' UNION ALL '.join(parts)}) SELECT route_id, rule, status, round(severity, 6) AS severity, CASE WHEN status = 'TRIGGERED' THEN CASE ({banded}) // 2 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END END AS priority FROM r"


def route_metrics(r: Roles) -> DataFrame:
    """What the rules measure of each route, from sums by route and day.

    A headway is the time since the departure before at the same stop, by route and direction. Rows
    are added up by route and day once; counts of days are then counts of rows, and no count of
    distinct days multiplies the visits. Means and spreads follow from counts, sums and squares.
    """
    x = windows.headway(transit.occupancy(r.spine, "boardings", "capacity"), ["route_id", "direction", "stop_id"], "actual_s", "scheduled_s", ["trip_id", "seq"])
    late, gap = F.col("actual_s") > F.col("scheduled_s"), F.col("headway_s").cast("double")
    days = x.groupBy("route_id", "service_date").agg(
        F.count("*").alias("n"), F.sum("boardings").alias("boardings"), F.count("utilization").alias("loads_n"), F.sum("utilization").alias("loads"), F.max("utilization").alias("peak"), F.count_if("over_capacity").alias("over_n"), F.count_if(late).alias("late_n"),
        F.count_if(F.col("utilization") < POLICY["underutilization_ratio"]).alias("under_n"), F.count(transit.positive_delay("actual_s", "scheduled_s")).alias("delays_n"), F.sum(transit.positive_delay("actual_s", "scheduled_s")).alias("delay"),
        F.count(gap).alias("gaps_n"), F.sum(gap).alias("gap"), F.sum(gap * gap).alias("gap2"), (F.stddev_pop(gap) / F.nullif(F.avg(gap), F.lit(0.0))).alias("cv"),
    )
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    mean = ratio("gap", "gaps_n")
    known_day = F.col("service_date").isNotNull()
    return days.groupBy("route_id").agg(
        F.sum("n").alias("sample_count"), F.sum("boardings").cast("double").alias("affected_passengers"), ratio("loads", "loads_n").alias("mean_occupancy_ratio"), F.max("peak").alias("peak_occupancy_ratio"),
        F.count_if(known_day & (F.col("over_n") > 0)).alias("overload_days"), ratio("late_n", "n").alias("late_fraction"), F.count_if(known_day & (F.col("late_n") > 0)).alias("late_days"), ratio("delay", "delays_n").alias("mean_delay_s"),
        F.try_divide(F.sqrt(F.greatest(F.lit(0.0), ratio("gap2", "gaps_n") - mean * mean)), F.nullif(mean, F.lit(0.0))).alias("headway_cv"), F.count_if(known_day & (F.col("under_n") > 0)).alias("underutilized_days"),
        F.count_if(F.col("cv") >= POLICY["headway_cv"]).alias("irregular_headway_days"),
    )


def rule_evidence(r: Roles) -> DataFrame:
    """The metrics of each route with what the rules need besides them."""
    shared = r.spine.groupBy("stop_id").agg(F.collect_set("route_id").alias("on")).select(F.explode("on").alias("route_id"), F.size("on").alias("n")).groupBy("route_id").agg((F.min("n") > 1).alias("coverage_preserved"))
    social = r.routes.select("route_id", (F.col("mode") == "AFRICA").alias("social_service_required"))
    change = SCENARIOS["shift_trip_start_time"][0]
    wait = lambda kind, name, **c: _shown(whatif.simulate(whatif.scenario(states(r), kind, **c))).select("route_id", F.col("wait_minutes").alias(name))
    x = route_metrics(r).withColumns({"trip_id": F.lit(change["trip"]), "evaluated_shift_minutes": F.lit(float(change["minutes"]))})
    for more in (shared, social, wait("baseline", "current_expected_wait_minutes"), wait("shift_trip_start_time", "alternative_expected_wait_minutes", **change)):
        x = x.join(more, "route_id", "left")
    return x


@query("e01_rules", _rules_sql())
def rules(r: Roles) -> DataFrame:
    return whatif.recommend(rule_evidence(r), "route_id", POLICY).select("route_id", "rule", "status", F.round("severity", 6).alias("severity"), "priority")


portable("e02_priority", "SELECT route_id, CASE CAST(floor((CASE WHEN p >= 20000 THEN 1 ELSE 0 END + CASE WHEN p >= 66000 THEN 1 ELSE 0 END + CASE WHEN p >= 70000 THEN 1 ELSE 0 END + 2) / 2) AS INT) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS priority FROM (SELECT route_id, sum(boardings) AS p FROM spine GROUP BY route_id) q")


@query("e03_generate", f"SELECT DISTINCT 'REC-' || sha256(route_id || '|' || rule || '|' || priority) AS recommendation_id, route_id, rule, priority FROM ({_rules_sql()}) q WHERE status = 'TRIGGERED'")
def generate(r: Roles) -> DataFrame:
    """Each recommendation once, by the digest of what it says, the most pressing first."""
    digest = F.concat(F.lit("REC-"), F.sha2(F.concat_ws("|", F.col("route_id").cast("string"), "rule", "priority"), 256))
    x = rules(r).filter("status = 'TRIGGERED'").withColumn("recommendation_id", digest).dropDuplicates(["recommendation_id"])
    order = F.array_position(F.array(*map(F.lit, reversed(whatif.PRIORITIES))), F.col("priority"))
    return x.select("recommendation_id", "route_id", "rule", "priority").orderBy(order, "route_id", "rule")


@query("e04_queue", _queue_sql(["baseline"]))
def queue(r: Roles) -> DataFrame:
    return _shown(whatif.simulate(whatif.scenario(states(r), "baseline")))


@query("e05_scenarios", _queue_sql(list(SCENARIOS)))
def scenarios(r: Roles) -> DataFrame:
    out = None
    for kind, (change, _) in SCENARIOS.items():
        part = whatif.scenario(states(r), kind, **change)
        out = part if out is None else out.unionByName(part)
    return _shown(whatif.simulate(out))


@query("e06_deltas", f"WITH x AS ({_queue_sql(list(SCENARIOS))}) SELECT x.route_id, x.scenario, round(x.served - b.served, 6) AS served_delta, round(x.wait_minutes - b.wait_minutes, 5) AS wait_delta FROM x JOIN x b ON b.route_id = x.route_id AND b.scenario = 'baseline' WHERE x.scenario <> 'baseline'")
def deltas(r: Roles) -> DataFrame:
    x = scenarios(r)
    b = x.filter("scenario = 'baseline'").select("route_id", F.col("served").alias("s"), F.col("wait_minutes").alias("w"))
    return x.filter("scenario <> 'baseline'").join(b, "route_id").select("route_id", "scenario", F.round(F.col("served") - F.col("s"), 6).alias("served_delta"), F.round(F.col("wait_minutes") - F.col("w"), 5).alias("wait_delta"))


# corrections: repaired counts are 'N' rows moved to the next stop of the trip
portable("r01_balance", "SELECT coalesce(a.trip_id, b.trip_id) AS trip_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS net FROM (SELECT trip_id, CAST(sum(boardings) AS BIGINT) AS n FROM visits GROUP BY trip_id) a FULL JOIN (SELECT trip_id, CAST(sum(boardings + CASE WHEN direction = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM visits GROUP BY trip_id) b ON a.trip_id = b.trip_id WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
portable("r02_boarding_deltas", "SELECT v.trip_id, v.seq, CAST(sum(CASE WHEN d.seq = v.seq THEN 1 ELSE -1 END) AS BIGINT) AS delta FROM visits v JOIN (SELECT trip_id, seq FROM visits WHERE direction = 'R') d ON d.trip_id = v.trip_id AND d.seq IN (v.seq, v.seq + 1) GROUP BY v.trip_id, v.seq")
portable("r04_vehicle_overlay", "SELECT u.vehicle_id AS unused, d.vehicle_id AS donor, d.trip_id, d.seq, u.capacity FROM (SELECT vehicle_id, capacity, row_number() OVER (PARTITION BY capacity ORDER BY vehicle_id) AS r FROM vehicles h WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.vehicle_id = h.vehicle_id)) u JOIN (SELECT v.vehicle_id, v.trip_id, v.seq, h.capacity, row_number() OVER (PARTITION BY h.capacity ORDER BY v.vehicle_id, v.trip_id, v.seq) AS r FROM visits v JOIN vehicles h ON h.vehicle_id = v.vehicle_id JOIN (SELECT vehicle_id FROM visits GROUP BY vehicle_id HAVING count(*) > 1) m ON m.vehicle_id = v.vehicle_id) d ON d.capacity = u.capacity AND d.r = u.r")
portable("r05_first_free_slot", "SELECT passenger_id, min(end_s) AS free_s FROM (SELECT passenger_id, scheduled_s + 86400 AS end_s, lead(scheduled_s) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS next_s FROM trips) q WHERE next_s IS NULL OR next_s - end_s >= 604800 GROUP BY passenger_id")


@query("r06_recomputed_counts", "SELECT trip_id, seq, CAST(sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS onboard_departure FROM (SELECT trip_id, seq, boardings + CASE WHEN direction = 'R' THEN 1 ELSE 0 END AS boardings, alightings FROM visits) q")
def recomputed_counts(r: Roles) -> DataFrame:
    x = r.visits.withColumn("boardings", F.col("boardings") + (F.col("direction") == "R").cast("long"))
    return windows.onboard(x, ["trip_id"], "seq", "boardings", "alightings").select("trip_id", "seq", "onboard_departure")


@query("r07_patched_rows", """WITH p AS (SELECT trip_id, seq, stop_id + 1 AS stop_id FROM visits WHERE direction = 'R' AND boardings > 90), v AS (SELECT v.trip_id // 64 AS shard, count(*) AS rows_n, count(p.trip_id) AS patched_n, sum(coalesce(p.stop_id, v.stop_id))::BIGINT AS stops_sum FROM visits v LEFT JOIN p ON p.trip_id = v.trip_id AND p.seq = v.seq GROUP BY 1)
SELECT shard, rows_n, patched_n, stops_sum, patched_n > 0 AS rewritten FROM v""")
def patched_rows(r: Roles) -> DataFrame:
    """Only shards that a patch touches are rewritten, whole; the others are read where they lie."""
    from korridor.sources.files import patched

    shard = F.floor(F.col("trip_id") / 64)
    patch = r.visits.filter("direction = 'R' AND boardings > 90").select("trip_id", "seq", (F.col("stop_id") + 1).alias("stop_id"))
    touched = patch.groupBy(shard.alias("shard")).agg(F.count("*").alias("patched_n"))
    rows = r.visits.select(shard.alias("shard"), "trip_id", "seq", "stop_id")
    new = patched(rows.join(touched.select("shard"), "shard", "left_semi"), patch, ["trip_id", "seq"])
    kept = rows.join(touched.select("shard"), "shard", "left_anti")
    x = new.select("shard", "stop_id").unionByName(kept.select("shard", "stop_id")).groupBy("shard").agg(F.count("*").alias("rows_n"), F.sum("stop_id").alias("stops_sum"))
    return x.join(touched, "shard", "left").select("shard", "rows_n", F.coalesce("patched_n", F.lit(0)).alias("patched_n"), "stops_sum", F.col("patched_n").isNotNull().alias("rewritten"))


@query("r08_reused_scan", "SELECT a.route_id, a.n, b.late FROM (SELECT route_id, count(*) AS n FROM spine GROUP BY route_id) a JOIN (SELECT route_id, count(*) AS late FROM spine WHERE actual_s > scheduled_s GROUP BY route_id) b ON b.route_id = a.route_id")
def reused_scan(r: Roles) -> DataFrame:
    """Two summaries of the same departures: the first asks for them and has them written, the second reads them."""
    from korridor.plans.delivery import scratch
    from korridor.sources.store import Scans

    scans = Scans(r.spark, scratch(r))
    departures = lambda: scans.get(f"{r.sf_dir}/lineitem.parquet", "departures", lambda _: r.spine.select("route_id", "actual_s", "scheduled_s"))
    every = departures().groupBy("route_id").agg(F.count("*").alias("n"))
    late = departures().filter("actual_s > scheduled_s").groupBy("route_id").agg(F.count("*").alias("late"))
    return every.join(late, "route_id").select("route_id", "n", "late")


# generation
@query("g01_ids", "SELECT trip_id, 'TRP-' || sha256('trips|' || trip_id) AS id FROM trips")
def ids(r: Roles) -> DataFrame:
    return r.trips.select("trip_id", F.concat(F.lit("TRP-"), F.sha2(F.concat_ws("|", F.lit("trips"), F.col("trip_id")), 256)).alias("id"))


@query("g03_calendar", "SELECT CAST(d AS DATE) AS service_date, isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2025-01-01', DATE '2025-05-01') OR CAST(d AS DATE) = DATE '2025-03-01' AS runs FROM range(TIMESTAMP '2025-01-01', TIMESTAMP '2026-01-01', INTERVAL 1 DAY) t(d)")
def calendar(r: Roles) -> DataFrame:
    days = r.spark.range(1).select(F.explode(F.sequence(F.lit("2025-01-01").cast("date"), F.lit("2025-12-31").cast("date"))).alias("service_date"))
    d = F.col("service_date")
    runs = F.when(d.isin("2025-01-01", "2025-05-01"), False).when(d == F.lit("2025-03-01").cast("date"), True).otherwise(F.weekday(d) < 5)
    return days.select("service_date", runs.alias("runs"))


portable("g04_plan_versions", "SELECT trip_id, version, CASE WHEN version = 1 AND status = 'P' THEN 'SUPERSEDED' ELSE 'CURRENT' END AS plan_status FROM (SELECT trip_id, status, 1 AS version FROM trips UNION ALL SELECT trip_id, status, 2 FROM trips WHERE status = 'P') q")


@query("g05_actual_times", "WITH RECURSIVE w AS (SELECT trip_id, 1 AS seq, 0 AS at_s FROM trips UNION ALL SELECT trip_id, seq + 1, greatest(seq * 120, at_s + 30 + (trip_id * seq) % 150) FROM w WHERE seq < 8) SELECT trip_id, seq, CAST(at_s AS BIGINT) AS at_s FROM w")
def actual_times(r: Roles) -> DataFrame:
    """Departures along a trip: never before schedule, never within 30 s of the stop before."""
    start = F.array(F.lit(0).cast("long"))
    go = lambda done, s: F.concat(done, F.array(F.greatest(s * 120, F.element_at(done, -1) + 30 + (F.col("trip_id") * s) % 150)))
    run = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")), start, go)
    return r.trips.select("trip_id", F.posexplode(run).alias("p", "at_s")).select("trip_id", (F.col("p") + 1).alias("seq"), "at_s")


portable("g06_demand_formula", "SELECT trip_id, round(CAST(20 AS DOUBLE) * CASE WHEN (CAST(floor(scheduled_s / 86400) AS BIGINT) + 3) % 7 + 1 >= 6 THEN CAST(0.72 AS DOUBLE) ELSE 1 END * CASE WHEN trip_id % 2 = 1 THEN CAST(0.62 AS DOUBLE) ELSE 1 END * CASE WHEN trip_id % 97 = 0 THEN 2 ELSE 1 END, 4) AS demand FROM trips")


@query("g07_rider_flow", """WITH c AS (SELECT trip_id, seq, boardings, sum(boardings) OVER w - boardings AS before_n, sum(alightings) OVER w AS off_n FROM visits WINDOW w AS (PARTITION BY trip_id ORDER BY seq)), r AS (SELECT trip_id, seq, unnest(range(1, boardings + 1)) AS rider, before_n FROM c WHERE boardings > 0)
SELECT r.trip_id, r.seq, r.rider, min(c.seq) AS alights_seq, 'TK-' || r.trip_id || '-' || (r.before_n + r.rider)::BIGINT AS ticket FROM r LEFT JOIN c ON c.trip_id = r.trip_id AND c.seq > r.seq AND c.off_n >= r.before_n + r.rider GROUP BY r.trip_id, r.seq, r.rider, r.before_n""")
def rider_flow(r: Roles) -> DataFrame:
    """A journey and its ticket for each boarding of a visit; who boards first alights first, null if never.

    A trip's riders are numbered in order of boarding; rider k alights at the first later visit by which
    k have alighted. So those who board at a visit are a few runs of numbers, one for each later visit
    where some of them alight and one for who never does; only the runs are spread out to riders.
    """
    along = Window.partitionBy("trip_id").orderBy("seq")
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = r.visits.select("trip_id", "seq", "boardings", (F.sum("boardings").over(run) - F.col("boardings")).alias("before_n"), F.sum("alightings").over(run).alias("off_n"))
    x = x.withColumn("stops", F.collect_list(F.struct("seq", "off_n")).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("boardings > 0")
    kind, last = "struct<seq:int,first:bigint,last:bigint>", F.col("before_n") + F.col("boardings")
    part = lambda seq, first, end: F.array(F.struct(seq.cast("int").alias("seq"), first.alias("first"), end.alias("last")).cast(kind))

    def alight(done, t):
        some = (t["seq"] > F.col("seq")) & (t["off_n"] > done["at"])
        end = F.least(t["off_n"], last)
        return F.struct(F.when(some, end).otherwise(done["at"]).alias("at"), F.when(some & (done["at"] < last), F.concat(done["runs"], part(t["seq"], done["at"] + 1, end))).otherwise(done["runs"]).alias("runs"))

    start = F.struct(F.col("before_n").alias("at"), F.array().cast(f"array<{kind}>").alias("runs"))
    runs = F.aggregate("stops", start, alight, lambda done: F.when(done["at"] < last, F.concat(done["runs"], part(F.lit(None), done["at"] + 1, last))).otherwise(done["runs"]))
    x = x.select("trip_id", "seq", "before_n", F.explode(runs).alias("run")).select("trip_id", "seq", "before_n", F.col("run.seq").alias("alights_seq"), F.explode(F.sequence("run.first", "run.last")).alias("number"))
    return x.select("trip_id", "seq", (F.col("number") - F.col("before_n")).alias("rider"), "alights_seq", F.concat_ws("-", F.lit("TK"), F.col("trip_id").cast("string"), F.col("number").cast("string")).alias("ticket"))


@query("g08_allocated_duties", None)
def allocated_duties(r: Roles) -> DataFrame:
    """Each operated trip's vehicle of its route's depot, round robin, an hour free between duties; null if the depot has none free."""
    routes = r.routes.select("route_id").withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("route_id")) - 1)  # a row a route
    depots = r.vehicles.join(F.broadcast(routes), F.pmod(F.col("vehicle_id"), F.lit(routes.count())) == F.col("_n")).select("route_id", "vehicle_id")
    duties = r.spine.filter("status <> 'P'").groupBy("route_id", "trip_id").agg(F.min("scheduled_s").alias("start_s"), F.max("actual_s").alias("end_s"))
    return allocation.allocate(duties, depots, "route_id", "trip_id", "vehicle_id", "start_s", "end_s", 3600)


@query("r05_bundle_placement", None)
def bundle_placement(r: Roles) -> DataFrame:
    """Riders of the fullest visits move to visits of the same route that want some, where they are free."""
    x = r.spine.filter("actual_s > scheduled_s").join(r.trips.select("trip_id", "passenger_id"), "trip_id")
    visit = F.col("trip_id") * 10 + F.col("seq")
    slots = x.filter("boardings < 3").select("route_id", visit.alias("slot"), (3 - F.col("boardings")).cast("int").alias("wanted"), F.col("actual_s").alias("start_s"), (F.col("actual_s") + 3600).alias("end_s"))
    pool = x.filter("boardings > 90").select("route_id", visit.alias("item"), "passenger_id", F.col("actual_s").alias("start_s"), (F.col("actual_s") + 3600).alias("end_s"))
    return allocation.place_bundles(slots, pool, "route_id", "slot", "wanted", "item", "passenger_id", "start_s", "end_s")


portable("g08_duties", "SELECT vehicle_id, count(*) AS duties, CAST(sum(CASE WHEN scheduled_s < busy + 3600 THEN 1 ELSE 0 END) AS BIGINT) AS clashes FROM (SELECT vehicle_id, scheduled_s, max(actual_s) OVER (PARTITION BY vehicle_id ORDER BY scheduled_s, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spine WHERE actual_s > scheduled_s) q GROUP BY vehicle_id")


@query("g09_movement_budget", "WITH g AS (SELECT trip_id AS k, sum(boardings) AS n FROM visits GROUP BY trip_id), s AS (SELECT k, n * 100000::DOUBLE / sum(n) OVER () AS share FROM g), f AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, k) AS r FROM s) SELECT k, CAST(base + CASE WHEN r <= 100000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def movement_budget(r: Roles) -> DataFrame:
    return windows.largest_remainder(r.visits.groupBy(F.col("trip_id").alias("k")).agg(F.sum("boardings").alias("n")), [], "n", 100_000, "k").select("k", "quota")


portable("g12_prediction_cases", "SELECT trip_id, scheduled_s AS cutoff_s, scheduled_s + 3600 AS horizon_s, scheduled_s + 3600 >= 946684800 AND scheduled_s < 946684800 AS purged FROM trips")

# reports
