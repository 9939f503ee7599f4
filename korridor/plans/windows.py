"""Window, history and as-of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korridor.operators import asof, intervals, transit, windows
from korridor.plans.registry import portable, query
from korridor.roles import Roles

HISTORY = """WITH h AS (SELECT q.row_id, o.target, row_number() OVER (PARTITION BY q.row_id ORDER BY o.at_s DESC, o.row_id DESC) AS r
FROM observations q JOIN observations o ON q.route_id = o.route_id AND o.at_s < q.at_s AND o.available_s <= q.at_s),
a AS (SELECT row_id, max(CASE WHEN r = 1 THEN target END) AS lag_1, avg(target) AS mean_7 FROM h WHERE r <= 7 GROUP BY row_id)
SELECT q.row_id, round(a.lag_1, 6) AS lag_1, round(a.mean_7, 6) AS mean_7 FROM observations q LEFT JOIN a ON a.row_id = q.row_id"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.round("lag_1", 6).alias("lag_1"), F.round("mean_7", 6).alias("mean_7"))


@query("w03_past_only_history", HISTORY)
def history(r: Roles) -> DataFrame:
    return _rounded(asof.past_only_history(r.observations, ["route_id"], "row_id", "at_s", "at_s", "available_s", "target", ["row_id"]))


@query("w03_past_only_history_streamed", HISTORY)
def history_streamed(r: Roles) -> DataFrame:
    return _rounded(asof.past_only_history_streamed(r.observations, ["route_id"], "row_id", "at_s", "at_s", "available_s", "target", ["row_id"], parts=r.mark_parts))


@query("w01_headway", """SELECT trip_id, seq, headway_s, scheduled_headway_s, headway_s - scheduled_headway_s AS headway_deviation_s FROM (SELECT trip_id, seq,
actual_s - lag(actual_s) OVER (PARTITION BY route_id, direction, stop_id ORDER BY actual_s NULLS LAST, trip_id, seq) AS headway_s,
scheduled_s - lag(scheduled_s) OVER (PARTITION BY route_id, direction, stop_id ORDER BY scheduled_s NULLS LAST, trip_id, seq) AS scheduled_headway_s FROM spine) q""")
def headway(r: Roles) -> DataFrame:
    return windows.headway(r.spine, ["route_id", "direction", "stop_id"], "actual_s", "scheduled_s", ["trip_id", "seq"]).select("trip_id", "seq", "headway_s", "scheduled_headway_s", "headway_deviation_s")


@query("w02_headway_by_sequence", "SELECT trip_id, seq, actual_s - lag(actual_s) OVER (PARTITION BY route_id, seq ORDER BY actual_s NULLS LAST, trip_id) AS headway_s FROM spine")
def headway_by_sequence(r: Roles) -> DataFrame:
    return windows.headway(r.spine, ["route_id", "seq"], "actual_s", "scheduled_s", ["trip_id"]).select("trip_id", "seq", "headway_s")


@query("w04_previous_occupancy", """SELECT trip_id, seq, round(lag(CASE WHEN capacity > 0 THEN boardings * 1.0::DOUBLE / capacity END) OVER (PARTITION BY stop_id ORDER BY scheduled_s, trip_id, seq), 6) AS previous FROM spine""")
def previous_occupancy(r: Roles) -> DataFrame:
    x = transit.occupancy(r.spine, "boardings", "capacity")
    x = windows.lag_if(x, ["stop_id"], ["scheduled_s", "trip_id", "seq"], "utilization", F.col("occupancy_status") == "AVAILABLE", "previous")
    return x.select("trip_id", "seq", F.round("previous", 6).alias("previous"))


@query("w05_ranked_sample", """SELECT direction, trip_id, seq, r AS sample_rank FROM (SELECT direction, trip_id, seq, CAST(row_number() OVER (PARTITION BY direction ORDER BY sha256('20260926|' || trip_id || '|' || seq), trip_id, seq) AS INTEGER) AS r FROM visits) q
WHERE r <= CASE direction WHEN 'A' THEN 50 WHEN 'N' THEN 80 ELSE 30 END""")
def ranked_sample(r: Roles) -> DataFrame:
    quota = F.create_map(F.lit("A"), F.lit(50), F.lit("N"), F.lit(80), F.lit("R"), F.lit(30))[F.col("direction")]
    return windows.ranked_sample(r.visits, ["direction"], quota, ["trip_id", "seq"], "20260926").select("direction", "trip_id", "seq", "sample_rank")


portable("w06_order_checks", "SELECT trip_id, seq, actual_s - lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS step_s FROM visits")


@query("w07_interval_overlap", """SELECT vehicle_id, trip_id, seq FROM (SELECT *, max(actual_s) OVER (PARTITION BY vehicle_id ORDER BY scheduled_s, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spine WHERE actual_s >= scheduled_s) q WHERE scheduled_s < busy""")
def interval_overlap(r: Roles) -> DataFrame:
    return windows.overlaps(r.spine.filter("actual_s >= scheduled_s"), ["vehicle_id"], "scheduled_s", "actual_s", ["trip_id", "seq"]).select("vehicle_id", "trip_id", "seq")


portable("w08_load_continuity", "SELECT trip_id, seq, boardings - lag(alightings, 1, 0) OVER (PARTITION BY trip_id ORDER BY seq) AS jump FROM visits")


@query("w09_terminal_load", "SELECT trip_id, boardings - alightings AS terminal FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq DESC) AS n FROM visits) q WHERE n = 1")
def terminal_load(r: Roles) -> DataFrame:
    return r.visits.groupBy("trip_id").agg(F.max_by(F.col("boardings") - F.col("alightings"), "seq").alias("terminal"))


portable(
    "w10_bunching",
    """SELECT trip_id, gap, planned, coalesce(gap < 0.25 * planned OR planned = 0 AND gap < 300, false) AS bunched, coalesce(gap <= 0 OR abs(gap - planned) > greatest(300, 0.5 * planned), false) AS irregular
FROM (SELECT trip_id, actual_s - lag(actual_s) OVER w AS gap, abs(scheduled_s - lag(scheduled_s) OVER w) AS planned FROM spine WHERE seq = 1 WINDOW w AS (PARTITION BY service_date, route_id, direction ORDER BY scheduled_s, trip_id)) q""",
)


@query("w11_sequence_gap", "SELECT trip_id, seq, max(bad) OVER (PARTITION BY trip_id) AS has_gap FROM (SELECT trip_id, seq, coalesce(seq - lag(seq) OVER (PARTITION BY trip_id ORDER BY seq) <> 1, false) AS bad FROM visits) q")
def sequence_gap(r: Roles) -> DataFrame:
    return windows.sequence_gap(r.visits, ["trip_id"], "seq").select("trip_id", "seq", "has_gap")


@query("w12_onboard", """SELECT trip_id, seq, CAST(coalesce(sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onboard_arrival,
CAST(sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS onboard_departure FROM visits""")
def onboard(r: Roles) -> DataFrame:
    return windows.onboard(r.visits, ["trip_id"], "seq", "boardings", "alightings").select("trip_id", "seq", "onboard_arrival", "onboard_departure")


portable("w13_adjacent_overlap", "SELECT passenger_id, trip_id FROM (SELECT passenger_id, trip_id, scheduled_s, lead(scheduled_s) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS next_s FROM trips) q WHERE next_s < scheduled_s + 864000")
portable("w14_plan_chain", "SELECT passenger_id, trip_id, scheduled_s AS from_s, lead(scheduled_s) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS to_s FROM trips")


@query("j01_trip_context", """SELECT o.row_id, o.route_id, c.context_id, p.segment FROM observations o LEFT JOIN contexts c ON c.route_id = o.route_id AND o.at_s BETWEEN c.starts_s AND c.ends_s AND c.known_s <= o.at_s LEFT JOIN passengers p ON p.passenger_id = o.route_id""")
def trip_context(r: Roles) -> DataFrame:
    c = r.contexts.select("context_id", "route_id", "starts_s", "ends_s", "known_s")
    x = intervals.left_pairs(r.observations, c, [("route_id", "route_id")], "row_id", "at_s", "starts_s", "ends_s", known="known_s")
    p = r.passengers.select(F.col("passenger_id"), "segment")
    return x.join(p, x["route_id"] == p["passenger_id"], "left").select("row_id", "route_id", "context_id", "segment")


CONTEXT_SCOPES = [("route_id", "route_id"), ("row_id", "stop_id")]  #: a context acts on a route or on a stop


@query("j06_active_contexts", """SELECT o.row_id, CAST(count(DISTINCT c.context_id) AS BIGINT) AS active_contexts FROM observations o LEFT JOIN contexts c ON (c.route_id = o.route_id OR c.stop_id = o.row_id) AND o.at_s BETWEEN c.starts_s AND c.ends_s AND c.known_s <= o.at_s GROUP BY o.row_id""")
def active_contexts(r: Roles) -> DataFrame:
    x = intervals.active_counts(r.observations, r.contexts, "row_id", CONTEXT_SCOPES, "context_id", "at_s", "starts_s", "ends_s", known="known_s")
    return x.select("row_id", F.col("n").alias("active_contexts"))


VERSIONS = "v AS (SELECT route_id, row_id AS version, at_s AS from_s, lead(at_s) OVER (PARTITION BY route_id ORDER BY at_s, row_id) AS to_s FROM observations WHERE kind = 'signup')"


@query("j23_plan_at_cutoff", f"WITH {VERSIONS} SELECT o.row_id, v.version FROM observations o LEFT JOIN v ON v.route_id = o.route_id AND v.from_s <= o.at_s AND o.at_s < coalesce(v.to_s, 9000000000000)")
def plan_at_cutoff(r: Roles) -> DataFrame:
    s = r.observations.filter("kind = 'signup'")
    v = s.select("route_id", F.col("row_id").alias("version"), F.col("at_s").alias("from_s"), F.lead("at_s").over(Window.partitionBy("route_id").orderBy("at_s", "row_id")).alias("to_s"))
    q = r.observations.select("row_id", "route_id", "at_s")
    return intervals.left_pairs(q, v, [("route_id", "route_id")], "row_id", "at_s", "from_s", "to_s", closed=False, open_end=True, width=86_400).select("row_id", "version")


@query("t02_value_as_of", """SELECT q.row_id, round(max(CASE WHEN r = 1 THEN target END), 6) AS target FROM (SELECT q.row_id, o.target, row_number() OVER (PARTITION BY q.row_id ORDER BY o.row_id DESC) AS r FROM observations q LEFT JOIN observations o ON o.route_id = q.route_id AND o.available_s <= q.at_s WHERE q.kind = 'purchase') q GROUP BY q.row_id""")
def value_as_of(r: Roles) -> DataFrame:
    q = r.observations.filter("kind = 'purchase'").select(F.col("row_id"), F.col("route_id"), F.col("at_s"))
    rev = r.observations.select(F.col("route_id"), F.col("available_s"), "target", F.col("row_id").alias("revision"))
    return asof.value_as_of(rev, q, "route_id", "at_s", "available_s", "target", "revision", "row_id").select("row_id", F.round("target", 6).alias("target"))


@query("t01_late_promotion", "SELECT q.row_id, CAST(sum(CASE WHEN o.available_s > q.at_s THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN o.available_s <= q.at_s THEN 1 ELSE 0 END) AS BIGINT) AS promoted FROM observations q JOIN observations o ON o.route_id = q.route_id AND o.at_s < q.at_s GROUP BY q.row_id")
def late_promotion(r: Roles) -> DataFrame:
    return asof.late_promotion(r.observations, "route_id", "row_id", "at_s", "available_s")


portable("t03_continuity_with_gaps", "SELECT trip_id, seq, CASE WHEN seq - before > 1 THEN 'FORGIVEN' WHEN before IS NULL THEN 'START' WHEN boardings >= carried THEN 'CONTINUOUS' ELSE 'BROKEN' END AS state FROM (SELECT trip_id, seq, boardings, lag(seq) OVER (PARTITION BY trip_id ORDER BY seq) AS before, lag(alightings) OVER (PARTITION BY trip_id ORDER BY seq) AS carried FROM visits) q")
portable("t04_inversions", "SELECT trip_id, CAST(max(seq) AS BIGINT) AS last_seq, CAST(sum(CASE WHEN actual_s < before THEN 1 ELSE 0 END) AS BIGINT) AS inversions FROM (SELECT trip_id, seq, actual_s, lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q GROUP BY trip_id")
portable("t05_horizon_purge", "SELECT trip_id, CASE WHEN service_date < DATE '1999-01-01' AND scheduled_s + 604800 >= 915148800 THEN true WHEN service_date >= DATE '1999-01-01' AND service_date < DATE '2000-01-01' AND scheduled_s + 604800 >= 946684800 THEN true ELSE false END AS purged FROM trips")

@query("j24_buffered_overlap", "SELECT a.trip_id, count(*) AS clashes FROM spine a JOIN spine b ON a.vehicle_id = b.vehicle_id AND a.scheduled_s < b.actual_s + 3600 AND b.scheduled_s < a.actual_s + 3600 AND a.trip_id <> b.trip_id WHERE a.actual_s > a.scheduled_s AND b.actual_s > b.scheduled_s GROUP BY a.trip_id")
def buffered_overlap(r: Roles) -> DataFrame:
    return asof.overlap_counts(r.spine, "vehicle_id", "trip_id", "scheduled_s", "actual_s", 3600, 86_400 * 30)


@query("j25_least_context", """SELECT o.row_id, min(c.context_id) AS context_id FROM observations o LEFT JOIN contexts c ON o.at_s BETWEEN c.starts_s AND c.ends_s AND (c.route_id = o.route_id OR c.stop_id = o.row_id) GROUP BY o.row_id""")
def least_context(r: Roles) -> DataFrame:
    o = r.observations.select("row_id", "route_id", "at_s")
    hit = None
    for scope in CONTEXT_SCOPES:
        c = r.contexts.select("context_id", F.col(scope[1]).alias("_scope"), "starts_s", "ends_s")
        part = intervals.pairs(o, c, [(scope[0], "_scope")], "at_s", "starts_s", "ends_s").select("row_id", "context_id")
        hit = part if hit is None else hit.unionByName(part)
    return o.select("row_id").join(hit.groupBy("row_id").agg(F.min("context_id").alias("context_id")), "row_id", "left").select("row_id", "context_id")
