"""Projections, filters, joins, set operations, ordering, sampling and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import asof, eligibility, intervals, joins, transit, windows
from korridor.plans.registry import portable, query
from korridor.roles import Roles

DELAY = "greatest(0, actual_s - scheduled_s)"
YEAR_1996 = (820_454_400, 852_076_800)  # seconds


# projections and filters
@query("p01_required_columns", "SELECT trip_id, route_id FROM trips")
def required_columns(r: Roles) -> DataFrame:
    return joins.require(r.trips, ["trip_id", "route_id"]).select("trip_id", "route_id")


portable("p02_rename_on_project", "SELECT t.trip_id, t.status AS trip_status, t.route_id AS trip_route_id, p.route_id AS passenger_route_id FROM trips t JOIN passengers p ON p.passenger_id = t.passenger_id")


@query("p03_splits", "SELECT trip_id, CASE WHEN service_date < DATE '1999-01-01' THEN 'train' WHEN service_date < DATE '2000-01-01' THEN 'validation' WHEN service_date < DATE '2001-01-01' THEN 'test' END AS split FROM trips")
def splits(r: Roles) -> DataFrame:
    return r.trips.select("trip_id", transit.splits("service_date", "1999-01-01", "2000-01-01", "2001-01-01").alias("split"))


portable("p04_split_label", "SELECT DISTINCT service_date, CASE WHEN service_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN service_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'validation' WHEN service_date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 'test' END AS split FROM trips")


def delay_candidates(r: Roles) -> DataFrame:
    """The spine with its delay label, calendar features and when each fact was known."""
    day = F.floor(F.col("scheduled_s") / 86_400)
    return r.spine.select(
        "service_date", "trip_id", "seq", "scheduled_s", F.col("scheduled_s").alias("cutoff_s"), (F.col("scheduled_s") - 86_400).alias("known_s"), (F.col("actual_s") + 60).alias("target_available_s"),
        transit.severity(transit.positive_delay("actual_s", "scheduled_s"), (0, 864_000, 2_592_000, 7_776_000)).alias("label"),
        (F.floor(F.col("scheduled_s") / 3600) % 24).cast("double").alias("hour"), ((day + 3) % 7 + 1).cast("double").alias("weekday"), F.month("service_date").cast("double").alias("month"), F.when(F.col("direction") == "A", 0.0).when(F.col("direction") == "N", 1.0).alias("direction_id"), F.col("boardings").cast("double").alias("distance"),
    )


@query("p05_delay_eligibility", "SELECT trip_id, seq FROM spine WHERE direction IN ('A', 'N') AND actual_s IS NOT NULL AND scheduled_s >= 820454400 AND scheduled_s < 852076800 AND actual_s + 60 >= scheduled_s AND actual_s + 60 <= 852076800")
def delay_eligibility(r: Roles) -> DataFrame:
    return eligibility.eligible(delay_candidates(r), eligibility.delay(transit.LABELS, *YEAR_1996)).select("trip_id", "seq")


@query("p05_exclusion_reasons", """SELECT unnest(['label known', 'begins inside', 'outcome after', 'outcome inside', 'direction_id finite']) AS reason, unnest([count(*) FILTER (actual_s IS NULL OR scheduled_s IS NULL), count(*) FILTER (NOT (scheduled_s >= 820454400 AND scheduled_s < 852076800)), count(*) FILTER (actual_s + 60 < scheduled_s), count(*) FILTER (actual_s + 60 > 852076800), count(*) FILTER (direction = 'R')]) AS n FROM spine""")
def exclusion_reasons(r: Roles) -> DataFrame:
    """How many rows each condition that excludes any, and three more, excludes."""
    x = eligibility.reasons(delay_candidates(r), eligibility.delay(transit.LABELS, *YEAR_1996))
    return x.filter("n > 0 OR reason IN ('label known', 'begins inside', 'outcome after', 'outcome inside', 'direction_id finite')")
portable("p06_demand_eligibility", "SELECT row_id FROM observations WHERE available_s > at_s AND target >= 0 AND target < 1e300")


def occupancy_candidates(r: Roles) -> DataFrame:
    """The spine with what is recorded of each departure's vehicle and when each fact was known."""
    ratio = F.when(F.col("capacity") > 0, F.col("boardings").cast("double") / F.col("capacity").cast("double"))
    v = r.vehicles.select("vehicle_id", F.col("capacity").alias("assignment_capacity"))
    return r.spine.join(v, "vehicle_id", "left").select(
        "service_date", "seq", "stop_id", "route_id", "direction", "trip_id", "actual_s", "capacity", "assignment_capacity", F.col("scheduled_s").alias("cutoff_s"), (F.col("actual_s") + 60).alias("event_available_s"), (F.col("actual_s") + 60).alias("assignment_available_s"),
        F.when(F.col("direction") == "R", "SUSPECT").otherwise("VALID").alias("assignment_quality"), F.when(F.col("status") == "P", "PLANNED").otherwise("ACTUAL").alias("assignment_kind"), (F.col("scheduled_s") - 86_400).alias("known_s"), (F.col("scheduled_s") - 86_400).alias("schedule_known_s"),
        (F.col("scheduled_s") - 172_800).alias("route_known_s"), (F.col("scheduled_s") - 172_800).alias("stop_known_s"), (F.col("scheduled_s") - 604_800).alias("pattern_published_s"), (F.col("scheduled_s") - 86_400).alias("offsets_known_s"), (F.col("actual_s") + 300).alias("load_available_s"),
        F.col("scheduled_s").alias("assignment_start_s"), (F.col("scheduled_s") + 31_536_000).alias("assignment_end_s"), F.when(F.col("capacity") > 0, "AVAILABLE").otherwise("UNAVAILABLE").alias("occupancy_status"), F.col("boardings").alias("load"), ratio.alias("utilization"), (ratio > 1.0).alias("over_capacity"),
        F.col("boardings").cast("double").alias("distance"), F.col("seq").alias("stop_sequence"),
    )


@query("p07_occupancy_eligibility", f"""SELECT s.trip_id, s.seq FROM spine s JOIN vehicles h ON h.vehicle_id = s.vehicle_id
WHERE s.route_id IS NOT NULL AND s.stop_id IS NOT NULL AND s.direction IN ('A', 'N') AND s.status IN ('O', 'F') AND h.capacity > 0 AND s.capacity = h.capacity AND s.boardings >= 0 AND s.actual_s > s.scheduled_s AND s.actual_s < s.scheduled_s + 31536000
AND s.scheduled_s BETWEEN {YEAR_1996[0]} AND {YEAR_1996[1] - 1} AND s.actual_s + 300 <= {YEAR_1996[1]}""")
def occupancy_eligibility(r: Roles) -> DataFrame:
    return eligibility.eligible(occupancy_candidates(r), eligibility.occupancy(*YEAR_1996)).select("trip_id", "seq")
portable("p08_finite_profiles", "SELECT route_id, direction FROM spine GROUP BY route_id, direction HAVING avg(boardings) IS NOT NULL AND avg(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END) < 1e300")
portable("p09_consistent_parents", "SELECT v.trip_id, v.seq FROM visits v JOIN trips t ON t.trip_id = v.trip_id JOIN passengers p ON p.passenger_id = t.passenger_id AND p.route_id = t.route_id WHERE t.status = 'O' AND t.service_date >= DATE '1996-01-01'")


@query("p10_clean_rows", "SELECT trip_id FROM trips t WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.trip_id = t.trip_id AND v.direction = 'R') OR t.status = 'F'")
def clean_rows(r: Roles) -> DataFrame:
    return joins.exclude(r.trips, r.visits.filter("direction = 'R'"), "trip_id", accept=F.col("status") == "F").select("trip_id")


portable("p11_text_and_days", "SELECT vehicle_id, operator FROM vehicles WHERE lower(vehicle_type) LIKE '%steel%' AND vehicle_id IN (SELECT v.vehicle_id FROM visits v JOIN trips t ON t.trip_id = v.trip_id WHERE t.service_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')")


@query("p12_catalog_search", "SELECT stop_id FROM stops WHERE contains(lower(concat_ws(' ', stop_id, stop_code, zone_id)), '00001')")
def catalog_search(r: Roles) -> DataFrame:
    return r.stops.filter(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("stop_id", "stop_code", "zone_id")))).contains("00001")).select("stop_id")


@query("p13_serving_filter", "SELECT trip_id FROM trips WHERE status = 'O' AND priority = '1-URGENT' AND scheduled_s < 852076800 AND scheduled_s + 86400 > 820454400")
def serving_filter(r: Roles) -> DataFrame:
    return joins.serving_filter(r.trips, {"status": "O", "priority": "1-URGENT", "route_id": None}, "scheduled_s", F.col("scheduled_s") + 86400, 820454400, 852076800).select("trip_id")


portable("p14_allowed_filters", "SELECT trip_id FROM trips WHERE status IN ('O', 'F') AND route_id IN (1, 2, 3)")

# joins
portable("j02_trip_operations", f"SELECT t.trip_id, v.seq, v.stop_id, {DELAY} AS delay_s, h.capacity FROM trips t LEFT JOIN visits v ON v.trip_id = t.trip_id LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id")
portable("j03_demand_operations", "SELECT o.row_id, o.kind, p.segment, t.trip_id FROM observations o LEFT JOIN passengers p ON p.passenger_id = o.route_id LEFT JOIN (SELECT passenger_id, max(trip_id) AS trip_id FROM trips WHERE status <> 'P' GROUP BY passenger_id) t ON t.passenger_id = o.route_id")


@query("j04_operation_spine", f"SELECT v.trip_id, v.seq, t.route_id, n.route_code, n.mode, s.stop_code, h.vehicle_type, p.segment, {DELAY} AS delay_s, CASE WHEN v.actual_s IS NOT NULL AND t.scheduled_s IS NOT NULL THEN greatest(v.actual_s, t.scheduled_s) END AS known_s FROM visits v LEFT JOIN trips t ON t.trip_id = v.trip_id LEFT JOIN passengers p ON p.passenger_id = t.passenger_id LEFT JOIN routes n ON n.route_id = t.route_id LEFT JOIN stops s ON s.stop_id = v.stop_id LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id")
def operation_spine(r: Roles) -> DataFrame:
    x = r.visits.join(r.trips, "trip_id", "left").join(r.passengers.select("passenger_id", "segment"), "passenger_id", "left").join(r.routes, "route_id", "left")
    x = x.join(r.stops.select("stop_id", "stop_code"), "stop_id", "left").join(r.vehicles.select("vehicle_id", "vehicle_type"), "vehicle_id", "left")
    return x.select("trip_id", "seq", "route_id", "route_code", "mode", "stop_code", "vehicle_type", "segment", transit.positive_delay("actual_s", "scheduled_s").alias("delay_s"), transit.known_at("actual_s", "scheduled_s").alias("known_s"))


portable("j05_planned_vehicle", "SELECT v.trip_id, v.seq, h.operator FROM visits v LEFT JOIN (SELECT trip_id, vehicle_id FROM visits WHERE seq = 1) p ON p.trip_id = v.trip_id LEFT JOIN vehicles h ON h.vehicle_id = p.vehicle_id")


@query("j07_trip_demand", "SELECT t.trip_id, d.demand, p.segment, n.route_code FROM (SELECT trip_id, CAST(sum(boardings) AS BIGINT) AS demand FROM visits GROUP BY trip_id) d JOIN trips t ON t.trip_id = d.trip_id LEFT JOIN passengers p ON p.passenger_id = t.passenger_id LEFT JOIN routes n ON n.route_id = t.route_id")
def trip_demand(r: Roles) -> DataFrame:
    d = r.visits.groupBy("trip_id").agg(F.sum("boardings").alias("demand"))
    return d.join(r.trips, "trip_id").join(r.passengers.select("passenger_id", "segment"), "passenger_id", "left").join(r.routes.select("route_id", "route_code"), "route_id", "left").select("trip_id", "demand", "segment", "route_code")


@query("j08_checked_join", "SELECT v.trip_id, v.seq, CASE WHEN h.vehicle_id IS NULL THEN 'left_only' ELSE 'both' END AS join_status FROM visits v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id AND h.vehicle_id % 7 <> 0")
def checked_join(r: Roles) -> DataFrame:
    return joins.checked_join(r.visits, r.vehicles.filter("vehicle_id % 7 <> 0"), "vehicle_id", "many_to_one").select("trip_id", "seq", "join_status")


@query("j09_integration_joins", """SELECT 'trips_passengers' AS pair, count(*) AS n, count(p.passenger_id) AS matched FROM trips t LEFT JOIN passengers p ON p.passenger_id = t.passenger_id
UNION ALL SELECT 'trips_routes', count(*), count(n.route_id) FROM trips t LEFT JOIN routes n ON n.route_id = t.route_id
UNION ALL SELECT 'visits_trips', count(*), count(t.trip_id) FROM visits v LEFT JOIN trips t ON t.trip_id = v.trip_id
UNION ALL SELECT 'visits_stops', count(*), count(s.stop_id) FROM visits v LEFT JOIN stops s ON s.stop_id = v.stop_id
UNION ALL SELECT 'visits_vehicles', count(*), count(h.vehicle_id) FROM visits v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id
UNION ALL SELECT 'routes_trips', count(*), count(t.route_id) FROM routes n LEFT JOIN trips t ON n.route_id = t.route_id
UNION ALL SELECT 'trips_visits', count(*), count(v.trip_id) FROM trips t LEFT JOIN visits v ON t.trip_id = v.trip_id
UNION ALL SELECT 'stops_visits', count(*), count(v.stop_id) FROM stops s LEFT JOIN visits v ON s.stop_id = v.stop_id
UNION ALL SELECT 'observations_passengers', count(*), count(p.passenger_id) FROM observations o LEFT JOIN passengers p ON p.passenger_id = o.route_id""")
def integration_joins(r: Roles) -> DataFrame:
    pairs = [("trips", "passengers", "passenger_id"), ("trips", "routes", "route_id"), ("visits", "trips", "trip_id"), ("visits", "stops", "stop_id"), ("visits", "vehicles", "vehicle_id"), ("routes", "trips", "route_id"), ("trips", "visits", "trip_id"), ("stops", "visits", "stop_id")]
    out = None
    for one, other, key in pairs:
        part = joins.matched(getattr(r, one), getattr(r, other), key, key, f"{one}_{other}")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(joins.matched(r.observations, r.passengers, "route_id", "passenger_id", "observations_passengers"))


portable("j10_occupancy_assignment", "SELECT v.trip_id, v.seq, CASE WHEN h.capacity > 0 THEN round(CAST(v.boardings AS DOUBLE) / h.capacity, 6) END AS utilization FROM visits v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id")
@query("j11_prediction_history", "SELECT a.stop_id, a.trip_id, b.trip_id AS past_trip FROM spine a JOIN spine b ON a.stop_id = b.stop_id AND a.vehicle_id = b.vehicle_id AND b.actual_s < a.scheduled_s AND b.seq = a.seq AND b.boardings > 0")
def prediction_history(r: Roles) -> DataFrame:
    """Every earlier visit, as the operator it stands for lists them: its output grows with the square of a key's visits."""
    x = r.spine.select("trip_id", "stop_id", "vehicle_id", "seq", "scheduled_s", "actual_s", "boardings")
    past = x.filter("boardings > 0").select("stop_id", "vehicle_id", "seq", F.col("trip_id").alias("past_trip"), F.col("actual_s").alias("past_s"))
    return x.join(past, ["stop_id", "vehicle_id", "seq"]).filter("past_s < scheduled_s").select("stop_id", "trip_id", "past_trip")


@query("j11_recent_history", """WITH p AS (SELECT a.trip_id, a.seq, b.trip_id AS past_trip, b.boardings, row_number() OVER (PARTITION BY a.trip_id, a.seq ORDER BY b.actual_s DESC, b.trip_id DESC) AS n FROM spine a JOIN spine b ON a.stop_id = b.stop_id AND b.actual_s < a.scheduled_s AND b.boardings > 0)
SELECT a.trip_id, a.seq, CAST(coalesce(h.visits, 0) AS BIGINT) AS visits, round(h.mean_boardings, 6) AS mean_boardings, h.latest FROM spine a LEFT JOIN (SELECT trip_id, seq, max(n) AS visits, avg(boardings) AS mean_boardings, string_agg(CASE WHEN n <= 3 THEN CAST(past_trip AS VARCHAR) END, ',' ORDER BY n) AS latest FROM p GROUP BY trip_id, seq) h ON h.trip_id = a.trip_id AND h.seq = a.seq""")
def recent_history(r: Roles) -> DataFrame:
    """The same history as a state per stop: how many earlier visits, their mean, and the last three; as many rows as visits."""
    x = asof.earlier(r.spine.withColumn("_row", F.struct("trip_id", "seq")), ["stop_id"], "_row", "scheduled_s", "actual_s", F.col("boardings") > 0, ["boardings"], ["trip_id"], 3, 86_400 * 30, 2 * r.parts)
    return x.select("_row.trip_id", "_row.seq", "visits", F.when(F.col("visits") > 0, F.round(F.try_divide("sum_boardings", "visits"), 6)).alias("mean_boardings"), F.when(F.col("visits") > 0, F.array_join(F.transform("latest", lambda v: v["trip_id"].cast("string")), ",")).alias("latest"))


portable("j12_profile_join", "SELECT o.route_id, o.direction, o.load, d.demand FROM (SELECT route_id, direction, round(avg(boardings), 6) AS load FROM spine GROUP BY route_id, direction) o JOIN (SELECT route_id, direction, CAST(sum(alightings) AS BIGINT) AS demand FROM spine GROUP BY route_id, direction) d ON d.route_id = o.route_id AND d.direction = o.direction")
portable("j13_route_metrics", "SELECT n.route_id, n.route_code, f.n, d.passengers_n FROM routes n LEFT JOIN (SELECT route_id, count(*) AS n FROM trips GROUP BY route_id) f ON f.route_id = n.route_id LEFT JOIN (SELECT route_id, count(*) AS passengers_n FROM passengers GROUP BY route_id) d ON d.route_id = n.route_id")


@query("j14_semi_and_anti", "SELECT trip_id, EXISTS (SELECT 1 FROM visits v WHERE v.trip_id = t.trip_id) AS has_visits FROM trips t")
def semi_and_anti(r: Roles) -> DataFrame:
    """Whether each trip has a visit: every line belongs to one, so lines are asked, and once for both answers."""
    one, other = r.trips.select("trip_id"), r.lines.groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.lit(True).alias("has_visits"))
    return one.join(other, "trip_id", "left").select("trip_id", F.coalesce("has_visits", F.lit(False)).alias("has_visits"))


portable("j15_invalid_references", "SELECT o.row_id FROM observations o WHERE o.row_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trips t WHERE t.trip_id = o.row_id)")
portable("j16_predecessors", "SELECT t.trip_id, p.trip_id AS predecessor, p.scheduled_s >= t.scheduled_s AS violated FROM trips t JOIN trips p ON p.trip_id = t.trip_id - 1")
portable("j17_counts_compared", "SELECT t.trip_id, coalesce(c.n, 0) AS visits_n FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n FROM visits GROUP BY trip_id) c ON c.trip_id = t.trip_id WHERE coalesce(c.n, 0) <> 4")


@query("j18_scoped_exists", "SELECT row_id, EXISTS (SELECT 1 FROM contexts c WHERE o.at_s BETWEEN c.starts_s AND c.ends_s AND (c.route_id = o.route_id OR c.stop_id = o.row_id)) AS disturbed FROM observations o")
def scoped_exists(r: Roles) -> DataFrame:
    n = intervals.active_counts(r.observations, r.contexts, "row_id", [("route_id", "route_id"), ("row_id", "stop_id")], "context_id", "at_s", "starts_s", "ends_s")
    return n.select("row_id", (F.col("n") > 0).alias("disturbed"))


portable("j19_null_safe", "SELECT a.trip_id, a.seq FROM spine a JOIN spine b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE a.capacity IS DISTINCT FROM b.capacity")


@query("j20_outer_alignment", "SELECT coalesce(a.trip_id, b.trip_id) AS trip_id, CASE WHEN b.trip_id IS NULL THEN 'left_only' WHEN a.trip_id IS NULL THEN 'right_only' ELSE 'both' END AS side FROM (SELECT trip_id FROM trips WHERE status <> 'P') a FULL JOIN (SELECT DISTINCT trip_id FROM visits WHERE direction = 'N') b ON a.trip_id = b.trip_id")
def outer_alignment(r: Roles) -> DataFrame:
    return joins.aligned(r.trips.filter("status <> 'P'").select("trip_id"), r.visits.filter("direction = 'N'").select("trip_id").distinct(), "trip_id")


portable("j21_loads_and_delays", f"SELECT coalesce(l.route_id, d.route_id) AS route_id, l.peak, d.delays FROM (SELECT route_id, max(boardings) AS peak FROM spine WHERE boardings > 30 GROUP BY route_id) l FULL JOIN (SELECT route_id, count(*) AS delays FROM spine WHERE {DELAY} > 31536000 GROUP BY route_id) d ON d.route_id = l.route_id")


portable("u01_union_by_name", "SELECT 'EARLY' AS rule, trip_id, seq FROM spine WHERE actual_s < scheduled_s UNION ALL SELECT 'OVERLOAD', trip_id, seq FROM spine WHERE boardings > capacity")
portable("u02_tagged_splits", "SELECT 'train' AS split, trip_id FROM trips WHERE service_date < DATE '1999-01-01' UNION ALL SELECT 'validation', trip_id FROM trips WHERE service_date >= DATE '1999-01-01' AND service_date < DATE '2000-01-01'")
portable("u03_union_distinct", "SELECT route_id, stop_id FROM spine WHERE seq = 1 UNION SELECT route_id, stop_id FROM spine WHERE seq = 2")
portable("u04_intersect_except", "SELECT 'shared' AS side, passenger_id FROM (SELECT passenger_id FROM trips WHERE status = 'O' INTERSECT SELECT passenger_id FROM trips WHERE status = 'P') a UNION ALL SELECT 'only', passenger_id FROM (SELECT passenger_id FROM trips WHERE status = 'O' EXCEPT SELECT passenger_id FROM trips WHERE status = 'P') b")
portable("u05_subset_check", "SELECT count(*) AS outside FROM (SELECT route_id FROM trips WHERE status = 'P' EXCEPT SELECT route_id FROM trips WHERE status = 'O') q")
portable("u06_duplicate_ledger", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey GROUP BY a.l_orderkey, a.l_linenumber")

# order, limits, samples
portable("o01_sorted_scan", "SELECT trip_id, seq, row_number() OVER (PARTITION BY route_id ORDER BY scheduled_s NULLS FIRST, trip_id, seq) AS place FROM spine")


@query("o02_hashed_top_n", "SELECT trip_id FROM trips ORDER BY sha256('20260926|' || trip_id), trip_id LIMIT 500")
def hashed_top_n(r: Roles) -> DataFrame:
    return r.trips.select("trip_id").orderBy(scalars.rank_digest("20260926", "trip_id"), "trip_id").limit(500)


@query("o03_stratified_sample", "SELECT status, trip_id FROM (SELECT status, trip_id, row_number() OVER (PARTITION BY status ORDER BY sha256('7|' || trip_id), trip_id) AS n FROM trips) q WHERE n <= 40")
def stratified_sample(r: Roles) -> DataFrame:
    return windows.ranked_sample(r.trips, ["status"], 40, ["trip_id"], "7").select("status", "trip_id")


@query("o04_largest_remainder", """WITH g AS (SELECT route_id AS k, count(*) AS n FROM spine GROUP BY route_id), b AS (SELECT *, least(n, 20) AS base, least(1000, sum(n) OVER ()) - sum(least(n, 20)) OVER () AS free, sum(n) OVER () - sum(least(n, 20)) OVER () AS left_n FROM g),
s AS (SELECT *, CASE WHEN left_n > 0 AND free > 0 THEN (n - base)::DOUBLE * free / left_n ELSE 0 END AS share FROM b), f AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, k) AS r FROM s)
SELECT k, n, CAST(base + whole + CASE WHEN base + whole < n AND r <= greatest(free, 0) - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def largest_remainder(r: Roles) -> DataFrame:
    """A thousand rows by route, at least twenty of each route that has them."""
    return windows.largest_remainder(r.spine.groupBy(F.col("route_id").alias("k")).agg(F.count("*").alias("n")), [], "n", 1000, "k", minimum=20)


@query("o05_proportional_quota", """WITH g AS (SELECT direction AS k, count(*) AS n FROM spine GROUP BY direction), b AS (SELECT *, least(777, sum(n) OVER ()) AS seats FROM g), q AS (SELECT *, greatest(1, round_even(seats * n / sum(n) OVER (), 0))::BIGINT AS q FROM b),
d AS (SELECT *, sum(q) OVER () - seats AS over FROM q),
taken AS (SELECT k, count(*) AS t FROM (SELECT k, over, row_number() OVER (ORDER BY v DESC, k DESC) AS r FROM (SELECT k, over, unnest(range(2, q + 1)) AS v FROM d) u) z WHERE r <= over GROUP BY k),
added AS (SELECT k, count(*) AS t FROM (SELECT k, over, row_number() OVER (ORDER BY v DESC, k) AS r FROM (SELECT k, over, unnest(range(greatest(1, n - q - 777), n - q + 1)) AS v FROM d) u) z WHERE r <= -over GROUP BY k)
SELECT d.k, d.n, CAST(d.q - coalesce(taken.t, 0) + coalesce(added.t, 0) AS BIGINT) AS quota FROM d LEFT JOIN taken ON taken.k = d.k LEFT JOIN added ON added.k = d.k""")
def proportional_quota(r: Roles) -> DataFrame:
    return windows.rounded_quotas(r.spine.groupBy(F.col("direction").alias("k")).agg(F.count("*").alias("n")), "n", 777, "k")


@query("o06_existence_probe", "SELECT EXISTS (SELECT 1 FROM spine WHERE actual_s < scheduled_s) AS any_early, EXISTS (SELECT 1 FROM spine WHERE boardings < 0) AS any_negative")
def existence_probe(r: Roles) -> DataFrame:
    """Probes on raw lines, file by file while none has a hit: a visit is early if a line of it is, and negative only if a line is.

    The lines' least and greatest trip bound what is read of the trips; a negative quantity is looked
    for in files whose statistics allow one, and visits are only added up if there is any.
    """
    lines, orders = r.table("lineitem"), r.table("orders").select("o_orderkey", "o_orderdate")

    def early(some: DataFrame) -> DataFrame:
        x = some.select("l_orderkey", "l_shipdate")
        low, high = x.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
        trips = orders.filter(F.col("o_orderkey").between(low, high))
        return x.join(trips, (x["l_orderkey"] == trips["o_orderkey"]) & (x["l_shipdate"] < trips["o_orderdate"])).select("l_orderkey")

    negative = joins.any_row(lines, lambda some: some.filter("l_quantity < 0").select("l_orderkey"))
    found = (joins.any_row(lines, early), negative and not r.spine.filter("boardings < 0").select("trip_id").isEmpty())
    return r.spark.createDataFrame([found], "any_early boolean, any_negative boolean")


portable("o07_latest_result", "SELECT trip_id, scheduled_s FROM trips WHERE route_id = 3 ORDER BY scheduled_s DESC, trip_id DESC LIMIT 1")


@query("o08_page_with_total", "SELECT trip_id, (SELECT count(*) FROM trips) AS total FROM trips ORDER BY trip_id LIMIT 50 OFFSET 100")
def page_with_total(r: Roles) -> DataFrame:
    total = r.trips.agg(F.count("*").alias("total"))
    return r.trips.select("trip_id").orderBy("trip_id").offset(100).limit(50).crossJoin(F.broadcast(total))  # one row


portable("o09_priority_order", "SELECT trip_id, CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS place FROM trips ORDER BY 2, trip_id")
portable("o10_best_model", "SELECT direction AS model, round(avg(boardings), 6) AS metric FROM spine GROUP BY direction ORDER BY 2, 1 LIMIT 1")
portable("o11_profile_summary", "SELECT count(*) AS n, count(capacity) AS capacity_n, min(boardings) AS least, max(boardings) AS most, round(avg(boardings), 6) AS mean, round(stddev_samp(boardings), 6) AS spread, count(DISTINCT stop_id) AS stops_n FROM spine")


@query("o12_seeded_sample", "SELECT row_id FROM observations ORDER BY sha256('500|' || row_id), row_id LIMIT 500")
def seeded_sample(r: Roles) -> DataFrame:
    return r.observations.select("row_id").orderBy(scalars.rank_digest("500", "row_id"), "row_id").limit(500)


# scalar functions
@query("f01_dates", """SELECT trip_id, CAST(scheduled_s + 3600 AS BIGINT) AS later_s, hour(o_orderdate) AS h, month(o_orderdate) AS m, isodow(o_orderdate) AS weekday, isodow(o_orderdate) >= 6 AS weekend, CAST((floor((scheduled_s + 18000) / 3600)) % 24 AS BIGINT) AS local_hour, strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS shifted FROM trips JOIN orders ON o_orderkey = trip_id""")
def dates(r: Roles) -> DataFrame:
    o = r.table("orders").select(F.col("o_orderkey").alias("trip_id"), "o_orderdate")
    d = F.col("o_orderdate")
    return r.trips.join(o, "trip_id").select("trip_id", (F.col("scheduled_s") + 3600).alias("later_s"), F.hour(d).alias("h"), F.month(d).alias("m"), (F.weekday(d) + 1).alias("weekday"), (F.weekday(d) >= 5).alias("weekend"), transit.hour("scheduled_s", 18000).alias("local_hour"), F.date_format(d, "yyyy-MM").alias("month_key"), F.date_format(d - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("shifted"))


@query("f03_epoch_difference", "SELECT trip_id, seq, actual_s - scheduled_s AS signed_s, greatest(0, actual_s - scheduled_s) AS positive_s FROM spine")
def epoch_difference(r: Roles) -> DataFrame:
    return r.spine.select("trip_id", "seq", (F.col("actual_s") - F.col("scheduled_s")).alias("signed_s"), transit.positive_delay("actual_s", "scheduled_s").alias("positive_s"))


@query("f04_try_parse", "SELECT trip_id, CAST(TRY_CAST(CASE WHEN trip_id % 5 = 0 THEN '2025-13-99' ELSE CAST(service_date AS VARCHAR) END AS DATE) AS VARCHAR) AS parsed FROM trips")
def try_parse(r: Roles) -> DataFrame:
    text = F.when(F.col("trip_id") % 5 == 0, "2025-13-99").otherwise(F.col("service_date").cast("string"))
    return r.trips.select("trip_id", text.alias("text")).select("trip_id", F.expr("cast(try_cast(text as date) as string)").alias("parsed"))


portable("f10_null_rules", "SELECT trip_id, seq, coalesce(capacity, -1) AS filled, CASE WHEN capacity IS NOT NULL AND boardings IS NOT NULL THEN greatest(capacity, boardings) END AS guarded, CASE WHEN capacity > 0 THEN round(CAST(boardings AS DOUBLE) / capacity, 6) END AS ratio FROM spine")
portable("f12_finite", "SELECT row_id, target IS NOT NULL AND target = target AND abs(target) < 1e308 AS finite FROM observations")


@query("f13_binned", "SELECT trip_id, seq, CASE WHEN boardings <= 10 THEN 'ON_TIME' WHEN boardings <= 20 THEN 'MINOR_DELAY' WHEN boardings <= 30 THEN 'MODERATE_DELAY' WHEN boardings <= 40 THEN 'MAJOR_DELAY' ELSE 'SEVERE_DELAY' END AS bin FROM visits")
def binned(r: Roles) -> DataFrame:
    return r.visits.select("trip_id", "seq", transit.severity(F.col("boardings"), (10, 20, 30, 40)).alias("bin"))


@query("f14_geo", "SELECT a.stop_id, round(sqrt(power((a.zone_id - b.zone_id) * 111.0, 2) + power((a.stop_id - b.stop_id) * 104.0, 2)), 6) AS km, round(a.zone_id + (b.zone_id - a.zone_id) * least(1.0, greatest(0.0, a.stop_id::DOUBLE / 50)), 6) AS between_zone FROM stops a JOIN stops b ON b.stop_id = a.stop_id + 1")
def geo(r: Roles) -> DataFrame:
    a, b = r.stops.alias("a"), r.stops.alias("b")
    km = scalars.equirectangular("a.zone_id", "a.stop_id", "b.zone_id", "b.stop_id")
    mid = scalars.interpolate(F.col("a.zone_id"), F.col("b.zone_id"), F.col("a.stop_id").cast("double") / 50)
    return a.join(b, F.col("b.stop_id") == F.col("a.stop_id") + 1).select("a.stop_id", F.round(km, 6).alias("km"), F.round(mid, 6).alias("between_zone"))


@query("f16_hash_ranks", "SELECT trip_id, sha256('9|' || trip_id) AS digest, md5(CAST(trip_id AS VARCHAR)) AS short FROM trips")
def hash_ranks(r: Roles) -> DataFrame:
    return r.trips.select("trip_id", scalars.rank_digest("9", "trip_id").alias("digest"), F.md5(F.col("trip_id").cast("string")).alias("short"))


@query("f17_stable_index", "SELECT trip_id, CAST(('0x' || substr(sha256(CAST(trip_id AS VARCHAR)), 1, 13))::BIGINT % 10 AS BIGINT) AS bucket FROM trips")
def stable_index(r: Roles) -> DataFrame:
    return r.trips.select("trip_id", scalars.stable_index(F.col("trip_id").cast("string"), 10).alias("bucket"))


@query("f18_composite_id", "SELECT trip_id, seq, length(CAST(trip_id AS VARCHAR)) || ':' || trip_id || seq AS case_id, CAST(trip_id AS VARCHAR) AS first_part, CAST(seq AS VARCHAR) AS second_part FROM visits")
def composite_id(r: Roles) -> DataFrame:
    made = r.visits.select("trip_id", "seq", scalars.composite("trip_id", "seq").alias("case_id"))
    one, two = scalars.composite_parts("case_id")
    return made.select("trip_id", "seq", "case_id", one.alias("first_part"), two.alias("second_part"))


portable("f20_boolean_text", "SELECT trip_id, CAST(lower(CASE WHEN status = 'O' THEN 'TRUE' ELSE 'False' END) AS BOOLEAN) AS flag FROM trips")


@query("f21_map_lookup", "SELECT trip_id, CASE status WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS label_index FROM trips")
def map_lookup(r: Roles) -> DataFrame:
    return r.trips.select("trip_id", F.create_map(*(F.lit(x) for x in ("O", 0, "F", 1, "P", 2)))[F.col("status")].alias("label_index"))


@query("f22_json", "SELECT row_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || row_id || ',\"kind\":\"' || kind || '\"}' AS canonical FROM observations")
def json_access(r: Roles) -> DataFrame:
    return r.observations.select("row_id", scalars.pointer("props", "/k").cast("long").alias("k"), F.to_json(F.struct(F.col("row_id").alias("id"), "kind")).alias("canonical"))


