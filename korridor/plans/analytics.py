"""Aggregates, service analytics and the declared capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.operators import transit, windows
from korridor.plans.registry import portable, query
from korridor.roles import Roles

DELAY = "greatest(0, actual_s - scheduled_s)"
WEEKDAY = "(CAST(floor(scheduled_s / 86400) AS BIGINT) + 3) % 7 + 1"
HOUR = "CAST(floor(scheduled_s / 3600) AS BIGINT) % 24"


def delayed(r: Roles) -> DataFrame:
    return r.spine.withColumn("delay_s", transit.positive_delay("actual_s", "scheduled_s"))


@query("a02_delay_analytics", f"SELECT service_date, route_id, direction, count(*) AS n, round(avg({DELAY}), 6) AS mean_delay_s, max({DELAY}) AS max_delay_s, round(avg(CASE WHEN {DELAY} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_fraction FROM spine WHERE actual_s IS NOT NULL AND scheduled_s IS NOT NULL GROUP BY service_date, route_id, direction")
def delay_analytics(r: Roles) -> DataFrame:
    x = delayed(r).filter("actual_s is not null and scheduled_s is not null")
    return x.groupBy("service_date", "route_id", "direction").agg(F.count("*").alias("n"), F.round(F.avg("delay_s"), 6).alias("mean_delay_s"), F.max("delay_s").alias("max_delay_s"), F.round(F.avg((F.col("delay_s") > 0).cast("double")), 6).alias("positive_fraction"))


@query("a01_daily_routes", f"SELECT service_date, route_code, count(DISTINCT trip_id) AS trips_n, round(avg({DELAY}), 6) AS mean_delay_s, max(boardings) AS max_load FROM spine s JOIN routes r ON s.route_id = r.route_id GROUP BY service_date, route_code")
def daily_routes(r: Roles) -> DataFrame:
    x = delayed(r).join(r.routes.select("route_id", "route_code"), "route_id")
    return x.groupBy("service_date", "route_code").agg(F.countDistinct("trip_id").alias("trips_n"), F.round(F.avg("delay_s"), 6).alias("mean_delay_s"), F.max("boardings").alias("max_load"))


PROFILE = f"""SELECT route_id, direction, count(*) AS n, count(DISTINCT trip_id) AS trips_n, count(DISTINCT stop_id) AS stops_n, round(avg(boardings), 6) AS mean_load, round(avg(CASE WHEN capacity > 0 THEN boardings::DOUBLE / capacity END), 6) AS mean_utilization,
round(avg({DELAY}), 6) AS mean_delay_s, round(avg(abs(headway_s)), 6) AS mean_headway_s FROM (SELECT *, actual_s - lag(actual_s) OVER (PARTITION BY route_id, direction, stop_id ORDER BY actual_s NULLS LAST, trip_id, seq) AS headway_s FROM spine WHERE service_date < DATE '1999-01-01') q GROUP BY route_id, direction"""


def profile(r: Roles) -> DataFrame:
    x = delayed(r).filter("service_date < DATE '1999-01-01'")
    x = windows.headway(transit.occupancy(x, "boardings", "capacity"), ["route_id", "direction", "stop_id"], "actual_s", "scheduled_s", ["trip_id", "seq"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return x.groupBy("route_id", "direction").agg(F.count("*").alias("n"), F.countDistinct("trip_id").alias("trips_n"), F.countDistinct("stop_id").alias("stops_n"), mean("boardings", "mean_load"), mean("utilization", "mean_utilization"), mean("delay_s", "mean_delay_s"), mean(F.abs("headway_s"), "mean_headway_s"))


@query("a03_route_clustering_vector", PROFILE)
def route_vector(r: Roles) -> DataFrame:
    return profile(r)


portable("a04_served_demand", "SELECT trip_id, CAST(sum(boardings) AS BIGINT) AS demand, max(actual_s) AS available_s FROM visits WHERE trip_id IS NOT NULL GROUP BY trip_id")
portable("a05_demand_profile", "SELECT route_id, direction, CAST(sum(boardings) AS BIGINT) AS demand, round(avg(boardings), 6) AS mean FROM spine WHERE service_date >= DATE '1997-01-01' AND service_date < DATE '1998-01-01' GROUP BY route_id, direction")
portable("a06_operational_profile", f"SELECT route_id, direction, round(avg(boardings), 6) AS load, round(avg(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END), 6) AS utilization, round(avg({DELAY}), 6) AS delay_s, count(DISTINCT stop_id) AS stops_n FROM spine GROUP BY route_id, direction")
portable("a07_count_by_key", "SELECT route_id, direction, count(*) AS n FROM spine GROUP BY route_id, direction")


@query("a08_boardings_alightings", "SELECT coalesce(o.stop_id, d.stop_id) AS stop_id, coalesce(o.n, 0) AS boardings, coalesce(d.n, 0) AS alightings FROM (SELECT stop_id, count(*) AS n FROM visits WHERE seq = 1 GROUP BY stop_id) o FULL JOIN (SELECT stop_id, count(*) AS n FROM visits WHERE seq = 7 GROUP BY stop_id) d ON o.stop_id = d.stop_id")
def boardings_alightings(r: Roles) -> DataFrame:
    one = r.visits.filter("seq = 1").groupBy("stop_id").agg(F.count("*").alias("a"))
    two = r.visits.filter("seq = 7").groupBy("stop_id").agg(F.count("*").alias("b"))
    return one.join(two, "stop_id", "full_outer").select("stop_id", F.coalesce("a", F.lit(0)).alias("boardings"), F.coalesce("b", F.lit(0)).alias("alightings"))


@query("a09_peak_load", "SELECT trip_id, max(boardings) AS peak_load, CAST(sum(CASE WHEN actual_s > scheduled_s THEN 1 ELSE 0 END) AS BIGINT) AS delays, round(avg(actual_s - scheduled_s), 6) AS mean_s FROM spine GROUP BY trip_id")
def peak_load(r: Roles) -> DataFrame:
    return r.spine.groupBy("trip_id").agg(F.max("boardings").alias("peak_load"), F.count_if(F.col("actual_s") > F.col("scheduled_s")).alias("delays"), F.round(F.avg(F.col("actual_s") - F.col("scheduled_s")), 6).alias("mean_s"))


LIMITS = (0, 30 * 86400, 180 * 86400, 365 * 86400)
LABEL = f"CASE WHEN {DELAY} <= 0 THEN 'ON_TIME' WHEN {DELAY} <= 2592000 THEN 'MINOR_DELAY' WHEN {DELAY} <= 15552000 THEN 'MODERATE_DELAY' WHEN {DELAY} <= 31536000 THEN 'MAJOR_DELAY' ELSE 'SEVERE_DELAY' END"


@query("a10_class_histogram", f"SELECT {LABEL} AS label, count(*) AS n FROM spine GROUP BY 1")
def class_histogram(r: Roles) -> DataFrame:
    return delayed(r).groupBy(transit.severity(F.col("delay_s"), LIMITS).alias("label")).agg(F.count("*").alias("n"))


portable("a11_date_bounds", "SELECT status, min(service_date) AS first_day, max(service_date) AS last_day FROM trips GROUP BY status")


@query("a12_table_checksum", None)
def table_checksum(r: Roles) -> DataFrame:
    """Row count and order-free sum of row hashes of each table; reads every column."""
    out = None
    for name in ("customer", "orders", "lineitem", "events"):
        t = r.table(name)
        part = t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).alias("checksum"))
        out = part if out is None else out.unionByName(part)
    return out


SETS = {"route": ["route_id"], "stop": ["stop_id"], "vehicle": ["vehicle_id"], "hour": ["hour"], "weekday": ["weekday"], "route_direction": ["route_id", "direction"], "band": ["band"], "trip": ["trip_id"], "route_direction_weekday_hour": ["route_id", "direction", "weekday", "hour"]}
_COLUMNS = ["route_id", "stop_id", "vehicle_id", "hour", "weekday", "direction", "band", "trip_id"]


def _summary_sql() -> str:
    base = f"s AS (SELECT route_id, stop_id, vehicle_id, {HOUR} AS hour, {WEEKDAY} AS weekday, direction, CASE WHEN seq <= 2 THEN 'near' WHEN seq <= 5 THEN 'middle' ELSE 'far' END AS band, trip_id, service_date, CASE WHEN capacity IS NOT NULL THEN actual_s - scheduled_s END AS d FROM spine)"
    parts = []
    for name, keys in SETS.items():
        member = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in _COLUMNS if c in keys)
        parts.append(f"SELECT '{name}' AS dimension, {member} AS member, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS spread, max(d) AS greatest, count(CASE WHEN d > 300 THEN 1 END) AS late_n, round(count(CASE WHEN d > 300 THEN 1 END)::DOUBLE / nullif(count(d), 0), 6) AS late_fraction, count(CASE WHEN d < -60 THEN 1 END) AS early_n, round(count(CASE WHEN d BETWEEN -60 AND 300 THEN 1 END)::DOUBLE / nullif(count(d), 0), 6) AS on_time_fraction, count(DISTINCT CASE WHEN d > 300 THEN service_date END) AS late_days, count(DISTINCT CASE WHEN d > 300 THEN service_date END) >= 2 AS recurring, count(*) - count(d) AS excluded FROM s GROUP BY {', '.join(keys)}")
    return f"WITH {base} " + " UNION ALL ".join(parts)


@query("a13_service_analytics", _summary_sql())
def service_analytics(r: Roles) -> DataFrame:
    x = r.spine.select("route_id", "stop_id", "vehicle_id", transit.hour("scheduled_s").alias("hour"), transit.iso_weekday("scheduled_s").alias("weekday"), "direction", F.when(F.col("seq") <= 2, "near").when(F.col("seq") <= 5, "middle").otherwise("far").alias("band"), "trip_id", "service_date", F.when(F.col("capacity").isNotNull(), F.col("actual_s") - F.col("scheduled_s")).alias("d"))
    return transit.delay_summary(x, SETS, "d", "service_date", 60, 300, 2)


@query("a14_persistent_crowding", f"SELECT route_id, direction, {WEEKDAY} AS weekday, count(CASE WHEN boardings > capacity THEN 1 END) AS overloaded, count(DISTINCT CASE WHEN boardings > capacity THEN service_date END) AS overloaded_days, count(DISTINCT CASE WHEN boardings > capacity THEN service_date END) >= 2 AS persistent, count(CASE WHEN boardings < 0.4 * capacity THEN 1 END) AS underused FROM spine GROUP BY route_id, direction, 3")
def persistent_crowding(r: Roles) -> DataFrame:
    over = F.col("boardings") > F.col("capacity")
    days = F.countDistinct(F.when(over, F.col("service_date")))
    return r.spine.groupBy("route_id", "direction", transit.iso_weekday("scheduled_s").alias("weekday")).agg(F.count_if(over).alias("overloaded"), days.alias("overloaded_days"), (days >= 2).alias("persistent"), F.count_if(F.col("boardings") < 0.4 * F.col("capacity")).alias("underused"))


@query("a15_band_histogram", "SELECT CASE (u > 0.4)::INT + (u > 0.8)::INT + (u > 1.0)::INT WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'High' ELSE 'Overcrowded' END AS band, count(*) AS n FROM (SELECT boardings::DOUBLE / capacity AS u FROM spine WHERE capacity > 0) q GROUP BY 1")
def band_histogram(r: Roles) -> DataFrame:
    x = transit.occupancy(r.spine, "boardings", "capacity").filter("occupancy_status = 'AVAILABLE'")
    return x.groupBy(transit.occupancy_band(F.col("utilization")).alias("band")).agg(F.count("*").alias("n"))


portable("a16_status_histogram", "SELECT coalesce(CASE WHEN capacity IS NOT NULL THEN status END, 'UNKNOWN') AS service_status, count(*) AS n, count(capacity) AS available FROM spine GROUP BY coalesce(CASE WHEN capacity IS NOT NULL THEN status END, 'UNKNOWN')")
portable("a17_sequence_completeness", "SELECT trip_id, count(*) AS n FROM visits GROUP BY trip_id HAVING min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*)")
portable("a18_conditional_sums", "SELECT route_id, CAST(sum(CASE WHEN boardings > capacity THEN 1 ELSE 0 END) AS BIGINT) AS over_n, round(avg(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END), 6) AS mean_occupancy, round(max(CASE WHEN capacity > 0 THEN CAST(boardings AS DOUBLE) / capacity END), 6) AS max_occupancy FROM spine GROUP BY route_id")
portable("a19_distinct_counts", "SELECT direction, count(DISTINCT route_id) AS routes_n, count(DISTINCT stop_id) AS stops_n, count(DISTINCT vehicle_id) AS vehicles_n, count(DISTINCT substr(CAST(service_date AS STRING), 1, 7)) AS months_n FROM spine GROUP BY direction")
portable("a20_demand_by_category", f"SELECT CASE WHEN {WEEKDAY} >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, direction, count(DISTINCT trip_id) AS trips_n, CAST(sum(boardings) AS BIGINT) AS movements, round(avg(boardings), 6) AS mean FROM spine GROUP BY CASE WHEN {WEEKDAY} >= 6 THEN 'weekend' ELSE 'weekday' END, direction")
portable("a21_event_means", "WITH hit AS (SELECT DISTINCT o.row_id FROM observations o JOIN contexts c ON c.route_id = o.route_id AND o.at_s BETWEEN c.starts_s AND c.ends_s) SELECT o.route_id, round(avg(CASE WHEN h.row_id IS NOT NULL THEN o.target END), 6) AS event_mean, round(avg(CASE WHEN h.row_id IS NULL THEN o.target END), 6) AS baseline_mean FROM observations o LEFT JOIN hit h ON h.row_id = o.row_id GROUP BY o.route_id")
portable("a24_position_stats", "SELECT stop_id, seq, count(*) AS events_n, count(capacity) AS observed, min(service_date) AS first_day, max(service_date) AS last_day FROM spine GROUP BY stop_id, seq")


@query("a25_cluster_interpretation", "SELECT direction AS prediction, count(*) AS n, round(avg(mean_load), 6) AS load, round(avg(mean_delay_s), 4) AS delay_s, list_sort(list(DISTINCT route_id))::VARCHAR AS members FROM (" + PROFILE + ") p GROUP BY direction")
def cluster_interpretation(r: Roles) -> DataFrame:
    g = profile(r).groupBy(F.col("direction").alias("prediction"))
    members = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set("route_id")), ", "), F.lit("]"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("mean_load"), 6).alias("load"), F.round(F.avg("mean_delay_s"), 4).alias("delay_s"), members.alias("members"))


portable("a26_cluster_sizes", "SELECT direction AS prediction, count(*) AS n FROM (SELECT DISTINCT route_id, direction FROM spine) q GROUP BY direction")
portable("a27_exclusion_reasons", "SELECT CAST(sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_capacity, CAST(sum(CASE WHEN actual_s < scheduled_s THEN 1 ELSE 0 END) AS BIGINT) AS too_early, CAST(sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS pending, count(*) AS n FROM spine")

# declared capabilities
portable("d01_od_matrix", "SELECT p.route_id AS origin, s.zone_id AS destination, CAST(sum(v.boardings) AS BIGINT) AS flow, rank() OVER (PARTITION BY p.route_id ORDER BY CAST(sum(v.boardings) AS BIGINT) DESC, s.zone_id) AS place FROM visits v JOIN trips t ON v.trip_id = t.trip_id JOIN passengers p ON p.passenger_id = t.passenger_id JOIN stops s ON s.stop_id = v.stop_id GROUP BY p.route_id, s.zone_id")
portable("d02_peak_periods", "SELECT hour, n, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS share_of_peak, rank() OVER (ORDER BY n DESC, hour) AS place FROM (SELECT CAST(floor(at_s / 3600) AS BIGINT) % 24 AS hour, count(*) AS n FROM observations GROUP BY CAST(floor(at_s / 3600) AS BIGINT) % 24) q")
portable("d03_demand_trend", "SELECT route_id, day, n, n - lag(n) OVER (PARTITION BY route_id ORDER BY day) AS growth FROM (SELECT route_id, CAST(floor(at_s / 86400) AS BIGINT) AS day, count(*) AS n FROM observations GROUP BY route_id, CAST(floor(at_s / 86400) AS BIGINT)) q")
portable("d04_route_score", f"SELECT route_id, round(score, 6) AS score, CASE WHEN score >= 0.66 THEN 'GOOD' WHEN score >= 0.33 THEN 'FAIR' ELSE 'POOR' END AS category FROM (SELECT route_id, 0.6 * (d_max - d) / (d_max - d_min) + 0.4 * (l - l_min) / (l_max - l_min) AS score FROM (SELECT route_id, d, l, min(d) OVER () AS d_min, max(d) OVER () AS d_max, min(l) OVER () AS l_min, max(l) OVER () AS l_max FROM (SELECT route_id, avg({DELAY}) AS d, avg(boardings) AS l FROM spine GROUP BY route_id) a) b) c")
portable("d05_reliability", "SELECT route_id, round(avg(actual_s - scheduled_s), 4) AS mean_s, round(stddev_pop(actual_s - scheduled_s), 4) AS spread_s, CAST(sum(CASE WHEN actual_s < scheduled_s THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN actual_s > scheduled_s THEN 1 ELSE 0 END) AS BIGINT) AS late FROM spine GROUP BY route_id")
portable("d06_supply_gap", "SELECT route_id, CAST(sum(boardings) AS BIGINT) AS demand, CAST(sum(capacity) AS BIGINT) AS supply, CASE WHEN sum(boardings) > sum(capacity) THEN 'SHORT' WHEN sum(boardings) < 0.5 * sum(capacity) THEN 'SPARE' ELSE 'BALANCED' END AS gap FROM spine WHERE capacity IS NOT NULL GROUP BY route_id")


@query("d07_overcrowding_runs", "SELECT trip_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS stops_n FROM (SELECT trip_id, seq, f, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - row_number() OVER (PARTITION BY trip_id, f ORDER BY seq) AS g FROM (SELECT trip_id, seq, coalesce(boardings > capacity, false) AS f FROM spine) a) b WHERE f GROUP BY trip_id, g")
def overcrowding_runs(r: Roles) -> DataFrame:
    return windows.islands(r.spine.select("trip_id", "seq", "boardings", "capacity"), ["trip_id"], "seq", F.coalesce(F.col("boardings") > F.col("capacity"), F.lit(False)))


portable("d08_stop_performance", f"SELECT stop_id, count(*) AS visits_n, round(avg({DELAY}), 4) AS mean_delay_s, CAST(sum(CASE WHEN {DELAY} >= 31536000 THEN 1 ELSE 0 END) AS BIGINT) AS bottlenecks FROM spine GROUP BY stop_id")


@query("d09_anomalies", "SELECT route_id, day, n, round(CASE WHEN s > 0 THEN (n - m) / s END, 6) AS z, coalesce(abs(CASE WHEN s > 0 THEN (n - m) / s END) > 2, false) AS anomalous FROM (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS s FROM (SELECT route_id, CAST(floor(at_s / 86400) AS BIGINT) AS day, count(*) AS n FROM observations GROUP BY 1, 2) q WINDOW w AS (PARTITION BY route_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) z")
def anomalies(r: Roles) -> DataFrame:
    days = r.observations.groupBy("route_id", F.floor(F.col("at_s") / 86400).alias("day")).agg(F.count("*").alias("n"))
    return windows.rolling_anomaly(days, ["route_id"], "day", "n")


portable("d10_segments", "SELECT p.passenger_id, count(t.trip_id) AS trips_n, round(coalesce(sum(t.fare), 0), 2) AS spent, CASE WHEN count(t.trip_id) >= 15 THEN 'FREQUENT' WHEN count(t.trip_id) >= 8 THEN 'REGULAR' WHEN count(t.trip_id) > 0 THEN 'OCCASIONAL' ELSE 'NONE' END AS segment FROM passengers p LEFT JOIN trips t ON t.passenger_id = p.passenger_id GROUP BY p.passenger_id")
portable("d11_quality_kpis", "SELECT service_date, count(*) AS n, CAST(sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS incomplete, CAST(sum(CASE WHEN actual_s < scheduled_s THEN 1 ELSE 0 END) AS BIGINT) AS inconsistent FROM spine GROUP BY service_date")
portable("d12_executive_kpis", f"SELECT count(DISTINCT trip_id) AS trips_n, CAST(sum(boardings) AS BIGINT) AS movements, round(avg({DELAY}), 4) AS mean_delay_s, round(avg(CAST(CASE WHEN actual_s <= scheduled_s + 300 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS punctual FROM spine")
