"""The check families of a whole dataset, each table read once (see ``operators.checks``).

The SQL that a family is held against counts each check by a SELECT of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korridor.operators import intervals
from korridor.operators.checks import violations, with_group, with_neighbours, with_parent
from korridor.plans.integrity import CHECKS, counted
from korridor.plans.registry import query
from korridor.roles import Roles, seconds

CUT = 915_148_800  # 1999-01-01


def visit_rows(r: Roles) -> DataFrame:
    """Each visit with its lines, its trip (t_), vehicle (h_) and stop (s_), its neighbours along the trip (trip_), the trip's sums and the duty before (busy_s).

    Lines are dealt out by trip once; copies, visits and everything along a trip then need no other
    exchange.
    """
    lines = r.lines
    torn = F.expr("l_orderkey IS NULL OR l_linenumber IS NULL OR l_quantity IS NULL OR l_returnflag IS NULL")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    copies = lines.groupBy(*key, "l_quantity").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("flag"), F.min("l_shipdate").alias("shipped"), F.count_if(torn).alias("torn"))
    places = copies.groupBy(*key).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("copies"), F.sum(F.col("l_quantity") * F.col("n")).alias("q"), F.min("flag").alias("flag"), F.min("shipped").alias("shipped"), F.sum("torn").alias("torn"))
    v = places.groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(
        F.min("l_suppkey").alias("stop_id"), F.min("l_partkey").alias("vehicle_id"), F.min("flag").alias("direction"), seconds("min(shipped)").alias("actual_s"), F.sum("q").cast("long").alias("boardings"), F.floor(F.sum("q") / 2).cast("long").alias("alightings"),
        F.sum("n").alias("lines_n"), F.sum("q").alias("quantity"), F.count_if(F.col("n") > 1).alias("doubled"), F.sum("copies").alias("copies"), F.sum("torn").alias("torn"),
    )
    net = F.sum(F.col("boardings") - F.col("alightings"))
    v = with_neighbours(v, ["trip_id"], ["seq"], "trip", ["actual_s", "vehicle_id", "boardings", "alightings", "seq"], ["actual_s", "vehicle_id", "boardings", "alightings", "stop_id", "seq"], onboard=net, far=F.sum("boardings"))
    v = with_group(v, ["trip_id"], trip_boardings=F.sum("boardings"), trip_alightings=F.sum("alightings"), trip_min_vehicle=F.min("vehicle_id"), trip_max_vehicle=F.max("vehicle_id"), trip_first_s=F.min("actual_s"), trip_last_s=F.max("actual_s"))
    v = with_parent(v, r.trips, {"trip_id": "trip_id"}, "t")
    v = with_parent(v, r.vehicles.select("vehicle_id", "capacity"), {"vehicle_id": "vehicle_id"}, "h")
    return with_parent(v, r.stops.select("stop_id", "zone_id"), {"stop_id": "stop_id"}, "s")


def with_duties(v: DataFrame) -> DataFrame:
    """Visits with ``busy_s``: when the vehicle's duties that begin before are over."""
    late = in_spine() & (F.col("actual_s") > F.col("t_scheduled_s"))
    return with_neighbours(v, ["vehicle_id"], ["t_scheduled_s", "trip_id", "seq"], "duty", busy_s=F.max(F.when(late, F.col("actual_s")))).withColumn("late", late)


def trip_rows(r: Roles) -> DataFrame:
    """Each trip with its passenger (p_) and route (n_), and the passenger's trips before and after (own_) and of the same day (day_n)."""
    t = with_neighbours(r.trips, ["passenger_id"], ["scheduled_s", "trip_id"], "own", ["scheduled_s"], ["scheduled_s"])
    t = with_group(t, ["passenger_id"], early_n=F.count_if(F.col("service_date") < F.lit("1999-01-01").cast("date")), trips_n=F.count("*"))
    t = t.withColumn("day_place", F.row_number().over(Window.partitionBy("passenger_id", "service_date").orderBy("trip_id")))
    t = with_parent(t, r.passengers.select("passenger_id", "segment"), {"passenger_id": "passenger_id"}, "p")
    return with_parent(t, r.routes.select("route_id"), {"route_id": "route_id"}, "n")


def observation_rows(r: Roles) -> DataFrame:
    o = with_parent(r.observations, r.passengers.select("passenger_id"), {"route_id": "passenger_id"}, "p")
    halfopen = r.contexts.withColumn("last_s", F.col("ends_s") - 1)
    inside = intervals.active_counts(r.observations, halfopen, "row_id", [("route_id", "route_id")], "context_id", "at_s", "starts_s", "last_s")
    return o.join(inside.withColumnRenamed("n", "contexts_n"), "row_id")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def delay() -> Column:
    return F.greatest(F.lit(0), F.col("actual_s") - F.col("t_scheduled_s"))


def in_spine() -> Column:
    return F.col("t_found")


def weekday_of(instant: str) -> Column:
    return (F.floor(F.col(instant) / 86400) + 3) % 7 + 1


def full() -> Column:
    return F.col("boardings") > F.col("h_capacity")


def ordered(*names: str) -> Column:
    """Whether a row that has a next one along its trip is followed by the next sequence."""
    return F.col("trip_after_seq") == F.col("seq") + 1


@query("v50_relationships", counted("v50_relationships"))
def relationships(r: Roles) -> DataFrame:
    v, t = with_duties(visit_rows(r)), trip_rows(r)
    stops = with_parent(r.stops, r.routes.select("route_id"), {"zone_id": "route_id"}, "n")
    contexts = with_parent(r.contexts, r.observations.select("row_id"), {"context_id": "row_id"}, "o")
    requests = with_parent(r.observations, r.passengers.select("passenger_id"), {"route_id": "passenger_id"}, "p")
    return violations(
        (v, {
            "distance_geometry": F.coalesce("far", F.lit(0)) + F.col("boardings") < F.col("seq") * 10 - 0.05, "vehicle_integrity": F.col("h_capacity").isNull(), "opening": in_spine() & (F.col("t_status") == "O") & (F.col("t_service_date") < day("1995-03-01")),
            "duties_nonoverlap": F.col("late") & (F.col("t_scheduled_s") < F.col("busy_s") + 3600), "stop_event_relationships": ~F.col("s_found") | ~F.col("t_found") | (F.col("s_zone_id") != F.col("t_route_id")),
            "journey_relationships": ordered() & (F.col("trip_after_stop_id") == F.col("stop_id")),
        }),
        (t, {"plan_versions": F.col("own_after_scheduled_s") == F.col("scheduled_s"), "route_parents": ~F.col("n_found"), "calendar_compatibility": (F.col("p_segment") == "HOUSEHOLD") & (weekday_of("scheduled_s") > 5)}),
        (stops, {"route_stop_integrity": ~F.col("n_found")}),
        (requests, {"request_relationships": ~F.col("p_found")}),
        (contexts, {"context_relationships": ~F.col("o_found") | (F.col("ends_s") <= F.col("starts_s"))}),
    )


@query("v51_temporal", counted("v51_temporal"))
def temporal(r: Roles) -> DataFrame:
    same = Window.partitionBy("route_id", "kind", "at_s")
    later = F.filter(F.collect_list(F.struct("row_id", "available_s")).over(same), lambda x: (x["row_id"] > F.col("row_id")) & (x["available_s"] <= F.col("available_s")))
    o = observation_rows(r).withColumn("overtaken", F.size(later))
    in_order = F.col("scheduled_s") < CUT
    return violations(
        (visit_rows(r), {
            "trip_time_order": in_spine() & F.col("trip_first") & ((F.col("trip_last_s") < F.col("trip_first_s")) | (F.col("trip_first_s") < F.col("t_scheduled_s"))), "schedule_before_use": in_spine() & (F.col("t_scheduled_s") > F.col("actual_s") + 86400 * 365),
            "stop_event_order": F.col("actual_s") < F.col("trip_before_actual_s"), "delay_derived": in_spine() & (delay() > 0) & (delay() % 86400 != 0), "superseded_unused": F.col("trip_first") & (F.col("t_status") == "P"),
        }),
        (trip_rows(r), {
            "history_bounds": (F.col("service_date") < day("1995-01-01")) | (F.col("service_date") >= day("2001-01-01")), "one_plan": F.col("day_place") == 2, "purge": (F.col("service_date") >= day("1996-12-25")) & (F.col("service_date") < day("1997-01-01")),
            "split_membership": (F.col("service_date") >= day("1999-01-01")) == in_order,
        }),
        (o, {"metadata": ~(F.col("at_s") <= F.col("available_s")), "applicable": F.col("contexts_n") > 1, "complete_availability": F.col("at_s").isNull() | F.col("available_s").isNull(), "late_revision": (F.sum("overtaken"),)}),
    )


@query("v52_counts", counted("v52_counts"))
def counts(r: Roles) -> DataFrame:
    v = visit_rows(r)
    flag = F.when(F.col("h_capacity") > 0, full()).isNotNull()
    change = ordered() & (F.col("vehicle_id") != F.col("trip_after_vehicle_id"))
    return violations(
        (v, {
            "physical": in_spine() & ((F.col("boardings") < 0) | (F.col("alightings") < 0) | (F.col("alightings") > F.col("boardings"))), "boundary": F.col("trip_first") & (F.col("alightings") > 10) | F.col("trip_last") & (F.col("boardings") > 40),
            "unknown_vehicle": in_spine() & F.col("h_capacity").isNull() & (F.col("boardings") > 0), "not_clipped": ((F.count_if(in_spine() & full()) == 0).cast("long"),), "conservation": F.col("trip_first") & ((F.col("trip_boardings") < F.col("trip_alightings")) | (F.col("trip_boardings") - F.col("trip_alightings") > 500)),
            "transfer_counters": change & (F.col("trip_after_boardings") < F.col("boardings") - F.col("alightings")), "capacity_flags": in_spine() & (F.col("h_capacity").isNull() == flag), "reconcile_to_lines": F.col("quantity") != F.col("boardings"),
        }),
        (trip_rows(r), {"journeys_nonoverlap": F.col("scheduled_s") < F.col("own_before_scheduled_s") + 43200}),
    )


@query("v53_leakage", counted("v53_leakage"))
def leakage(r: Roles) -> DataFrame:
    seen, kept = F.count("*"), F.count_if(F.col("available_s") <= F.col("at_s"))
    return violations(
        (r.observations, {"cutoff": F.col("available_s") > F.col("at_s"), "value_filter": (((kept == 0) | (kept == seen)).cast("long"),)}),
        (r.contexts, {"planned_information": F.col("known_s") > F.col("starts_s")}),
        (trip_rows(r), {"plan_groups": F.col("own_first") & (F.col("early_n") > 0) & (F.col("early_n") < F.col("trips_n")), "horizon_purge": (F.col("service_date") < day("1999-01-01")) & (F.col("scheduled_s") + 604800 >= CUT)}),
    )


@query("v54_transport", counted("v54_transport"))
def transport(r: Roles) -> DataFrame:
    v = visit_rows(r)
    before = Window.partitionBy("t_route_id", "t_direction").orderBy("t_scheduled_s", "trip_id", "seq").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("t_direction", F.col("direction")).withColumn("departed_s", F.last(F.when(in_spine() & (F.col("seq") == 1), F.col("t_scheduled_s")), ignorenulls=True).over(before))
    rate = F.avg(F.when(in_spine(), (delay() > 0).cast("double")))
    weekend, weekday = F.avg(F.when(in_spine() & (weekday_of("t_scheduled_s") >= 6), F.col("boardings"))), F.avg(F.when(in_spine() & (weekday_of("t_scheduled_s") < 6), F.col("boardings")))
    change = ordered() & (F.col("vehicle_id") != F.col("trip_after_vehicle_id"))
    days = r.spine.groupBy("service_date").agg(F.sum("boardings").alias("b"))
    usual = days.agg(F.avg("b").alias("usual"))
    contexts = with_parent(r.contexts, r.passengers.select("passenger_id"), {"route_id": "passenger_id"}, "p")
    visited = with_parent(r.stops, r.table("lineitem").groupBy(F.col("l_orderkey"), F.col("l_linenumber")).agg(F.min("l_suppkey").alias("stop_id")).select("stop_id").distinct(), {"stop_id": "stop_id"}, "v")
    return violations(
        (v, {
            "delay_rate": (((rate < 0.05) | (rate > 0.50)).cast("long"),), "low_demand": in_spine() & (F.col("h_capacity") > 0) & (F.col("boardings") < 0.2 * F.col("h_capacity")), "vehicle_change": F.col("trip_first") & (F.col("trip_min_vehicle") != F.col("trip_max_vehicle")),
            "early_arrival": in_spine() & (F.col("actual_s") < F.col("t_scheduled_s")), "duplicate_fixtures": (F.sum("doubled"),), "bunching": in_spine() & (F.col("seq") == 1) & (F.col("t_scheduled_s") - F.col("departed_s") < 300),
            "phase_contract": change & (F.col("trip_after_actual_s") < F.col("actual_s")), "demand_differences": ((F.abs(weekend - weekday) > 0.2 * weekday).cast("long"),),
        }),
        (visited, {"coverage": ~F.col("v_found")}),
        (days.join(F.broadcast(usual)), {"special_event_spike": F.col("b") > 3 * F.col("usual")}),
        (contexts, {"context_scope": ~F.col("p_found") | (F.col("known_s") < F.col("starts_s"))}),
    )


@query("v58_inspector", counted("v58_inspector"))
def inspector(r: Roles) -> DataFrame:
    late = ~F.col("actual_s").between(F.col("t_scheduled_s"), F.col("t_scheduled_s") + 10_368_000)
    return violations(
        (visit_rows(r), {"position_after_duty": F.col("t_found") & late, "duplicate_copies": (F.sum("copies"),), "torn_rows": (F.sum("torn"),)}),
        (observation_rows(r), {"time_inside": F.col("contexts_n") == 0}),
    )


#: what a corrected version is held to, by the names of the certification; trips with status P count as cancelled
BOUNDED = {
    "stop_opening_and_event_timing_consistency": "SELECT 1 AS x FROM visits v LEFT JOIN stops s ON s.stop_id = v.stop_id LEFT JOIN (SELECT stop_id, min(scheduled_s) AS opened_s FROM spine GROUP BY stop_id) o ON o.stop_id = v.stop_id WHERE s.stop_id IS NULL OR v.actual_s IS NULL OR v.actual_s < o.opened_s",
    "stop_event_chronology": "SELECT 1 AS x FROM (SELECT actual_s, lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE actual_s < before",
    "vehicle_capacity_snapshot_consistency": "SELECT 1 AS x FROM visits v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id WHERE h.capacity IS NULL OR h.capacity <= 0",
    "vehicle_duty_nonoverlap": "SELECT 1 AS x FROM (SELECT scheduled_s, max(actual_s) OVER (PARTITION BY vehicle_id ORDER BY scheduled_s, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spine WHERE actual_s > scheduled_s) q WHERE scheduled_s < busy",
    "exact_canonical_movements": "SELECT 1 AS x FROM visits v JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) l ON l.l_orderkey = v.trip_id AND l.l_linenumber = v.seq WHERE l.q <> v.boardings",
    "journey_stop_event_trip_link": "SELECT 1 AS x FROM visits v LEFT JOIN trips t ON t.trip_id = v.trip_id WHERE t.trip_id IS NULL",
    "journey_sequence_and_route_stop_link": "SELECT 1 AS x FROM (SELECT seq, lag(seq, 1, 0) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE seq <> before + 1",
    "journey_timing_derivation": "SELECT 1 AS x FROM (SELECT actual_s, lead(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS after FROM visits) q WHERE after <= actual_s",
    "cancelled_trip_budget_invariant": "SELECT t.trip_id FROM trips t JOIN visits v ON v.trip_id = t.trip_id WHERE t.status = 'P' GROUP BY t.trip_id HAVING sum(v.boardings) > 0",
    "operated_trip_budget_invariant": "SELECT t.trip_id FROM trips t LEFT JOIN visits v ON v.trip_id = t.trip_id WHERE t.status <> 'P' GROUP BY t.trip_id HAVING coalesce(sum(v.boardings), 0) <= 0",
    "passenger_count_conservation": "SELECT 1 AS x FROM (SELECT boardings, alightings, coalesce(sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arrival FROM visits) q WHERE least(boardings, alightings, arrival, arrival - alightings + boardings) < 0 OR alightings > arrival",
    "passenger_count_event_uniqueness": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "terminal_load_zero": "SELECT trip_id FROM visits GROUP BY trip_id HAVING sum(boardings - alightings) <> 0",
    "overcrowding_flagging": "SELECT 1 AS x FROM visits v JOIN vehicles h ON h.vehicle_id = v.vehicle_id WHERE v.boardings > h.capacity",
    "operated_departures": "SELECT t.trip_id FROM trips t WHERE t.status <> 'P' AND NOT EXISTS (SELECT 1 FROM visits v WHERE v.trip_id = t.trip_id)",
    "passenger_journey_nonoverlap": "SELECT 1 AS x FROM (SELECT scheduled_s, lag(scheduled_s + 86400) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS busy FROM trips) q WHERE scheduled_s < busy",
    "request_journey_business_context": "SELECT 1 AS x FROM observations o LEFT JOIN passengers p ON p.passenger_id = o.route_id WHERE p.passenger_id IS NULL OR o.at_s IS NULL OR o.kind = 'error'",
    "condition_event_demand_increase": "SELECT 1 AS x FROM (SELECT avg(CASE WHEN h.row_id IS NOT NULL THEN o.target END) AS event, avg(CASE WHEN h.row_id IS NULL THEN o.target END) AS baseline FROM observations o LEFT JOIN (SELECT DISTINCT o.row_id FROM observations o JOIN contexts c ON c.route_id = o.route_id AND o.at_s >= c.starts_s AND o.at_s < c.ends_s) h ON h.row_id = o.row_id) q WHERE NOT coalesce(event, 0) > coalesce(baseline, 0)",
    "operational_stop_coverage": "SELECT stop_id FROM stops s WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.stop_id = s.stop_id)",
    "operational_vehicle_coverage": "SELECT vehicle_id FROM vehicles h WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.vehicle_id = h.vehicle_id)",
}
CHECKS["v57_bounded"] = BOUNDED


@query("v57_bounded", counted("v57_bounded"))
def bounded(r: Roles) -> DataFrame:
    """The checks that hold a corrected version, from one pass over visits, trips, observations, stops and vehicles each."""
    v = with_group(with_duties(visit_rows(r)), ["stop_id"], opened_s=F.min(F.when(in_spine(), F.col("t_scheduled_s"))))
    arrival = F.coalesce("onboard", F.lit(0))
    totals = r.visits.groupBy("trip_id").agg(F.sum("boardings").alias("boardings"))
    t = with_parent(trip_rows(r), totals, {"trip_id": "trip_id"}, "v")
    cancelled, moved = F.col("status") == "P", F.coalesce("v_boardings", F.lit(0))
    inside = F.col("contexts_n") > 0
    event, baseline = (F.coalesce(F.avg(F.when(x, F.col("target"))), F.lit(0.0)) for x in (inside, ~inside))
    used = r.visits.select("stop_id", "vehicle_id")
    return violations(
        (v, {
            "stop_opening_and_event_timing_consistency": ~F.col("s_found") | F.col("actual_s").isNull() | (F.col("actual_s") < F.col("opened_s")), "stop_event_chronology": F.col("actual_s") < F.col("trip_before_actual_s"),
            "vehicle_capacity_snapshot_consistency": F.col("h_capacity").isNull() | (F.col("h_capacity") <= 0), "vehicle_duty_nonoverlap": F.col("late") & (F.col("t_scheduled_s") < F.col("busy_s")), "exact_canonical_movements": F.col("quantity") != F.col("boardings"),
            "journey_stop_event_trip_link": ~F.col("t_found"), "journey_sequence_and_route_stop_link": F.col("seq") != F.coalesce("trip_before_seq", F.lit(0)) + 1, "journey_timing_derivation": F.col("trip_after_actual_s") <= F.col("actual_s"),
            "passenger_count_conservation": (F.least("boardings", "alightings", arrival, arrival - F.col("alightings") + F.col("boardings")) < 0) | (F.col("alightings") > arrival), "passenger_count_event_uniqueness": F.col("lines_n") > 1,
            "terminal_load_zero": F.col("trip_first") & (F.col("trip_boardings") != F.col("trip_alightings")), "overcrowding_flagging": full(),
        }),
        (t, {
            "cancelled_trip_budget_invariant": cancelled & (moved > 0), "operated_trip_budget_invariant": ~cancelled & (moved <= 0), "operated_departures": ~cancelled & ~F.col("v_found"),
            "passenger_journey_nonoverlap": F.col("scheduled_s") < F.col("own_before_scheduled_s") + 86400,
        }),
        (observation_rows(r), {"request_journey_business_context": ~F.col("p_found") | F.col("at_s").isNull() | (F.col("kind") == "error"), "condition_event_demand_increase": ((~(event > baseline)).cast("long"),)}),
        (with_parent(r.stops, used.select("stop_id").distinct(), {"stop_id": "stop_id"}, "v"), {"operational_stop_coverage": ~F.col("v_found")}),
        (with_parent(r.vehicles, used.select("vehicle_id").distinct(), {"vehicle_id": "vehicle_id"}, "v"), {"operational_vehicle_coverage": ~F.col("v_found")}),
    )
