"""Integrity checks as a catalogue of SQL: each check is the SELECT of its violating rows.

A query gives the number of violations of every check in a group; a check passes at 0. The SQL is
portable, so the same text runs on Spark over role frames and on the engine it is compared with.
Correlated counts and disjunctive scopes are written as pre-aggregation and unions, which plan to
hash joins instead of nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.operators import intervals
from korridor.plans.registry import portable, query
from korridor.roles import Roles, seconds

DAY = "CAST(floor(scheduled_s / 86400) AS BIGINT)"
WEEKDAY = f"(({DAY} + 3) % 7 + 1)"
DELAY = "greatest(0, actual_s - scheduled_s)"

CHECKS: dict[str, dict[str, str]] = {
    "v01_pk_unique": {
        "trips": "SELECT trip_id FROM trips GROUP BY trip_id HAVING count(*) > 1",
        "visits": "SELECT trip_id, seq FROM visits GROUP BY trip_id, seq HAVING count(*) > 1",
        "raw_lines": "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "observations": "SELECT row_id FROM observations GROUP BY row_id HAVING count(*) > 1",
    },
    "v02_foreign_keys": {
        "visits.trip_id": "SELECT 1 AS x FROM visits v WHERE NOT EXISTS (SELECT 1 FROM trips t WHERE t.trip_id = v.trip_id)",
        "visits.stop_id": "SELECT 1 AS x FROM visits v WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.stop_id = v.stop_id)",
        "visits.vehicle_id": "SELECT 1 AS x FROM visits v WHERE NOT EXISTS (SELECT 1 FROM vehicles h WHERE h.vehicle_id = v.vehicle_id)",
        "trips.passenger_id": "SELECT 1 AS x FROM trips t WHERE NOT EXISTS (SELECT 1 FROM passengers p WHERE p.passenger_id = t.passenger_id)",
        "observations.passenger_id": "SELECT 1 AS x FROM observations o WHERE NOT EXISTS (SELECT 1 FROM passengers p WHERE p.passenger_id = o.route_id)",
    },
    "v03_minimums": {
        "trips": "SELECT count(*) AS n FROM trips HAVING count(*) < (SELECT 8 * count(*) FROM passengers)",
        "stops": "SELECT count(*) AS n FROM stops HAVING count(*) < (SELECT 2 * count(*) FROM routes)",
        "exact_movements": "SELECT count(*) AS n FROM lineitem HAVING count(*) <> (SELECT 4 * count(*) FROM trips)",
        "exact_visits": "SELECT count(*) AS n FROM visits HAVING count(*) <> (SELECT count(*) FROM lineitem)",
    },
    "v04_resolutions": {
        "unknown_status": "SELECT status FROM trips WHERE status NOT IN ('O', 'F', 'P')",
        "missing_status": "SELECT 'x' AS status WHERE (SELECT count(DISTINCT status) FROM trips) < 3",
        "served_budget": "SELECT count(*) AS n FROM trips WHERE status = 'F' HAVING count(*) > 5000",
    },
    "v05_optional_channels": {
        "capacity_missing": "SELECT 1 AS x FROM vehicles WHERE capacity IS NULL",
        "any_missing": "SELECT sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) AS n FROM vehicles HAVING sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) = 0",
    },
    "v06_ticket_journey_overlap": {"both_channels": "SELECT DISTINCT t.trip_id FROM trips t JOIN observations o ON o.route_id = t.passenger_id AND CAST(floor(o.at_s / 86400) AS BIGINT) = CAST(floor(t.scheduled_s / 86400) AS BIGINT) WHERE o.kind = 'purchase' AND t.status <> 'P'"},
    "v07_operated_trips": {"journeys": "SELECT 1 AS x FROM visits v JOIN trips t ON v.trip_id = t.trip_id WHERE t.status = 'P' OR v.actual_s < t.scheduled_s"},
    "v08_departures": {
        "planned": "SELECT DISTINCT passenger_id, service_date FROM trips",
        "operated": "SELECT DISTINCT passenger_id, service_date FROM trips WHERE status <> 'P'",
    },
    "v09_one_current_plan": {"departures": "SELECT passenger_id, service_date FROM (SELECT passenger_id, service_date, status, CAST(substr(priority, 1, 1) AS INT) AS version FROM trips) q GROUP BY passenger_id, service_date HAVING sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END) <> 1 OR min(version) <> 1 OR max(version) <> count(*)"},
    "v10_plan_intervals": {"predecessors": "SELECT t.trip_id FROM (SELECT trip_id, passenger_id, status, scheduled_s, lag(trip_id) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS predecessor FROM trips) t JOIN (SELECT trip_id, status, lead(scheduled_s) OVER (PARTITION BY route_id ORDER BY scheduled_s, trip_id) AS effective_to FROM trips) p ON p.trip_id = t.predecessor WHERE p.effective_to <> t.scheduled_s OR p.status <> t.status"},
    "v11_plan_parents": {
        "pattern": "SELECT 1 AS x FROM visits v JOIN trips t ON v.trip_id = t.trip_id JOIN stops s ON v.stop_id = s.stop_id WHERE s.zone_id <> t.route_id",
        "dates": f"SELECT 1 AS x FROM trips t JOIN passengers p ON t.passenger_id = p.passenger_id JOIN routes r ON p.route_id = r.route_id WHERE {WEEKDAY} > 5 AND r.mode = 'ASIA'",
    },
    "v12_stop_sequence": {
        "sequence": "SELECT trip_id FROM visits GROUP BY trip_id HAVING min(seq) <> 1 OR max(seq) <> count(*) OR count(DISTINCT seq) <> count(*)",
        "parents": "SELECT 1 AS x FROM visits v JOIN stops s ON v.stop_id = s.stop_id LEFT JOIN routes r ON s.zone_id = r.route_id WHERE r.route_id IS NULL",
    },
    "v13_distance_order": {"stops": "SELECT trip_id FROM (SELECT trip_id, boardings, lag(boardings) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE boardings <= before"},
    "v14_schedule_order": {
        "order": "SELECT trip_id FROM (SELECT trip_id, actual_s, lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE actual_s < before",
        "offsets": "SELECT 1 AS x FROM visits v JOIN trips t ON v.trip_id = t.trip_id WHERE v.actual_s - t.scheduled_s > v.seq * 86400 * 30",
    },
    "v15_calendar": {
        "validity": f"SELECT trip_id FROM trips WHERE CASE WHEN {DAY} % 11 = 0 THEN 1 WHEN {DAY} % 13 = 0 THEN 0 WHEN {WEEKDAY} = 6 THEN 1 WHEN {WEEKDAY} = 7 THEN 1 ELSE 0 END = 1",
        "half_open": "SELECT trip_id FROM trips WHERE NOT (service_date >= DATE '1995-01-01' AND service_date < DATE '2001-07-01')",
    },
    "v16_history": {"months": "SELECT count(DISTINCT substr(CAST(service_date AS STRING), 1, 7)) AS n FROM trips HAVING count(DISTINCT substr(CAST(service_date AS STRING), 1, 7)) < 18"},
    "v17_event_pattern": {"sequence": "SELECT 1 AS x FROM visits v JOIN trips t ON v.trip_id = t.trip_id JOIN passengers p ON t.passenger_id = p.passenger_id JOIN stops s ON v.stop_id = s.stop_id WHERE p.route_id <> t.route_id OR s.zone_id = p.route_id AND v.seq > 3"},
    "v18_event_time": {
        "timing": "SELECT 1 AS x FROM spine WHERE actual_s < scheduled_s",
        "chronology": "SELECT trip_id FROM (SELECT trip_id, actual_s, lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE actual_s < before",
    },
    "v19_cancellation": {"superseded": "SELECT 1 AS x FROM visits v JOIN trips t ON v.trip_id = t.trip_id WHERE t.status = 'P' AND v.direction <> 'N'"},
    "v20_origin_destination": {"timing": "SELECT a.trip_id FROM visits a JOIN trips t ON a.trip_id = t.trip_id JOIN visits o ON o.trip_id = t.trip_id AND o.seq = 1 JOIN visits d ON d.trip_id = t.trip_id AND d.seq = 2 WHERE d.actual_s < o.actual_s AND a.seq = 1"},
    "v21_conservation": {
        "counts": "SELECT 1 AS x FROM (SELECT c.trip_id, c.seq, c.boardings, c.alightings, coalesce(p.onboard, 0) AS onboard_arrival, c.onboard AS onboard_departure FROM (SELECT trip_id, seq, boardings, alightings, sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq) AS onboard FROM visits) c LEFT JOIN (SELECT trip_id, seq, sum(boardings - alightings) OVER (PARTITION BY trip_id ORDER BY seq) AS onboard FROM visits) p ON p.trip_id = c.trip_id AND p.seq = c.seq - 1) q WHERE least(boardings, alightings, onboard_arrival, onboard_departure) < 0 OR alightings > onboard_arrival OR onboard_departure <> onboard_arrival - alightings + boardings",
        "transfers": "SELECT a.trip_id FROM visits a JOIN visits b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE (CASE WHEN a.vehicle_id <> b.vehicle_id THEN a.boardings - a.alightings ELSE 0 END) <> (CASE WHEN a.vehicle_id <> b.vehicle_id THEN b.alightings ELSE 0 END)",
    },
    "v22_count_context": {
        "event_context": "SELECT 1 AS x FROM visits e JOIN (SELECT l_orderkey AS trip_id, l_linenumber AS seq, max(l_partkey) AS arrival_id, min(l_partkey) AS departure_id FROM lineitem GROUP BY l_orderkey, l_linenumber) c ON c.trip_id = e.trip_id AND c.seq = e.seq WHERE e.direction = 'R' OR c.arrival_id IS DISTINCT FROM e.vehicle_id OR c.departure_id IS DISTINCT FROM e.vehicle_id",
        "unique_event": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) <> 1",
    },
    "v23_recount": {
        "boardings": "SELECT t.trip_id FROM trips t WHERE (SELECT count(*) FROM visits v WHERE v.trip_id = t.trip_id) <> (SELECT count(DISTINCT l_linenumber) FROM lineitem l WHERE l.l_orderkey = t.trip_id)",
        "alightings": "SELECT t.trip_id FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n FROM visits WHERE direction = 'R' GROUP BY trip_id) c ON c.trip_id = t.trip_id WHERE coalesce(c.n, 0) > 2",
    },
    "v24_load": {
        "continuity": "SELECT trip_id FROM (SELECT trip_id, seq, boardings, lag(alightings, 1, 0) OVER (PARTITION BY trip_id ORDER BY seq) AS carried FROM visits) q WHERE carried > boardings",
        "terminal": "SELECT trip_id FROM (SELECT trip_id, boardings - alightings AS onboard, row_number() OVER (PARTITION BY trip_id ORDER BY seq DESC) AS n FROM visits) q WHERE n = 1 AND onboard <> 0",
    },
    "v25_vehicle_lifecycle": {"sequence_text": "SELECT 1 AS x FROM (SELECT trip_id, vehicle_id, CAST(seq AS STRING) AS start_seq FROM visits) v JOIN vehicles h ON v.vehicle_id = h.vehicle_id WHERE h.capacity > 10 AND CAST(v.start_seq AS INT) > 5"},
    "v26_nonoverlap": {
        "duties": "SELECT vehicle_id FROM (SELECT vehicle_id, scheduled_s, max(actual_s) OVER (PARTITION BY vehicle_id ORDER BY scheduled_s, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spine WHERE actual_s >= scheduled_s) q WHERE scheduled_s < busy",
        "passengers": "SELECT passenger_id FROM (SELECT passenger_id, scheduled_s, max(scheduled_s + 86400) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM trips) q WHERE scheduled_s < busy",
    },
    "v27_assignment_status": {
        f"{table}_{phase}": f"SELECT 1 AS x FROM (SELECT CASE WHEN v.direction = '{lost}' THEN 'UNKNOWN' ELSE 'KNOWN' END AS assignment_status, CASE WHEN h.capacity IS NOT NULL THEN v.vehicle_id END AS assignment_id FROM spine v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id WHERE {rows}) q WHERE (assignment_status = 'KNOWN') <> (assignment_id IS NOT NULL)"
        for (table, rows) in (("events", "v.actual_s IS NOT NULL"), ("counts", "v.boardings > 0"), ("delays", "v.actual_s > v.scheduled_s"))
        for (phase, lost) in (("arrival", "A"), ("departure", "R"))
    },
    "v28_replacement_phase": {"phases": "SELECT 1 AS x FROM visits a JOIN visits b ON a.trip_id = b.trip_id AND b.seq = a.seq + 1 JOIN trips t ON t.trip_id = a.trip_id WHERE a.vehicle_id <> b.vehicle_id AND b.actual_s < a.actual_s AND a.actual_s BETWEEN t.scheduled_s AND t.scheduled_s + 2592000"},
    "v29_transfers": {
        "counts": "SELECT a.trip_id FROM visits a LEFT JOIN (SELECT trip_id, vehicle_id, count(*) AS n FROM visits GROUP BY trip_id, vehicle_id) c ON c.trip_id = a.trip_id AND c.vehicle_id = a.vehicle_id WHERE c.n <> 1",
        "context": "SELECT a.trip_id FROM spine a JOIN spine b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE a.capacity IS DISTINCT FROM b.capacity",
    },
    "v33_business_context": {
        "tickets": "SELECT 1 AS x FROM trips t JOIN passengers p ON p.passenger_id = t.passenger_id WHERE NOT (p.route_id = t.route_id AND t.fare > 0 AND t.status IN ('O', 'F'))",
        "requests": "SELECT 1 AS x FROM observations o JOIN passengers p ON p.passenger_id = o.route_id WHERE NOT (o.kind <> 'error' AND p.balance > 0)",
    },
    "v34_overcrowding": {"flags": "SELECT 1 AS x FROM visits v JOIN vehicles a ON a.vehicle_id = v.vehicle_id JOIN vehicles b ON b.vehicle_id = v.vehicle_id WHERE v.boardings > a.capacity OR v.alightings > b.capacity"},
    "v35_evidence": {
        "occupancy": "SELECT route_id FROM spine GROUP BY route_id HAVING max(boardings) < 40 OR avg(boardings) > 35",
        "observed_service": "SELECT route_id FROM spine GROUP BY route_id HAVING count(DISTINCT trip_id) < 100",
        "statuses": "SELECT route_id FROM trips GROUP BY route_id HAVING count(DISTINCT status) < 3",
    },
    "v36_used_entities": {
        "unused_stops": "SELECT stop_id FROM stops s WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.stop_id = s.stop_id)",
        "unused_vehicles": "SELECT vehicle_id FROM vehicles h WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.vehicle_id = h.vehicle_id)",
        "floor": "SELECT 1 AS x WHERE (SELECT count(DISTINCT stop_id) FROM visits) < (SELECT count(*) FROM stops)",
    },
    "v37_conditions": {
        "cancellations": "SELECT 1 AS x FROM trips WHERE status = 'P'",
        "early": "SELECT 1 AS x FROM spine WHERE actual_s < scheduled_s",
        "positive_delays": "SELECT 1 AS x FROM spine WHERE actual_s > scheduled_s",
        "replacements": "SELECT trip_id FROM visits GROUP BY trip_id HAVING count(DISTINCT vehicle_id) > 1",
        "overcrowded": "SELECT 1 AS x FROM spine WHERE boardings > capacity",
        "bottlenecks": "SELECT stop_id FROM spine WHERE actual_s - scheduled_s >= 2592000 GROUP BY stop_id",
    },
    "v39_low_and_spike": {
        "low": "SELECT route_id FROM spine GROUP BY route_id HAVING sum(CASE WHEN boardings < 3 THEN 1 ELSE 0 END) = 0",
        "spike": "SELECT route_id FROM spine GROUP BY route_id HAVING sum(CASE WHEN boardings > 90 THEN 1 ELSE 0 END) > 0",
    },
    "v42_new_entities": {
        "late_routes": "SELECT route_id FROM trips GROUP BY route_id HAVING min(service_date) > DATE '1995-02-01'",
        "opening": "SELECT v.stop_id FROM spine v JOIN (SELECT stop_id, min(scheduled_s) AS opened FROM spine WHERE direction = 'N' GROUP BY stop_id) o ON o.stop_id = v.stop_id WHERE v.scheduled_s < o.opened",
    },
    "v50_relationships": {
        "distance_geometry": "SELECT trip_id FROM (SELECT trip_id, sum(boardings) OVER (PARTITION BY trip_id ORDER BY seq) AS far, seq * 10 AS straight FROM visits) q WHERE far < straight - 0.05",
        "plan_versions": "SELECT passenger_id FROM (SELECT passenger_id, scheduled_s, lead(scheduled_s) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS next_s FROM trips) q WHERE next_s = scheduled_s",
        "vehicle_integrity": "SELECT v.vehicle_id FROM visits v LEFT JOIN vehicles h ON h.vehicle_id = v.vehicle_id WHERE h.capacity IS NULL",
        "route_parents": "SELECT 1 AS x FROM trips t LEFT JOIN routes r ON r.route_id = t.route_id WHERE r.route_id IS NULL",
        "opening": "SELECT 1 AS x FROM spine WHERE status = 'O' AND service_date < DATE '1995-03-01'",
        "route_stop_integrity": "SELECT s.stop_id FROM stops s LEFT JOIN routes r ON r.route_id = s.zone_id WHERE r.route_id IS NULL",
        "calendar_compatibility": f"SELECT 1 AS x FROM trips t JOIN passengers p ON p.passenger_id = t.passenger_id WHERE p.segment = 'HOUSEHOLD' AND {WEEKDAY} > 5",
        "duties_nonoverlap": "SELECT vehicle_id FROM (SELECT vehicle_id, scheduled_s, max(actual_s) OVER (PARTITION BY vehicle_id ORDER BY scheduled_s, trip_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM spine WHERE actual_s > scheduled_s) q WHERE scheduled_s < busy + 3600",
        "stop_event_relationships": "SELECT v.trip_id FROM visits v LEFT JOIN stops s ON s.stop_id = v.stop_id LEFT JOIN trips t ON t.trip_id = v.trip_id WHERE s.stop_id IS NULL OR t.trip_id IS NULL OR s.zone_id <> t.route_id",
        "request_relationships": "SELECT o.row_id FROM observations o LEFT JOIN passengers p ON p.passenger_id = o.route_id WHERE p.passenger_id IS NULL",
        "context_relationships": "SELECT c.context_id FROM contexts c LEFT JOIN observations o ON o.row_id = c.context_id WHERE o.row_id IS NULL OR c.ends_s <= c.starts_s",
        "journey_relationships": "SELECT a.trip_id FROM visits a JOIN visits b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE b.stop_id = a.stop_id",
    },
    "v51_temporal": {
        "metadata": "SELECT 1 AS x FROM observations WHERE NOT (at_s <= available_s)",
        "history_bounds": "SELECT 1 AS x FROM trips WHERE service_date < DATE '1995-01-01' OR service_date >= DATE '2001-01-01'",
        "one_plan": "SELECT passenger_id, service_date FROM trips GROUP BY passenger_id, service_date HAVING count(*) > 1",
        "applicable": "SELECT o.row_id FROM observations o JOIN contexts c ON c.route_id = o.route_id WHERE c.starts_s <= o.at_s AND o.at_s < c.ends_s GROUP BY o.row_id HAVING count(*) > 1",
        "purge": "SELECT 1 AS x FROM trips WHERE service_date >= DATE '1996-12-25' AND service_date < DATE '1997-01-01'",
        "complete_availability": "SELECT row_id FROM observations WHERE at_s IS NULL OR available_s IS NULL",
        "trip_time_order": "SELECT trip_id FROM (SELECT trip_id, min(actual_s) AS first_s, max(actual_s) AS last_s, min(scheduled_s) AS planned_s FROM spine GROUP BY trip_id) q WHERE last_s < first_s OR first_s < planned_s",
        "schedule_before_use": "SELECT 1 AS x FROM spine WHERE scheduled_s > actual_s + 86400 * 365",
        "stop_event_order": "SELECT trip_id FROM (SELECT trip_id, actual_s, lag(actual_s) OVER (PARTITION BY trip_id ORDER BY seq) AS before FROM visits) q WHERE actual_s < before",
        "delay_derived": f"SELECT 1 AS x FROM spine WHERE {DELAY} > 0 AND {DELAY} % 86400 <> 0",
        "superseded_unused": "SELECT DISTINCT v.trip_id FROM visits v JOIN trips t ON t.trip_id = v.trip_id WHERE t.status = 'P'",
        "split_membership": "SELECT 1 AS x FROM trips WHERE service_date >= DATE '1999-01-01' AND scheduled_s < 915148800 OR service_date < DATE '1999-01-01' AND scheduled_s >= 915148800",
        "late_revision": "SELECT a.row_id FROM observations a JOIN observations b ON b.route_id = a.route_id AND b.kind = a.kind AND b.at_s = a.at_s AND b.row_id > a.row_id WHERE b.available_s <= a.available_s",
    },
    "v52_counts": {
        "physical": "SELECT 1 AS x FROM spine WHERE boardings < 0 OR alightings < 0 OR alightings > boardings",
        "boundary": "SELECT v.trip_id FROM visits v JOIN (SELECT trip_id, min(seq) AS a, max(seq) AS z FROM visits GROUP BY trip_id) e ON e.trip_id = v.trip_id WHERE v.seq = e.a AND v.alightings > 10 OR v.seq = e.z AND v.boardings > 40",
        "unknown_vehicle": "SELECT 1 AS x FROM spine WHERE capacity IS NULL AND boardings > 0",
        "not_clipped": "SELECT 1 AS x WHERE (SELECT count(*) FROM spine WHERE boardings > capacity) = 0",
        "conservation": "SELECT trip_id FROM visits GROUP BY trip_id HAVING sum(boardings) < sum(alightings) OR sum(boardings) - sum(alightings) > 500",
        "transfer_counters": "SELECT a.trip_id FROM visits a JOIN visits b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE a.vehicle_id <> b.vehicle_id AND b.boardings < a.boardings - a.alightings",
        "capacity_flags": "SELECT 1 AS x FROM spine WHERE (capacity IS NULL) = (CASE WHEN capacity > 0 THEN boardings > capacity END IS NOT NULL)",
        "reconcile_to_lines": "SELECT v.trip_id FROM visits v JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) l ON l.l_orderkey = v.trip_id AND l.l_linenumber = v.seq WHERE l.q <> v.boardings",
        "journeys_nonoverlap": "SELECT passenger_id FROM (SELECT passenger_id, scheduled_s, lag(scheduled_s) OVER (PARTITION BY passenger_id ORDER BY scheduled_s, trip_id) AS before FROM trips) q WHERE scheduled_s < before + 43200",
    },
    "v53_leakage": {
        "cutoff": "SELECT 1 AS x FROM observations WHERE available_s > at_s",
        "planned_information": "SELECT 1 AS x FROM contexts WHERE known_s > starts_s",
        "plan_groups": "SELECT passenger_id FROM trips GROUP BY passenger_id HAVING count(DISTINCT CASE WHEN service_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END) > 1",
        "value_filter": "SELECT 1 AS x FROM (SELECT count(*) AS seen, sum(CASE WHEN available_s <= at_s THEN 1 ELSE 0 END) AS kept FROM observations) q WHERE kept = 0 OR kept = seen",
        "horizon_purge": "SELECT trip_id FROM trips WHERE service_date < DATE '1999-01-01' AND scheduled_s + 604800 >= 915148800",
    },
    "v54_transport": {
        "delay_rate": f"SELECT 1 AS x FROM (SELECT avg(CASE WHEN {DELAY} > 0 THEN 1.0 ELSE 0.0 END) AS rate FROM spine) q WHERE rate < 0.05 OR rate > 0.50",
        "low_demand": "SELECT 1 AS x FROM spine WHERE capacity > 0 AND boardings < 0.2 * capacity",
        "vehicle_change": "SELECT trip_id FROM visits GROUP BY trip_id HAVING min(vehicle_id) <> max(vehicle_id)",
        "early_arrival": "SELECT 1 AS x FROM spine WHERE actual_s < scheduled_s",
        "coverage": "SELECT stop_id FROM stops s WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.stop_id = s.stop_id)",
        "duplicate_fixtures": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey HAVING count(*) > 1",
        "special_event_spike": "SELECT q.service_date FROM (SELECT service_date, sum(boardings) AS b, avg(sum(boardings)) OVER () AS usual FROM spine GROUP BY service_date) q WHERE b > 3 * usual",
        "context_scope": "SELECT c.context_id FROM contexts c LEFT JOIN passengers p ON p.passenger_id = c.route_id WHERE p.passenger_id IS NULL OR c.known_s < c.starts_s",
        "bunching": "SELECT 1 AS x FROM (SELECT route_id, direction, scheduled_s - lag(scheduled_s) OVER (PARTITION BY route_id, direction ORDER BY scheduled_s, trip_id, seq) AS gap FROM spine WHERE seq = 1) q WHERE gap < 300",
        "phase_contract": "SELECT a.trip_id FROM visits a JOIN visits b ON b.trip_id = a.trip_id AND b.seq = a.seq + 1 WHERE a.vehicle_id <> b.vehicle_id AND b.actual_s < a.actual_s",
        "demand_differences": f"SELECT 1 AS x FROM (SELECT avg(CASE WHEN {WEEKDAY} >= 6 THEN boardings END) AS weekend, avg(CASE WHEN {WEEKDAY} < 6 THEN boardings END) AS weekday FROM spine) q WHERE abs(weekend - weekday) > 0.2 * weekday",
    },
    "v58_inspector": {
        "time_inside": "SELECT 1 AS x FROM observations o LEFT JOIN contexts c ON c.route_id = o.route_id AND o.at_s >= c.starts_s AND o.at_s < c.ends_s WHERE c.context_id IS NULL",
        "position_after_duty": "SELECT 1 AS x FROM visits v JOIN trips t ON t.trip_id = v.trip_id WHERE v.actual_s NOT BETWEEN t.scheduled_s AND t.scheduled_s + 10368000",
        "duplicate_copies": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity HAVING count(*) > 1",
        "torn_rows": "SELECT 1 AS x FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL OR l_quantity IS NULL OR l_returnflag IS NULL",
    },
}

def counted(family: str) -> str:
    """SQL for the number of violations of each check of a family, each by a SELECT of its own."""
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS check_name, CAST(count(*) AS BIGINT) AS violations FROM ({sql}) v_{i}" for i, (c, sql) in enumerate(CHECKS[family].items()))


#: families that run check by check; the others are planned in one pass a table by ``plans.fused``
for _name in CHECKS:
    if _name not in ("v50_relationships", "v51_temporal", "v52_counts", "v53_leakage", "v54_transport", "v58_inspector"):
        portable(_name, counted(_name))

_LOCAL_HOUR = "CAST(floor((scheduled_s + 18000) / 3600) AS BIGINT) % 24"
portable(
    "v38_demand_differences",
    f"""SELECT category, CAST(count(DISTINCT trip_id) AS BIGINT) AS trips_n, CAST(sum(boardings) AS BIGINT) AS movements, round(avg(boardings), 6) AS mean FROM (
SELECT CASE WHEN {WEEKDAY} >= 6 THEN 'weekend' ELSE 'weekday' END AS category, trip_id, boardings FROM spine
UNION ALL SELECT CASE WHEN {_LOCAL_HOUR} BETWEEN 7 AND 9 OR {_LOCAL_HOUR} BETWEEN 16 AND 19 THEN 'peak' ELSE 'off-peak' END, trip_id, boardings FROM spine
UNION ALL SELECT 'month ' || substr(CAST(service_date AS STRING), 6, 2), trip_id, boardings FROM spine
UNION ALL SELECT 'direction ' || direction, trip_id, boardings FROM spine) q GROUP BY category""",
)
@query("v31_position_context", """SELECT 'context' AS check_name, count(*) AS violations FROM observations o JOIN contexts c ON c.route_id = o.route_id WHERE o.at_s BETWEEN c.starts_s AND c.ends_s AND o.kind <> 'error'
UNION ALL SELECT 'assignment', count(*) FROM observations o LEFT JOIN passengers p ON p.passenger_id = o.route_id WHERE p.passenger_id IS NULL OR o.available_s < o.at_s""")
def position_context(r: Roles) -> DataFrame:
    """Positions inside a context of their route, each context counted; positions of nobody, or published before they were taken."""
    inside = intervals.active_counts(r.observations.filter("kind <> 'error'"), r.contexts, "row_id", [("route_id", "route_id")], "context_id", "at_s", "starts_s", "ends_s")
    o = r.observations.join(r.passengers.select("passenger_id"), F.col("route_id") == F.col("passenger_id"), "left")
    context = inside.agg(F.lit("context").alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return context.unionByName(o.agg(F.lit("assignment").alias("check_name"), F.count_if(F.expr("passenger_id IS NULL OR available_s < at_s")).alias("violations")))


@query("v32_delay_scope", "SELECT 'scopes' AS check_name, count(*) AS violations FROM (SELECT o.row_id FROM observations o JOIN contexts c ON c.route_id = o.route_id AND o.available_s BETWEEN c.starts_s AND c.ends_s UNION SELECT o.row_id FROM observations o JOIN contexts c ON c.stop_id = o.row_id + 1 AND o.available_s BETWEEN c.starts_s AND c.ends_s) q")
def delay_scope(r: Roles) -> DataFrame:
    """Publications inside a context of their route, or of the stop that follows."""
    o = r.observations.withColumn("next_id", F.col("row_id") + 1)
    n = intervals.active_counts(o, r.contexts, "row_id", [("route_id", "route_id"), ("next_id", "stop_id")], "context_id", "available_s", "starts_s", "ends_s")
    return n.agg(F.lit("scopes").alias("check_name"), F.count_if(F.col("n") > 0).alias("violations"))


@query("v40_event_demand", """WITH hit AS (SELECT DISTINCT o.row_id FROM observations o JOIN contexts c ON c.route_id = o.route_id AND o.at_s BETWEEN c.starts_s AND c.ends_s)
SELECT CASE WHEN h.row_id IS NULL THEN 'baseline' ELSE 'event' END AS side, CAST(count(*) AS BIGINT) AS n, round(avg(o.target), 6) AS mean FROM observations o LEFT JOIN hit h ON h.row_id = o.row_id GROUP BY CASE WHEN h.row_id IS NULL THEN 'baseline' ELSE 'event' END""")
def event_demand(r: Roles) -> DataFrame:
    """Demand inside a context of the route and outside of all."""
    n = intervals.active_counts(r.observations, r.contexts, "row_id", [("route_id", "route_id")], "context_id", "at_s", "starts_s", "ends_s").withColumnRenamed("n", "contexts_n")
    side = F.when(F.col("contexts_n") > 0, "event").otherwise("baseline").alias("side")
    return r.observations.join(n, "row_id").groupBy(side).agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean"))


portable(
    "v41_headway_irregularity",
    """SELECT route_id, direction, CAST(sum(CASE WHEN gap < 0.25 * planned OR planned = 0 AND gap < 300 THEN 1 ELSE 0 END) AS BIGINT) AS bunched, CAST(sum(CASE WHEN gap <= 0 OR abs(gap - planned) > greatest(300, 0.5 * planned) THEN 1 ELSE 0 END) AS BIGINT) AS irregular
FROM (SELECT route_id, direction, actual_s - lag(actual_s) OVER w AS gap, abs(scheduled_s - lag(scheduled_s) OVER w) AS planned FROM spine WHERE seq = 1 WINDOW w AS (PARTITION BY route_id, direction, service_date ORDER BY scheduled_s, trip_id)) q GROUP BY route_id, direction""",
)
@query("v30_delay_derivation", """SELECT 'seconds' AS check_name, count(*) AS violations FROM spine e JOIN (SELECT l_orderkey, l_linenumber, max(l_partkey) AS assignment_id, max(epoch_us(l_shipdate) // 1000000) AS late_s FROM lineitem GROUP BY l_orderkey, l_linenumber) d ON d.l_orderkey = e.trip_id AND d.l_linenumber = e.seq
WHERE d.assignment_id IS DISTINCT FROM e.vehicle_id OR greatest(0, d.late_s - e.scheduled_s) <> greatest(0, e.actual_s - e.scheduled_s) OR d.late_s <= e.scheduled_s""")
def delay_derivation(r: Roles) -> DataFrame:
    """Delays as recorded (the last of an event's lines) that are not those of the event, or no delays."""
    recorded = r.table("lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(F.max("l_partkey").alias("assignment_id"), seconds("max(l_shipdate)").alias("late_s"))
    x = r.spine.join(recorded, ["trip_id", "seq"])
    late = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("scheduled_s"))
    bad = ~F.col("assignment_id").eqNullSafe(F.col("vehicle_id")) | (late("late_s") != late("actual_s")) | (F.col("late_s") <= F.col("scheduled_s"))
    return x.agg(F.lit("seconds").alias("check_name"), F.count_if(bad).alias("violations"))
