"""Data-quality queries: one per rule, over rows in which the defects occur by themselves or by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.operators import quality as q
from korridor.operators import windows
from korridor.plans.registry import query
from korridor.roles import Roles

# tickets: trips with a text timestamp, a status and a vehicle, some of which are not usable
TICKETS = """tickets AS (SELECT trip_id, CASE WHEN trip_id % 9 = 0 THEN NULL WHEN trip_id % 7 = 0 THEN '2025-13-99T25:61:00' ELSE CAST(service_date AS VARCHAR) END AS issued_at, CASE WHEN trip_id % 11 = 0 THEN NULL WHEN trip_id % 5 = 0 THEN 'ODD' ELSE 'VALID' END AS quality_status, CASE WHEN trip_id % 6 = 0 THEN '' ELSE CAST(passenger_id AS VARCHAR) END AS holder, passenger_id, service_date FROM trips)"""


def tickets(r: Roles) -> DataFrame:
    i = F.col("trip_id")
    issued = F.when(i % 9 == 0, None).when(i % 7 == 0, "2025-13-99T25:61:00").otherwise(F.col("service_date").cast("string"))
    status = F.when(i % 11 == 0, None).when(i % 5 == 0, "ODD").otherwise("VALID")
    return r.trips.select("trip_id", issued.alias("issued_at"), status.alias("quality_status"), F.when(i % 6 == 0, "").otherwise(F.col("passenger_id").cast("string")).alias("holder"), "passenger_id", "service_date")


def _rule(name: str, rule: str, table: str, row: str, column: str, bad: str, frame, spark_bad=None) -> None:
    """A rule as issue rows; ``bad`` is the condition in SQL, ``spark_bad`` where Spark says it otherwise."""
    base = f"WITH {TICKETS} " if table == "tickets" else ""
    sql = f"{base}SELECT '{table}' AS table_name, CAST({row} AS VARCHAR) AS source_row_id, '{rule}' AS rule_id, 'FLAGGED' AS status, '{column}' AS column_name, CAST({column} AS VARCHAR) AS raw_value FROM {table} WHERE {bad}"

    @query(name, sql)
    def build(r: Roles) -> DataFrame:
        return q.issues(frame(r), row, rule, F.expr(bad) if spark_bad is None else spark_bad(), column, table)


@query("q01_invalid_timestamp", f"WITH {TICKETS} SELECT trip_id, issued_at AS raw, CAST(TRY_CAST(issued_at AS DATE) AS VARCHAR) AS day, CASE WHEN issued_at IS NOT NULL AND TRY_CAST(issued_at AS DATE) IS NULL THEN 'FLAGGED' ELSE quality_status END AS quality_status FROM tickets")
def invalid_timestamp(r: Roles) -> DataFrame:
    x = q.typed_timestamps(tickets(r), ["issued_at"])
    return x.select("trip_id", F.col("raw_timestamp__issued_at").alias("raw"), F.date_format("issued_at", "yyyy-MM-dd").alias("day"), "quality_status")


_rule("q02_missing_row_id", "MISSING_SOURCE_ROW_ID", "tickets", "trip_id", "holder", "holder IS NULL OR holder = ''", tickets)
_rule("q03_invalid_status", "INVALID_QUALITY_STATUS", "tickets", "trip_id", "quality_status", "quality_status IS NULL OR quality_status NOT IN ('VALID', 'ACCEPTED', 'FLAGGED', 'UNRESOLVED')", tickets)
_rule("q04_missing_date", "MISSING_SERVICE_DATE", "tickets", "trip_id", "issued_at", "issued_at IS NULL", tickets)
_rule("q05_future_leakage", "FUTURE_LEAKAGE", "observations", "row_id", "available_s", "available_s > at_s", lambda r: r.observations)
_rule("q06_known_schedule", "KNOWN_SCHEDULE", "contexts", "context_id", "known_s", "known_s IS NULL OR known_s > starts_s", lambda r: r.contexts)
_rule("q10_missing_id", "DQ-MISSING-ID", "tickets", "trip_id", "holder", "holder IS NULL OR holder = ''", tickets, lambda: q.missing("holder"))
_rule("q14_negative_count", "DQ-NEGATIVE-COUNT", "spine", "trip_id", "boardings", "boardings - 10 < 0", lambda r: r.spine)
_rule("q15_timestamp_range", "DQ-INVALID-TIMESTAMP", "trips", "trip_id", "service_date", "service_date IS NULL OR service_date < DATE '1995-02-01' OR service_date > DATE '2001-06-01'", lambda r: r.trips)
_rule("q16_departure_before_arrival", "DQ-DEPARTURE-BEFORE-ARRIVAL", "spine", "trip_id", "actual_s", "actual_s IS NOT NULL AND scheduled_s IS NOT NULL AND actual_s < scheduled_s", lambda r: r.spine)
_rule("q17_capacity", "DQ-CAPACITY", "spine", "trip_id", "boardings", "boardings > capacity", lambda r: r.spine)
_rule("q18_invalid_delay", "DQ-INVALID-DELAY", "spine", "trip_id", "actual_s", "actual_s - scheduled_s < 0", lambda r: r.spine)
_rule("q19_missing_vehicle", "DQ-MISSING-VEHICLE", "spine", "trip_id", "capacity", "capacity IS NULL", lambda r: r.spine)
_rule("q21_distance", "DQ-DISTANCE", "passengers", "passenger_id", "segment", "balance <= 0", lambda r: r.passengers)


@query("q11_invalid_stop", "SELECT trip_id, seq, stop_id FROM visits WHERE stop_id IS NOT NULL AND stop_id NOT IN (SELECT stop_id FROM stops WHERE zone_id < 20)")
def invalid_stop(r: Roles) -> DataFrame:
    return q.unknown(r.visits, "stop_id", r.stops.filter("zone_id < 20"), "stop_id").select("trip_id", "seq", "stop_id")


@query("q12_duplicate_ticket", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_ticket(r: Roles) -> DataFrame:
    x = r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return q.repeated(x, "k").drop("k")


@query("q13_duplicate_trip", "SELECT trip_id, passenger_id FROM trips WHERE passenger_id IN (SELECT passenger_id FROM trips GROUP BY passenger_id HAVING count(*) > 1)")
def duplicate_trip(r: Roles) -> DataFrame:
    return q.repeated(r.trips.select("trip_id", "passenger_id"), "passenger_id")


@query("q20_stop_sequence", "SELECT DISTINCT trip_id FROM (SELECT trip_id, seq - lag(seq) OVER (PARTITION BY trip_id ORDER BY seq) AS step FROM visits) s WHERE step <> 1")
def stop_sequence(r: Roles) -> DataFrame:
    return windows.sequence_gap(r.visits, ["trip_id"], "seq").filter("has_gap").select("trip_id").distinct()


@query("q22_unknown_passenger", "SELECT row_id FROM observations WHERE route_id NOT IN (SELECT passenger_id FROM passengers WHERE balance > 0)")
def unknown_passenger(r: Roles) -> DataFrame:
    return q.unknown(r.observations.select("row_id", "route_id"), "route_id", r.passengers.filter("balance > 0"), "passenger_id").select("row_id")


@query("q23_missing_trip", "SELECT row_id FROM observations WHERE row_id NOT IN (SELECT trip_id FROM trips WHERE status = 'O')")
def missing_trip(r: Roles) -> DataFrame:
    return q.unknown(r.observations.select("row_id"), "row_id", r.trips.filter("status = 'O'"), "trip_id").select("row_id")


DISPOSITION = "CASE WHEN trip_id % 9 = 0 THEN 'QUARANTINED' WHEN trip_id % 7 = 0 THEN 'FLAGGED' WHEN trip_id % 11 = 0 THEN 'CORRECTED' ELSE 'UNCHANGED' END"


@query("q30_dq_reconciliation", f"SELECT status, count(*) AS raw, count(CASE WHEN d = 'UNCHANGED' THEN 1 END) AS unchanged, count(CASE WHEN d = 'CORRECTED' THEN 1 END) AS corrected, count(CASE WHEN d = 'FLAGGED' THEN 1 END) AS flagged, count(CASE WHEN d = 'QUARANTINED' THEN 1 END) AS quarantined, true AS balanced FROM (SELECT status, {DISPOSITION} AS d FROM trips) x GROUP BY status")
def dq_reconciliation(r: Roles) -> DataFrame:
    return q.reconciliation(r.trips.withColumn("d", F.expr(DISPOSITION)), "d", "status")
