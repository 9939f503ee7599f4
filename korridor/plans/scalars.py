"""Scalar function families, pluggable predicates and capability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import quality, transit
from korridor.plans.registry import portable, query
from korridor.roles import Roles


@query("f02_calendar_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, isodow(o_orderdate) AS weekday, quarter(o_orderdate) AS q FROM orders")
def calendar_parts(r: Roles) -> DataFrame:
    d = F.col("o_orderdate")
    return r.table("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), (F.weekday(d) + 1).alias("weekday"), F.quarter(d).alias("q"))


@query("f05_literals", "SELECT trip_id FROM trips WHERE scheduled_s >= epoch_us(TIMESTAMP '1996-01-01 00:00:00') // 1000000 AND service_date < DATE '1996-02-01'")
def literals(r: Roles) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'1996-01-01 00:00:00')")
    return r.trips.filter((F.col("scheduled_s") >= start) & (F.col("service_date") < F.to_date(F.lit("1996-02-01")))).select("trip_id")


@query("f06_peak_bands", "SELECT row_id, CASE WHEN h BETWEEN 7 AND 9 THEN 'MORNING' WHEN h BETWEEN 16 AND 19 THEN 'EVENING' ELSE 'OFF' END AS band FROM (SELECT row_id, CAST(floor((at_s + 18000) / 3600) % 24 AS BIGINT) AS h FROM observations) q")
def peak_bands(r: Roles) -> DataFrame:
    h = transit.hour("at_s", 18_000)
    return r.observations.select("row_id", F.when(h.between(7, 9), "MORNING").when(h.between(16, 19), "EVENING").otherwise("OFF").alias("band"))


portable("f07_month_key", "SELECT substr(CAST(service_date AS STRING), 1, 7) AS month_key, count(*) AS n FROM trips GROUP BY substr(CAST(service_date AS STRING), 1, 7)")
portable("f08_fixed_shift", "SELECT row_id, at_s - 18000 AS shifted_s FROM observations")


@query("f09_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_text(r: Roles) -> DataFrame:
    return r.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


portable("f11_math", "SELECT trip_id, seq, abs(actual_s - scheduled_s) AS apart_s, CAST(floor(boardings / 3) AS BIGINT) AS thirds, CASE WHEN capacity > 0 THEN round(CAST(boardings AS DOUBLE) / capacity, 4) END AS guarded FROM spine")


@query("f15_interpolated", "SELECT row_id, round(10.0 + 5.0 * least(1.0, greatest(0.0, target / 50)), 6) AS at FROM observations")
def interpolated(r: Roles) -> DataFrame:
    return r.observations.select("row_id", F.round(scalars.interpolate(F.lit(10.0), F.lit(15.0), F.col("target") / 50), 6).alias("at"))


@query("x03_pluggable_predicate", "SELECT 'spine' AS table_name, CAST(trip_id AS VARCHAR) AS source_row_id, 'ODD-LOAD' AS rule_id, 'FLAGGED' AS status, 'boardings' AS column_name, CAST(boardings AS VARCHAR) AS raw_value FROM spine WHERE boardings % 2 = 1")
def pluggable_predicate(r: Roles) -> DataFrame:
    odd = lambda c: F.col(c) % 2 == 1
    return quality.issues(r.spine, "trip_id", "ODD-LOAD", odd("boardings"), "boardings", "spine")


@query("b02_dispatch", "SELECT route_id, direction, count(*) AS n FROM spine WHERE route_id = 3 AND direction = 'N' GROUP BY route_id, direction")
def dispatch(r: Roles) -> DataFrame:
    from korridor.serving import answer

    return answer(r.spark, r.sf_dir, "passengerFlow", "directionalSummary", {"routeId": 3, "direction": "N", "stopId": ""})


