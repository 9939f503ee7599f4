"""The transport roles that the star-schema tables play.

Operators take frames and column names; these views bind them. Each view is given twice, as a
DataFrame and as the SQL of a common table expression, so that a query and the SQL it is checked
against start from the same rows. Instants are whole seconds since 1970 (``*_s``), which needs no
session time zone.
"""

from __future__ import annotations

from functools import cached_property, reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seconds(column: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


#: rows of a part into which a table is dealt out; a task's sorts and sums then hold no more, however large the table
PART_ROWS = 250_000
#: parts from which on lines are grouped by hashing, and values up to which their directions are numbered for it
HASHED_PARTS, CODES = 10, 16


class Roles:
    """Frames by role over the tables of one folder; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def routes(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("route_code"), F.col("r_name").alias("mode"))

    @cached_property
    def stops(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_code"), F.col("s_nationkey").alias("zone_id"))

    @cached_property
    def vehicles(self) -> DataFrame:
        capacity = F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("capacity")  # every tenth size: unknown
        return self.table("part").select(F.col("p_partkey").alias("vehicle_id"), F.col("p_brand").alias("operator"), F.col("p_type").alias("vehicle_type"), capacity)

    @cached_property
    def passengers(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("passenger_id"), F.col("c_nationkey").alias("route_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def trips(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
            F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("passenger_id"), F.col("c_nationkey").alias("route_id"), F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("service_date"), seconds("o_orderdate").alias("scheduled_s"), F.col("o_totalprice").alias("fare"),
        )

    @cached_property
    def parts(self) -> int:
        """In how many parts lines, or what there is one of a line, are dealt out; the file footers know their number."""
        return max(1, ceil(self.table("lineitem").count() / PART_ROWS))

    @cached_property
    def lines(self) -> DataFrame:
        """Lines dealt out by trip: what goes by trip needs no other exchange.

        Nearly every line is a visit of its own, so sums before the exchange would hold as many rows as a task reads and write more than the lines themselves.
        """
        return self.table("lineitem").repartition(self.parts, "l_orderkey")

    @cached_property
    def directions(self) -> list[str] | None:
        """The directions in their order where lines are many and directions few, so that the least one is the least number."""
        if self.parts < HASHED_PARTS:
            return None
        some = self.table("lineitem").filter("l_returnflag is not null").select("l_returnflag").distinct().take(CODES + 1)
        return sorted(x.l_returnflag for x in some) if 0 < len(some) <= CODES else None

    @cached_property
    def visits(self) -> DataFrame:
        """Lines by trip and place in it. To find the least of strings Spark sorts all lines, the least of their numbers it finds by hashing."""
        flag = F.col("l_returnflag")
        direction = F.min(flag)
        if self.directions:
            number = F.min(reduce(lambda w, x: w.when(flag == x[1], x[0]), enumerate(self.directions), F.when(F.lit(False), -1)))
            direction = reduce(lambda w, x: w.when(number == x[0], x[1]), enumerate(self.directions), F.when(F.lit(False), ""))
        return self.lines.groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("seq")).agg(
            F.min("l_suppkey").alias("stop_id"), F.min("l_partkey").alias("vehicle_id"), direction.alias("direction"), seconds("min(l_shipdate)").alias("actual_s"),
            F.sum("l_quantity").cast("long").alias("boardings"), F.floor(F.sum("l_quantity") / 2).cast("long").alias("alightings"),
        )

    @cached_property
    def spine(self) -> DataFrame:
        """Visits with their trips and capacities; where vehicles are too many to be sent to every task, in as many parts as the lines."""
        v, h = self.visits.join(self.trips, "trip_id"), self.vehicles.select("vehicle_id", "capacity")
        if self.table("part").count() > PART_ROWS:
            v = v.repartition(self.parts, "vehicle_id")
        else:
            h = F.broadcast(h)
        return v.join(h, "vehicle_id", "left").select("trip_id", "seq", "stop_id", "vehicle_id", "direction", "actual_s", "boardings", "alightings", "route_id", "status", "service_date", "scheduled_s", "capacity")

    @cached_property
    def observations(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("route_id"), F.col("event_type").alias("kind"), seconds("ts").alias("at_s"), F.col("value").alias("target"), (seconds("ts") + F.col("event_id") % 5 * 3600).alias("available_s"), F.col("props"))

    @cached_property
    def observation_parts(self) -> int:
        """In how many parts what there is one of an observation is dealt out: no fewer than the session's, for models are fitted on them."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), ceil(self.table("events").count() / PART_ROWS))

    @cached_property
    def mark_parts(self) -> int:
        """In how many parts what there are two of an observation is dealt out: when it asks and when it tells."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * self.table("events").count() / PART_ROWS))

    @cached_property
    def contexts(self) -> DataFrame:
        """Disturbances: [starts, ends] on a route, known ten minutes after they start."""
        return self.observations.filter("kind = 'error'").select(F.col("row_id").alias("context_id"), "route_id", F.col("row_id").cast("long").alias("stop_id"), F.col("at_s").alias("starts_s"), (F.col("at_s") + 21600).alias("ends_s"), (F.col("at_s") + 600).alias("known_s"))


SQL = {
    "routes": "SELECT n_nationkey AS route_id, n_name AS route_code, r_name AS mode FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "stops": "SELECT s_suppkey AS stop_id, s_name AS stop_code, s_nationkey AS zone_id FROM supplier",
    "vehicles": "SELECT p_partkey AS vehicle_id, p_brand AS operator, p_type AS vehicle_type, CASE WHEN p_size % 10 <> 0 THEN p_size END AS capacity FROM part",
    "passengers": "SELECT c_custkey AS passenger_id, c_nationkey AS route_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "trips": "SELECT o_orderkey AS trip_id, o_custkey AS passenger_id, c_nationkey AS route_id, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS service_date, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS scheduled_s, o_totalprice AS fare FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "visits": "SELECT l_orderkey AS trip_id, l_linenumber AS seq, min(l_suppkey) AS stop_id, min(l_partkey) AS vehicle_id, min(l_returnflag) AS direction, CAST(epoch_us(min(l_shipdate)) // 1000000 AS BIGINT) AS actual_s, CAST(sum(l_quantity) AS BIGINT) AS boardings, CAST(floor(sum(l_quantity) / 2) AS BIGINT) AS alightings FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "spine": "SELECT trip_id, seq, stop_id, v.vehicle_id, direction, actual_s, boardings, alightings, route_id, status, service_date, scheduled_s, capacity FROM visits v JOIN trips t USING (trip_id) LEFT JOIN vehicles h ON v.vehicle_id = h.vehicle_id",
    "observations": "SELECT event_id AS row_id, user_id AS route_id, event_type AS kind, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at_s, value AS target, CAST(epoch_us(ts) // 1000000 AS BIGINT) + event_id % 5 * 3600 AS available_s, props FROM events",
    "contexts": "SELECT row_id AS context_id, route_id, row_id AS stop_id, at_s AS starts_s, at_s + 21600 AS ends_s, at_s + 600 AS known_s FROM observations WHERE kind = 'error'",
}
_NEEDS = {"spine": ["trips", "visits", "vehicles"], "contexts": ["observations"]}


def with_roles(sql: str) -> str:
    """``sql`` over role names, with the views it mentions put before it."""
    import re

    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    names = list(dict.fromkeys(x for n in used for x in [*_NEEDS.get(n, []), n]))
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    if not head:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
