"""Which rows may be a case of a task: every condition by name, so that exclusions can be counted by reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(*columns: str) -> dict[str, Column]:
    return {f"{c} present": F.col(c).isNotNull() for c in columns}


def finite(*columns: str) -> dict[str, Column]:
    return {f"{c} finite": F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns}


def delay(labels: tuple[str, ...], begins_s: int, ends_s: int) -> dict[str, Column]:
    """A stop event whose label, schedule and outcome all belong to the period, known in time."""
    return {
        "label known": F.col("label").isin(*labels),
        **present("service_date", "trip_id", "seq", "scheduled_s", "cutoff_s", "known_s", "target_available_s"),
        "cutoff at schedule": F.col("cutoff_s") == F.col("scheduled_s"),
        "schedule known": F.col("known_s") <= F.col("cutoff_s"),
        "begins inside": (F.col("scheduled_s") >= begins_s) & (F.col("scheduled_s") < ends_s),
        "outcome after": F.col("target_available_s") >= F.col("scheduled_s"),
        "outcome inside": F.col("target_available_s") <= ends_s,
        **finite("hour", "weekday", "month", "direction_id", "distance"),
    }


def occupancy(begins_s: int, ends_s: int) -> dict[str, Column]:
    """A departure whose load and vehicle are recorded, consistent, and not yet known at the cutoff."""
    return {
        **present("service_date", "seq", "stop_id", "route_id", "direction", "trip_id", "cutoff_s", "event_available_s", "assignment_available_s"),
        "assignment valid": F.col("assignment_quality") == "VALID",
        "assignment actual": F.col("assignment_kind") == "ACTUAL",
        "assignment capacity": F.col("assignment_capacity") == F.col("capacity"),
        **present("known_s", "schedule_known_s", "route_known_s", "stop_known_s", "pattern_published_s", "offsets_known_s"),
        "known in time": F.col("known_s") <= F.col("cutoff_s"),
        "load unknown at cutoff": F.col("load_available_s") > F.col("cutoff_s"),
        "departs after cutoff": F.col("actual_s") > F.col("cutoff_s"),
        "begins inside": (F.col("cutoff_s") >= begins_s) & (F.col("cutoff_s") < ends_s),
        "load inside": F.col("load_available_s") <= ends_s,
        "assignment covers": (F.col("assignment_start_s") <= F.col("actual_s")) & (F.col("actual_s") < F.col("assignment_end_s")),
        "occupancy available": F.col("occupancy_status") == "AVAILABLE",
        "load present": F.col("load").isNotNull() & (F.col("load") >= 0),
        "capacity positive": F.col("capacity").isNotNull() & (F.col("capacity") > 0),
        "utilization present": F.col("utilization").isNotNull() & (F.col("utilization") >= 0),
        "utilization consistent": F.col("utilization") == F.col("load").cast("double") / F.col("capacity").cast("double"),
        "over capacity consistent": F.col("over_capacity") == (F.col("utilization") > 1.0),
        **present("distance", "stop_sequence"),
    }


def eligible(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, conditions.values()))


def reasons(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """reason, n: how many rows fail each condition, in one pass."""
    sums = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*(F.col(f"`{n}`") for n in conditions)))).alias("reason", "n"))
