"""Recommendation rules and the FIFO queue behind what-if scenarios, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RULES = ("increase_frequency", "reduce_underutilized_service", "modify_schedule", "higher_capacity_vehicle", "investigate_bottleneck", "adjust_departure_time", "improve_headways")


def band(value: Column, limits: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [(value >= x).cast("int") for x in limits])


def priority(passengers: Column, severity: Column, impact: list[float], severe: list[float]) -> Column:
    """The mean of impact and severity bands, rounded down, as one of four levels."""
    return F.element_at(F.array(*map(F.lit, PRIORITIES)), F.floor((band(passengers, impact) + band(severity, severe)) / 2).cast("int") + 1)


def recommend(metrics: DataFrame, entity: str, policy: dict) -> DataFrame:
    """entity, rule, status, severity, priority for every rule: TRIGGERED, NO_ACTION or NOT_READY.

    ``metrics`` has a row per entity with ``sample_count``, ``affected_passengers`` and the rules'
    measures. Too few samples or a missing measure is NOT_READY, never a no; a column or policy value
    that is not there is missing for all. The rows of one entity are made by one explode, so the
    metrics are read once.
    """
    measure = lambda c, kind="double": F.col(c) if c in metrics.columns else F.lit(None).cast(kind)
    limit = lambda c: F.lit(policy.get(c)).cast("double")
    recurs = lambda c: measure(c) >= policy["minimum_days"]
    load, before, after, shift = (measure(c) for c in ("mean_occupancy_ratio", "current_expected_wait_minutes", "alternative_expected_wait_minutes", "evaluated_shift_minutes"))
    busy, full, under = load / limit("overload_ratio"), measure("peak_occupancy_ratio") / limit("overload_ratio"), limit("underutilization_ratio")
    late, slow, uneven = measure("late_fraction") / limit("late_fraction"), measure("mean_delay_s") / limit("bottleneck_delay_s"), measure("headway_cv") / limit("headway_cv")
    social, covered = measure("social_service_required", "boolean"), measure("coverage_preserved", "boolean")
    # rule: severity, whether it holds, what else must be known
    rules = {
        "increase_frequency": (busy, (busy > 1) & recurs("overload_days"), []),
        "reduce_underutilized_service": (F.when(load.isNotNull(), 1 + F.greatest(F.lit(0.0), under - load) / under), (load < under) & recurs("underutilized_days") & ~social & covered, [social, covered]),
        "modify_schedule": (late, (late >= 1) & recurs("late_days"), []),
        "higher_capacity_vehicle": (full, (full > 1) & recurs("overload_days"), []),
        "investigate_bottleneck": (slow, (slow >= 1) & recurs("late_days"), []),
        "adjust_departure_time": (F.when(before > 0, 1 + (before - after) / before).when(after.isNotNull() & before.isNotNull(), 0.0), before > after, [F.nullif(shift, F.lit(0.0)), measure("trip_id")]),
        "improve_headways": (uneven, (uneven >= 1) & recurs("irregular_headway_days"), []),
    }
    days = {"increase_frequency": "overload_days", "reduce_underutilized_service": "underutilized_days", "modify_schedule": "late_days", "higher_capacity_vehicle": "overload_days", "investigate_bottleneck": "late_days", "improve_headways": "irregular_headway_days"}
    cases = []
    for rule in RULES:
        severity, holds, known = rules[rule]
        known = [severity, *known, *([measure(days[rule])] if rule in days else [])]
        ready = reduce(lambda a, b: a & b, [x.isNotNull() for x in known], F.col("sample_count") >= policy["minimum_samples"])
        status = F.when(~ready | ready.isNull(), "NOT_READY").when(holds, "TRIGGERED").otherwise("NO_ACTION")
        cases.append(F.struct(F.lit(rule).alias("rule"), status.alias("status"), severity.alias("severity")))
    out = metrics.select(entity, "affected_passengers", F.explode(F.array(*cases)).alias("c")).select(entity, "affected_passengers", "c.*")
    level = priority(F.col("affected_passengers"), F.col("severity"), policy["passenger_impact_bands"], policy["severity_bands"])
    return out.withColumn("priority", F.when(F.col("status") == "TRIGGERED", level)).drop("affected_passengers")


def arrived(minute: Column, profile: str = "profile") -> Column:
    """Passengers that have arrived by a minute, of piecewise even arrivals."""
    part = lambda p: p["passengers"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (minute - p["start"]) / (p["end"] - p["start"])))
    return F.aggregate(profile, F.lit(0.0), lambda s, p: s + part(p))


def simulate(states: DataFrame, crowding: float = 1.0) -> DataFrame:
    """Add what the queue does to each state.

    A state has ``trips`` (minute, capacity) and ``profile`` (start, end, passengers). With A(t) the
    arrivals by t, departure i leaves S_i = min(A(t_i), S_(i-1) + capacity_i) passengers served in
    all. Served first-come first-served, their waiting adds up to the sum of t_i (S_i - S_(i-1))
    less the sum of the first S_n arrival times, which needs no queue to be kept. A departure is crowded
    if more than ``crowding`` times its capacity waits for it.
    """
    step = lambda s, t: F.struct(
        F.least(arrived(t["minute"]), s["served"] + t["capacity"]).alias("served"),
        (s["left_at"] + t["minute"] * (F.least(arrived(t["minute"]), s["served"] + t["capacity"]) - s["served"])).alias("left_at"),
        F.greatest(s["peak"], (arrived(t["minute"]) - s["served"]) / t["capacity"]).alias("peak"),
        (s["crowded"] + F.when(arrived(t["minute"]) - s["served"] > t["capacity"] * crowding, 1.0).otherwise(0.0)).alias("crowded"),
    )
    start = F.struct(F.lit(0.0).alias("served"), F.lit(0.0).alias("left_at"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("crowded"))
    came = lambda s, p: F.struct(
        (s["left"] - F.least(s["left"], p["passengers"])).alias("left"),
        (s["sum"] + F.when(p["passengers"] > 0, F.least(s["left"], p["passengers"]) * (p["start"] + F.least(s["left"], p["passengers"]) * (p["end"] - p["start"]) / (2 * p["passengers"]))).otherwise(0.0)).alias("sum"),
    )
    x = states.withColumn("_r", F.aggregate(F.array_sort("trips"), start, step))
    x = x.withColumn("_came", F.aggregate(F.array_sort("profile"), F.struct(F.col("_r.served").alias("left"), F.lit(0.0).alias("sum")), came)["sum"])
    demand, capacity = F.aggregate("profile", F.lit(0.0), lambda s, p: s + p["passengers"]), F.aggregate("trips", F.lit(0.0), lambda s, t: s + t["capacity"])
    served = F.col("_r.served")
    return x.withColumns({
        "demand": demand, "capacity": capacity, "served": served, "unserved": F.greatest(F.lit(0.0), demand - served), "wait_minutes": F.when(served > 0, (F.col("_r.left_at") - F.col("_came")) / served),
        "coverage": F.when(demand > 0, served / demand), "occupancy": served / capacity, "overcrowding": F.col("_r.crowded") / F.size("trips"), "peak_load_ratio": F.col("_r.peak"),
    }).drop("_r", "_came")


def state_problem(window: float) -> Column:
    """What keeps a state from being simulated, null if nothing: trips, their minutes and capacities, a profile that covers the window."""
    trips, profile = F.array_sort("trips"), F.array_sort("profile")
    ends = F.transform(profile, lambda p: p["end"])
    gap = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(profile))), lambda i: (i <= F.size(profile)) & (F.abs(F.try_element_at(F.transform(profile, lambda p: p["start"]), i) - F.try_element_at(ends, i - 1)) > 1e-9))
    return (
        F.when(F.col("trips").isNull() | (F.size("trips") < 1), "NO_TRIPS").when(F.exists(trips, lambda t: t["capacity"].isNull() | (t["capacity"] <= 0)), "CAPACITY").when(F.exists(trips, lambda t: (t["minute"] < 0) | (t["minute"] > window)), "MINUTE_OUTSIDE")
        .when(F.col("profile").isNull() | (F.size("profile") < 1), "NO_PROFILE").when(F.exists(profile, lambda p: p["end"] <= p["start"]), "INTERVAL").when(F.exists(profile, lambda p: p["passengers"] < 0), "PASSENGERS")
        .when((F.abs(profile[0]["start"]) > 1e-9) | (F.abs(F.array_max(ends) - window) > 1e-9), "NOT_COVERED").when(gap, "GAP")
    )


def respaced(window: Column, count: Column, capacity: Column) -> Column:
    """``count`` departures spread evenly over the window."""
    return F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: F.struct((i * window / count).alias("minute"), capacity.alias("capacity")))


def scenario(states: DataFrame, kind: str, **change) -> DataFrame:
    """The states under a proposed change, with ``scenario``.

    ``states`` also have ``window`` and ``cycle`` minutes. The changes: increase_frequency and
    decrease_frequency (trip_count), add_vehicle, change_vehicle_capacity (capacity),
    shift_trip_start_time (trip, minutes), remove_low_demand_trip (trip), add_new_stop (cycle,
    passengers), increase_predicted_demand (factor). Trips count from 1.
    """
    count, one = F.size("trips"), F.element_at("trips", 1)["capacity"]
    window = F.col("window")
    if kind in ("increase_frequency", "decrease_frequency"):
        out = states.withColumn("trips", respaced(window, F.lit(change["trip_count"]), one))
    elif kind == "add_vehicle":
        out = states.withColumn("trips", respaced(window, count + F.floor(window / F.col("cycle")), one))
    elif kind == "change_vehicle_capacity":
        out = states.withColumn("trips", F.transform("trips", lambda t: F.struct(t["minute"], F.lit(float(change["capacity"])).alias("capacity"))))
    elif kind == "shift_trip_start_time":
        moved = lambda t, i: F.struct((t["minute"] + F.when(i == change["trip"] - 1, float(change["minutes"])).otherwise(0.0)).alias("minute"), t["capacity"])
        out = states.withColumn("trips", F.transform("trips", moved))
    elif kind == "remove_low_demand_trip":
        out = states.withColumn("trips", F.filter("trips", lambda t, i: i != change["trip"] - 1))
    elif kind == "add_new_stop":
        fewer = F.floor(count * F.col("cycle") / (F.col("cycle") + change["cycle"]))
        more = lambda p: F.struct(p["start"], p["end"], (p["passengers"] + change["passengers"]).alias("passengers"))
        out = states.withColumn("trips", respaced(window, fewer, one)).withColumn("profile", F.transform("profile", more))
    elif kind == "increase_predicted_demand":
        out = states.withColumn("profile", F.transform("profile", lambda p: F.struct(p["start"], p["end"], (p["passengers"] * change["factor"]).alias("passengers"))))
    elif kind == "baseline":
        out = states
    else:
        raise ValueError(kind)
    return out.withColumn("scenario", F.lit(kind))
