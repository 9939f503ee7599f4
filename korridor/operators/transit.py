"""Feature and analytics operators: delays, demand, occupancy, route profiles, service summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("ON_TIME", "MINOR_DELAY", "MODERATE_DELAY", "MAJOR_DELAY", "SEVERE_DELAY")
BANDS = ("Low", "Moderate", "High", "Overcrowded")
DAY_S = 86_400


def positive_delay(actual: str, scheduled: str) -> Column:
    return F.greatest(F.lit(0), F.col(actual) - F.col(scheduled))


def severity(delay: Column, thresholds: tuple[int, int, int, int]) -> Column:
    """Label of a delay; a threshold belongs to the label below it."""
    out = F.when(delay <= thresholds[0], LABELS[0])
    for limit, label in zip(thresholds[1:], LABELS[1:4], strict=True):
        out = out.when(delay <= limit, label)
    return out.when(delay > thresholds[3], LABELS[4])


def iso_weekday(scheduled: str) -> Column:
    """1 (Monday) to 7 of seconds since 1970."""
    return (F.floor(F.col(scheduled) / DAY_S) + 3) % 7 + 1


def hour(scheduled: str, offset_s: int = 0) -> Column:
    return F.floor((F.col(scheduled) + offset_s) / 3600) % 24


def known_at(*columns: str) -> Column:
    """When all contributions were known; null if any is unknown."""
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return F.when(~some_null, F.greatest(*columns))


def occupancy(df: DataFrame, load: str, capacity: str) -> DataFrame:
    """Ratio (not clipped), status and flag; unknown capacity stays unknown."""
    there = F.col(capacity) > 0
    ratio = F.when(there, F.col(load) / F.col(capacity))
    return df.withColumns({"utilization": ratio, "occupancy_status": F.when(there & F.col(load).isNotNull(), "AVAILABLE").otherwise("UNAVAILABLE"), "over_capacity": F.when(there, F.col(load) > F.col(capacity))})


def occupancy_band(ratio: Column, limits: tuple[float, float, float] = (0.4, 0.8, 1.0)) -> Column:
    """Band by the number of limits exceeded; a limit belongs to the band below."""
    n = reduce(lambda a, b: a + b, [(ratio > x).cast("int") for x in limits])
    return F.when(ratio >= 0, F.element_at(F.array(*map(F.lit, BANDS)), n + 1))


def delay_summary(df: DataFrame, sets: dict[str, list[str]], delay: str, day: str, early: int, late: int, recurring: int) -> DataFrame:
    """Delay statistics over several groupings in one pass.

    ``sets``: columns by dimension name. GROUPING SETS expands each row once per dimension, map-side
    sums included; ``excluded`` counts the rows of a group without a delay.
    """
    columns = list(dict.fromkeys(c for v in sets.values() for c in v))
    bits = {n: sum(1 << (len(columns) - 1 - columns.index(c)) for c in columns if c not in v) for n, v in sets.items()}
    name = reduce(lambda w, x: w.when(F.grouping_id(*columns) == x[1], x[0]), list(bits.items())[1:], F.when(F.grouping_id(*columns) == next(iter(bits.values())), next(iter(bits))))
    d, is_late = F.col(delay), F.col(delay) > late
    grouped = df.groupingSets([[F.col(c) for c in v] for v in sets.values()], *columns)
    out = grouped.agg(
        name.alias("dimension"), F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("spread"), F.max(d).alias("greatest"), F.count_if(is_late).alias("late_n"), F.count_if(d < -early).alias("early_n"),
        F.count_if((d <= late) & (d >= -early)).alias("on_time_n"), F.countDistinct(F.when(is_late, F.col(day))).alias("late_days"), F.count_if(d.isNull()).alias("excluded"),
    )
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 6))
    return out.select("dimension", key.alias("member"), "n", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "greatest", "late_n", share("late_n").alias("late_fraction"), "early_n", share("on_time_n").alias("on_time_fraction"), "late_days", (F.col("late_days") >= recurring).alias("recurring"), "excluded")


def splits(date: str, train_until: str, validation_until: str, test_until: str) -> Column:
    """Chronological split of a date; half-open intervals, null outside."""
    d = F.col(date)
    lit = lambda x: F.lit(x).cast("date")
    return F.when(d < lit(train_until), "train").when(d < lit(validation_until), "validation").when(d < lit(test_until), "test")
