"""Operators over ordered rows: headways, runs, gaps and overlaps. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headway(df: DataFrame, by: list[str], actual: str, scheduled: str, ties: list[str]) -> DataFrame:
    """Seconds since the departure before, actual and scheduled, and how far they differ."""
    out = df
    for name, column in (("headway_s", actual), ("scheduled_headway_s", scheduled)):
        order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(column), *ties)
        out = out.withColumn(name, F.col(column) - F.lag(column).over(order))
    return out.withColumn("headway_deviation_s", F.col("headway_s") - F.col("scheduled_headway_s"))


def lag_if(df: DataFrame, by: list[str], order: list[str], value: str, valid, name: str) -> DataFrame:
    """The value of the row before, if that row is valid; else null."""
    return df.withColumn(name, F.lag(F.when(valid, F.col(value))).over(Window.partitionBy(*by).orderBy(*order)))


def overlaps(df: DataFrame, by: list[str], starts: str, ends: str, ties: list[str]) -> DataFrame:
    """Rows whose interval begins before some earlier one of the group has ended.

    A running maximum of ends finds nested intervals too, which comparing neighbours does not.
    """
    before = Window.partitionBy(*by).orderBy(starts, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_busy", F.max(ends).over(before)).filter(F.col(starts) < F.col("_busy")).drop("_busy")


def onboard(df: DataFrame, by: list[str], order: str, boardings: str, alightings: str) -> DataFrame:
    """Passengers on board at arrival and at departure of each stop."""
    run = Window.partitionBy(*by).orderBy(order)
    net = F.sum(F.col(boardings) - F.col(alightings))
    return df.withColumn("onboard_arrival", F.coalesce(net.over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("onboard_departure", net.over(run.rowsBetween(Window.unboundedPreceding, 0)))


def sequence_gap(df: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """``has_gap`` on every row of a group whose sequence does not rise by one each time."""
    step = F.col(sequence) - F.lag(sequence).over(Window.partitionBy(*by).orderBy(sequence))
    return df.withColumn("_bad", F.coalesce(step != 1, F.lit(False))).withColumn("has_gap", F.max("_bad").over(Window.partitionBy(*by))).drop("_bad")


def islands(df: DataFrame, by: list[str], order: str, flag) -> DataFrame:
    """Runs of consecutive flagged rows: first and last order, number of rows."""
    all_rows, own = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by, "_flag").orderBy(order)
    x = df.withColumn("_flag", flag).withColumn("_run", F.row_number().over(all_rows) - F.row_number().over(own))
    return x.filter("_flag").groupBy(*by, "_run").agg(F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.count("*").alias("stops_n")).drop("_run")


def rolling_anomaly(df: DataFrame, by: list[str], order: str, value: str, rows: int = 7, limit: float = 2.0) -> DataFrame:
    """z-score of a value against the ``rows`` before it; anomalous beyond ``limit``.

    The spread is Welford's recurrence along the order, as the SQL it is held against adds it up:
    ``stddev_pop`` rounds otherwise in its last bit, which tells where a z is the limit itself.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(done, x):
        n = done["n"] + 1
        mean = done["mean"] + (x - done["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (done["squares"] + (x - mean) * (x - done["mean"])).alias("squares"))

    x = df.withColumn("_mean", F.avg(value).over(before)).withColumn("_spread", F.aggregate(F.collect_list(F.col(value).cast("double")).over(before), start, step, lambda s: F.when(s["n"] > 0, F.sqrt(s["squares"] / s["n"]))))
    z = F.when(F.col("_spread") > 0, (F.col(value) - F.col("_mean")) / F.col("_spread"))
    return x.withColumn("z", F.round(z, 6)).withColumn("anomalous", F.coalesce(F.abs(z) > limit, F.lit(False))).drop("_mean", "_spread")


def ranked_sample(df: DataFrame, by: list[str], quota, ids: list[str], seed: str, buckets: int = 4096) -> DataFrame:
    """The rows of each group with the least seeded digests, ``quota`` of them, and their ``sample_rank``.

    ``quota``: a number, or a column that is the same throughout a group. Digests are even, so a
    histogram of them, ``buckets`` counts a group, tells which buckets the quota reaches and how many
    rows come before each. Only rows of those are shuffled, by group and bucket, and ranked there: no
    task sorts a group. ``buckets``: a power of 16, 65,536 at most.
    """
    digits = len(f"{buckets - 1:x}")
    limit = quota if isinstance(quota, Column) else F.lit(quota)
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in ids)), 256)
    x = df.withColumn("_digest", digest).withColumn("_bucket", F.conv(F.substring("_digest", 1, digits), 16, 10).cast("int"))
    counts = x.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"), F.max(limit).alias("_quota"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).filter("_before < _quota").select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_in"), "_before")
    hit = F.col("_bucket") == F.col("_in")
    for i, c in enumerate(by):
        hit = hit & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    order = Window.partitionBy(*by, "_bucket").orderBy("_digest", *ids)
    ranked = x.join(reached, hit).withColumn("sample_rank", (F.col("_before") + F.row_number().over(order)).cast("int"))
    return ranked.filter(F.col("sample_rank") <= limit).select(*df.columns, "sample_rank")


def largest_remainder(df: DataFrame, by: list[str], weight: str, seats: int | str, tie: str, buckets: int = 4096, minimum: int = 0) -> DataFrame:
    """Whole quotas of groups with ``weight`` rows each: ``minimum`` for every group that has so many, the rest by largest remainder.

    ``seats``: a number, or a column that is the same throughout a group. No more seats are given than there are rows, and none to a group beyond its own. Remainders are
    ranked by bucket: how many lie in higher buckets is a sum of ``buckets`` counts, so no task sorts
    more than one bucket of a group.
    """
    name = by or ["_all"]
    x = df if by else df.withColumn("_all", F.lit(0))
    x = x.withColumn("_base", F.least(F.col(weight), F.lit(minimum)).cast("long"))
    totals = x.groupBy(*name).agg(F.sum(weight).alias("_total"), F.sum("_base").alias("_given"), (F.first(seats) if isinstance(seats, str) else F.lit(seats)).alias("_seats"))
    totals = totals.withColumn("_free", F.greatest(F.lit(0), F.least(F.col("_total"), F.col("_seats")) - F.col("_given"))).drop("_seats")
    share = F.when(F.col("_total") > F.col("_given"), (F.col(weight) - F.col("_base")).cast("double") * F.col("_free") / (F.col("_total") - F.col("_given"))).otherwise(0.0)
    x = x.join(F.broadcast(totals) if not by else totals, name).withColumn("_share", share).withColumn("_floor", F.floor("_share")).withColumn("_rest", F.col("_share") - F.col("_floor")).withColumn("_bucket", F.floor(F.col("_rest") * buckets))
    counts = x.groupBy(*name, "_bucket").agg(F.count("*").alias("_n"), F.sum("_floor").alias("_sum"), F.first("_free").alias("_seats"))
    whole = Window.partitionBy(*name)
    above = F.coalesce(F.sum("_n").over(whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_spare", F.col("_seats") - F.sum("_sum").over(whole) - above).select(*name, "_bucket", "_spare")
    inside = Window.partitionBy(*name, "_bucket").orderBy(F.desc("_rest"), tie)
    more = (F.row_number().over(inside) <= F.col("_spare")) & (F.col("_base") + F.col("_floor") < F.col(weight))
    x = x.join(counts, [*name, "_bucket"]).withColumn("quota", F.col("_base") + F.col("_floor") + more.cast("long"))
    return x.select(*df.columns, "quota")


def levelled(groups: DataFrame, value: str, units: str, first) -> DataFrame:
    """``groups`` with ``units`` (one number for all) taken off the greatest values, one at a time; of equal ones from that which comes ``first``.

    Taking one at a time from the greatest ends with all values above some level at that level or one
    above it. A running sum over the distinct values, greatest first, finds the level; the groups
    above it are ranked once to say which keep one more. A row a group is sorted, whatever they hold.
    """
    down = Window.orderBy(F.desc(value))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = groups.groupBy(value).agg(F.count("*").alias("_c"), F.first(units).alias("_take"))
    steps = steps.select("_take", F.sum("_c").over(so_far).alias("_n"), F.sum(F.col(value) * F.col("_c")).over(so_far).alias("_s"), F.lead(value, 1, 0).over(down).alias("_next"))
    reached = steps.filter(F.col("_s") - F.col("_n") * F.col("_next") >= F.col("_take")).agg(F.min(F.struct("_n", "_s", "_take")).alias("x"))
    level = reached.select(F.floor((F.col("x._s") - F.col("x._take")) / F.col("x._n")).alias("_level"))
    x = groups.join(F.broadcast(level))
    above = x.filter(F.col(value) > F.col("_level"))
    totals = above.agg(F.count("*").alias("_m"), F.sum(value).alias("_sum"))
    ranked = above.join(F.broadcast(totals)).withColumn("_rank", F.row_number().over(Window.orderBy(first)))
    lowered = F.col("_m") - (F.col("_sum") - F.col(units) - F.col("_m") * F.col("_level"))
    ranked = ranked.withColumn(value, F.when(F.col("_rank") <= lowered, F.col("_level")).otherwise(F.col("_level") + 1).cast("long"))
    return ranked.select(*groups.columns).unionByName(x.filter(~(F.col(value) > F.col("_level")) | F.col("_level").isNull()).select(*groups.columns))


def rounded_quotas(groups: DataFrame, weight: str, budget: int, name: str) -> DataFrame:
    """``groups`` with ``quota``: the rounded share of ``budget`` of each, at least one, then settled to the budget.

    What is given in excess is taken off the largest quotas (of equal ones the later name first), down
    to one; what is missing goes where most rows are left (of equal ones the earlier name first). No
    more than all rows are given; fewer than one a group cannot be, and give quotas of one.
    """
    total = Window.partitionBy(F.lit(0))
    seats = F.least(F.lit(budget), F.sum(weight).over(total))
    x = groups.withColumn("_seats", seats).withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("_seats") * F.col(weight) / F.sum(weight).over(total), 0)).cast("long"))
    given = F.sum("quota").over(total) - F.col("_seats")
    x = x.withColumn("_over", F.least(F.greatest(F.lit(0), given), F.sum(F.col("quota") - 1).over(total))).withColumn("_short", F.greatest(F.lit(0), -given))
    x = levelled(x.withColumn("_spare", F.col("quota") - 1), "_spare", "_over", F.desc(name)).withColumn("quota", F.col("_spare") + 1)
    x = levelled(x.withColumn("_room", F.greatest(F.lit(0).cast("long"), F.col(weight) - F.col("quota"))).withColumn("_had", F.greatest(F.lit(0).cast("long"), F.col(weight) - F.col("quota"))), "_room", "_short", F.asc(name))
    return x.withColumn("quota", F.col("quota") + F.col("_had") - F.col("_room")).select(*groups.columns, "quota")
