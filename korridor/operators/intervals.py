"""Joins of instants with the intervals that contain them, dealt out by bins of time.

An equi-join on a key alone compares every instant of a busy key with every interval of it, in one
task. Here both sides are dealt to (key, bin): an instant lies in one bin, an interval is split over
the bins it covers, so each pair meets once, and a key with a third of all rows is spread over its
bins. An interval that covers more than ``SPLIT`` bins goes to a coarser level, whose bins are ``SPLIT``
times as wide; an instant is entered once for each level that is in use. A coarse bin holds many
instants, so they are dealt out within it by their fine bins, and its intervals are copied to each
of the ``SPLIT`` shares. No interval is entered under more than ``SPLIT * (SPLIT + 1)`` keys.

Instants are whole numbers. Bounds are inclusive, or exclude the end (``closed=False``). A null key,
instant or start, and an interval that ends before it starts, meet nothing; a null end meets
nothing either, or with ``open_end`` everything after the start. ``known``: a column of the intervals
with the instant from which they may be seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korridor.operators.asof import running

SPLIT, LEVELS = 64, 5


def _bounds(right: DataFrame, starts: str, ends: str, known: str | None, closed: bool, last: Column | None) -> DataFrame:
    """``right`` with the first and the last instant that each interval contains; those that contain none go."""
    low = F.when(F.col(starts).isNotNull() & F.col(known).isNotNull(), F.greatest(starts, known)) if known else F.col(starts)
    high = F.col(ends) if closed else F.col(ends) - 1
    high = F.when(F.col(ends).isNull(), last).otherwise(high) if last is not None else high
    return right.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low <= _high")


def _bin(instant: str, width: int) -> Column:
    return F.floor(F.col(instant) / F.lit(width)).cast("long")


def dealt(left: DataFrame, right: DataFrame, instant: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``left`` by instant and ``right`` by [_low, _high], with the columns ``_level``, ``_bin`` and ``_share`` that a pair has in common.

    The levels in use are asked of ``right`` first: at most ``LEVELS`` numbers.
    """
    widths = [width * SPLIT**k for k in range(LEVELS)]
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(_bin("_high", widths[k]) - _bin("_low", widths[k]) < SPLIT, k).otherwise(level)
    levelled = right.withColumn("_level", level)
    used = sorted(r[0] for r in levelled.select("_level").distinct().collect())
    bins = lambda k: F.sequence(_bin("_low", widths[k]), _bin("_high", widths[k]))
    split = reduce(lambda done, k: F.when(F.col("_level") == k, bins(k)).otherwise(done), used[1:], bins(used[0])) if used else bins(0)
    shares = F.when(F.col("_level") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long")))
    intervals = levelled.withColumn("_bin", F.explode(split)).withColumn("_share", F.explode(shares))
    places = [F.struct(F.lit(k).alias("_level"), _bin(instant, widths[k]).alias("_bin"), (F.lit(0).cast("long") if k == 0 else F.pmod(_bin(instant, widths[0]), F.lit(SPLIT))).alias("_share")) for k in used or [0]]
    names = [c for c in left.columns]
    instants = left.withColumn("_at", F.explode(F.array(*places))).select(*names, "_at.*")
    return instants, intervals


def pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], instant: str, starts: str, ends: str, *, known: str | None = None, width: int = 21_600, closed: bool = True, open_end: bool = False) -> DataFrame:
    """Each row of ``left`` beside each interval of ``right`` that contains its instant, once; ``right``'s columns that ``left`` has too are left out."""
    last = F.lit(left.agg(F.max(instant)).first()[0]) if open_end else None  # one number
    more = [c for c in right.columns if c not in left.columns]
    kept = right.select(*more, *(F.col(theirs).alias(f"_key{i}") for i, (_, theirs) in enumerate(on)), *(F.col(c).alias(f"_{c}") for c in {starts, ends, known} - {None}))
    rows = _bounds(kept, f"_{starts}", f"_{ends}", known and f"_{known}", closed, last)
    instants, intervals = dealt(left, rows.select(*more, *(f"_key{i}" for i in range(len(on))), "_low", "_high"), instant, width)
    a, b = instants.alias("_a"), intervals.alias("_b")
    hit = [F.col(f"_a.{mine}") == F.col(f"_b._key{i}") for i, (mine, _) in enumerate(on)] + [F.col(f"_a.{c}") == F.col(f"_b.{c}") for c in ("_bin", "_level", "_share")]
    hit.append(F.col(f"_a.{instant}").between(F.col("_b._low"), F.col("_b._high")))
    return a.join(b, hit).select(*(F.col(f"_a.{c}") for c in left.columns), *(F.col(f"_b.{c}") for c in more))


def left_pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], row: str, instant: str, starts: str, ends: str, **how) -> DataFrame:
    """``pairs``, and each row of ``left`` (told apart by ``row``) that has none, with nulls."""
    found = pairs(left.select(row, instant, *dict.fromkeys(mine for mine, _ in on)), right, on, instant, starts, ends, **how)
    names = [c for c in right.columns if c not in left.columns]
    kept = found.select(F.col(row).alias("_row"), *names)
    return left.join(kept, left[row].eqNullSafe(kept["_row"]), "left").select(*left.columns, *names)


def disjoint(right: DataFrame, keys: list[str], own: str, low: str, high: str) -> DataFrame:
    """Intervals of the same ``own`` and keys that overlap or touch made one, so that an instant lies in one of them at most."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys, own).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.partitionBy(*keys, own).orderBy(low, high)
    x = right.select(*keys, own, low, high).withColumn("_busy", F.max(high).over(before))
    x = x.withColumn("_run", F.sum((F.col("_busy").isNull() | (F.col(low) > F.col("_busy") + 1)).cast("long")).over(all_before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(*keys, own, "_run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_run")


def active_counts(left: DataFrame, right: DataFrame, row: str, scopes: list[tuple[str, str]], own: str, instant: str, starts: str, ends: str, *, known: str | None = None, width: int = 86_400) -> DataFrame:
    """row, ``n``: how many different ``own`` of ``right`` contain each row's instant in any of the scopes; zero for none.

    ``scopes``: pairs of a left and a right column. No pair is made. In a scope as many contain an
    instant as have begun by it, less those that are over: two running counts along the key, dealt
    out by stretches of ``width``. What lies in several scopes is counted once by inclusion and
    exclusion over the combined keys.
    """
    from itertools import combinations

    bounded = _bounds(right, starts, ends, known, True, None)
    asked = left.select(F.col(row).alias("_asked"), F.col(instant).cast("long").alias("_instant"), *(F.col(mine).alias(f"_k{i}") for i, (mine, _) in enumerate(scopes)))
    told = bounded.select(F.col(own).alias("_own"), "_low", "_high", *(F.col(theirs).alias(f"_k{i}") for i, (_, theirs) in enumerate(scopes)))
    found = None
    for size in range(1, len(scopes) + 1):
        for some in combinations(range(len(scopes)), size):
            keys = [f"_k{i}" for i in some]
            present = reduce(lambda x, k: x & F.col(k).isNotNull(), keys[1:], F.col(keys[0]).isNotNull())
            single = disjoint(told.filter(present & F.col("_own").isNotNull()), keys, "_own", "_low", "_high")
            blank = F.lit(None).cast(asked.schema["_asked"].dataType).alias("_asked")
            begins = single.select(*keys, F.col("_low").alias("_instant"), F.lit(0).alias("_turn"), F.lit(1).cast("long").alias("n"), blank)
            over = single.select(*keys, (F.col("_high") + 1).alias("_instant"), F.lit(0).alias("_turn"), F.lit(-1).cast("long").alias("n"), blank)
            ask = asked.filter(present & F.col("_instant").isNotNull()).select(*keys, "_instant", F.lit(1).alias("_turn"), F.lit(0).cast("long").alias("n"), "_asked")
            counts = running(begins.unionByName(over).unionByName(ask), keys, "_instant", "_turn", {"n": "sum"}, width).filter("_turn = 1 and n > 0")
            part = counts.select("_asked", (F.col("n") if size % 2 else -F.col("n")).alias("n"))
            found = part if found is None else found.unionByName(part)
    sums = found.groupBy("_asked").agg(F.sum("n").alias("n"))
    return left.select(row).join(sums, left[row].eqNullSafe(sums["_asked"]), "left").select(row, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
