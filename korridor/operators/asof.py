"""What was known when: history, interval and as-of joins over event time and publication time."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _marks(df: DataFrame, keys: list[str], row: str, cutoff: str, at: str, available: str, target: str, ties: list[str]) -> DataFrame:
    """Two rows for one: when it asks (its cutoff), and from when its own outcome may be seen.

    An outcome at t, published at a, is visible to a cutoff c if t < c and a <= c, that is from
    max(t + 1, a) on: one instant instead of two conditions. Instants are whole numbers.
    """
    seen = F.struct(F.col(at).alias("t"), *(F.col(c) for c in ties), F.col(target).alias("y"))
    ask = df.select(*keys, F.col(row).alias("_row"), F.col(cutoff).alias("_instant"), F.lit(1).alias("_asks"), F.lit(None).cast(df.select(seen).schema[0].dataType).alias("_seen"))
    known = F.col(at).isNotNull() & F.col(available).isNotNull() & F.col(target).isNotNull()
    tell = df.filter(known).select(*keys, F.lit(None).cast(df.schema[row].dataType).alias("_row"), F.greatest(F.col(at) + 1, F.col(available)).alias("_instant"), F.lit(0).alias("_asks"), seen.alias("_seen"))
    return ask.unionByName(tell)


#: rows of a key up to which it is one stretch: cut by time, a key of few rows would carry more than it has
KEY_ROWS = 50_000


def _carried(df: DataFrame, keys: list[str], row: str, cutoff: str, at: str, available: str, target: str, ties: list[str], n: int, width: int, most: int = 0) -> DataFrame:
    """The marks by key and stretch of ``width`` instants, each stretch with the ``n`` latest outcomes of all before it.

    So a key with a third of all rows is dealt out by time. Within a stretch at most ``n`` outcomes
    can matter later; only those are followed along a key, in one pass over sorted rows. Keys of at
    most ``most`` rows are one stretch each; the others, no more than one in ``most`` rows, are known to every task.
    """
    marks = _marks(df, keys, row, cutoff, at, available, target, ties)
    stretch = F.floor(F.col("_instant") / width)
    if most:
        busy = df.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most).drop("_rows").withColumn("_busy", F.lit(True))
        marks = marks.join(F.broadcast(busy), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys))), "left").drop(*(f"_key{i}" for i in range(len(keys))))
        stretch = F.when(F.col("_busy") | F.col("_instant").isNull(), stretch).otherwise(F.lit(0).cast("long"))
    marks = marks.withColumn("_bucket", stretch)
    names, latest = [*keys, "_bucket"], [F.col("_seen.t").desc(), *(F.col(f"_seen.{c}").desc_nulls_last() for c in ties)]
    cut = marks.filter("_busy").drop("_busy") if most else marks
    marks = marks.drop("_busy")
    top = cut.filter("_asks = 0").withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*latest))).filter(F.col("_n") <= n).select(*names, "_seen", F.lit(1).alias("_later"))
    asked = cut.filter("_asks = 1 and _bucket is not null").select(*names).distinct().select(*names, F.lit(None).cast(marks.schema["_seen"].dataType).alias("_seen"), F.lit(0).alias("_later"))
    small = top.unionByName(asked).withColumn("_h", F.hash(F.struct(*keys)))
    small = small.repartition(*keys).sortWithinPartitions("_h", *keys, "_bucket", "_later")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, []
        for batch in parts:
            out = []
            for x in batch.to_pylist():
                now = [x[k] for k in keys]
                if now != group:
                    group, seen = now, []
                if x["_later"]:
                    s = x["_seen"]
                    insort(seen, ((s["t"], *((s[c] is not None, s[c]) for c in ties), s["y"]), s["t"]), key=lambda v: v[0])
                    del seen[:-n]
                else:
                    for order, _ in seen:
                        out.append({**{k: x[k] for k in keys}, "_bucket": x["_bucket"], "_seen": {"t": order[0], **{c: v[1] for c, v in zip(ties, order[1:-1], strict=True)}, "y": order[-1]}})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in [*names, "_seen"]]))

    border = small.mapInArrow(run, T.StructType([small.schema[c] for c in [*names, "_seen"]]))
    border = border.select(*keys, F.lit(None).cast(df.schema[row].dataType).alias("_row"), (F.col("_bucket") * width).cast(marks.schema["_instant"].dataType).alias("_instant"), F.lit(-1).alias("_asks"), "_seen", "_bucket")
    return marks.unionByName(border)


def past_only_history(df: DataFrame, keys: list[str], row: str, cutoff: str, at: str, available: str, target: str, ties: list[str], n: int = 7, width: int = 3600) -> DataFrame:
    """``lag_1`` and ``mean_n`` of the ``n`` latest outcomes that each row's cutoff may see.

    Window form: a row holds the list of what came before it in its stretch of ``width`` instants, so
    the cost is the square of a key's rows in one stretch; for dense keys use ``past_only_history_streamed``.
    Latest is by time, then ``ties``, nulls least recent. A null key is a group; a null cutoff sees
    nothing.
    """
    marks = _carried(df, keys, row, cutoff, at, available, target, ties, n, width)
    before = Window.partitionBy(*keys, "_bucket").orderBy("_instant").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.withColumn("_list", F.collect_list("_seen").over(before)).filter("_asks = 1")
    last = F.when(F.col("_instant").isNotNull(), F.slice(F.sort_array("_list", asc=False), 1, n))
    rows = rows.withColumn("_last", last)
    mean = F.when(F.size("_last") > 0, F.aggregate("_last", F.lit(0.0), lambda s, x: s + x["y"]) / F.size("_last"))
    return rows.select(F.col("_row").alias(row), F.when(F.size("_last") > 0, F.element_at("_last", 1)["y"]).alias("lag_1"), mean.alias(f"mean_{n}"))


def past_only_history_streamed(df: DataFrame, keys: list[str], row: str, cutoff: str, at: str, available: str, target: str, ties: list[str], n: int = 7, width: int = 86_400, most: int = KEY_ROWS, parts: int | None = None) -> DataFrame:
    """The same in one pass over each stretch's sorted rows: memory for ``n`` outcomes, whatever the group. Keys of at most ``most`` rows are not cut.

    Marks, two of a row, are dealt out in ``parts``, if given. A batch is worked out at once: the latest outcome is
    a running maximum of places in their order, the next one of what that maximum let go, and so on.
    """
    marks = _carried(df, keys, row, cutoff, at, available, target, ties, n, width, most)
    group, order = [*keys, "_bucket"], ["t", *(f"_tie{i}" for i in range(len(ties))), "y"]
    flat = marks.select(F.hash(F.struct(*group)).alias("_h"), *group, "_row", "_instant", "_asks", "_seen.t", *(F.col("_seen")[c].alias(f"_tie{i}") for i, c in enumerate(ties)), F.col("_seen")["y"].cast("double").alias("y"))
    dealt = (flat.repartition(parts, *group) if parts else flat.repartition(*group)).sortWithinPartitions("_h", *group, "_instant", "_asks")
    kind = df.schema[row].dataType.simpleString()

    def slots(value: np.ndarray, base: np.ndarray) -> Iterator[np.ndarray]:
        """By row the greatest value of its group up to it, then the second, to the ``n``-th; ``base``, which is above all values of the group before, where there is none."""
        for _ in range(n):
            top = np.maximum.accumulate(value)
            yield top
            value = np.minimum(value, np.maximum(np.concatenate((base[:1], top[:-1])), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # outcomes of the last group that can still matter
        for batch in batches:
            x = batch if held is None else pa.concat_batches([held, batch])
            size, begins = x.num_rows, np.zeros(x.num_rows, bool)
            begins[:1] = True
            for c in group:
                here, before = x.column(c).slice(1), x.column(c).slice(0, max(size - 1, 0))
                same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(here.is_null(), before.is_null()))
                begins[1:] |= ~same.to_numpy(zero_copy_only=False)
            base = np.cumsum(begins) * (size + 1)
            asks, told = x.column("_asks").to_numpy(), np.flatnonzero(x.column("_asks").to_numpy() < 1)
            told = told[pc.sort_indices(pa.Table.from_batches([x.select(order).take(pa.array(told))]), sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()]
            value = base.copy()
            value[told] += np.arange(1, len(told) + 1)
            y = np.concatenate(([0.0], x.column("y").to_numpy(zero_copy_only=False)[told]))
            asked = np.flatnonzero(asks == 1)
            sees = x.column("_instant").is_valid().to_numpy(zero_copy_only=False)[asked]
            total, low, seen, lag, last = np.zeros(len(asked)), np.zeros(len(asked)), np.zeros(len(asked), int), None, []
            with np.errstate(all="ignore"):
                for top in slots(value, base):
                    place = top - base
                    last.extend(told[place[-1:][place[-1:] > 0] - 1])
                    place = np.where(sees, place[asked], 0)
                    one, seen = y[place], seen + (place > 0)
                    lag = one if lag is None else lag
                    both = total + one  # what rounding loses is kept apart, as Python's sum does
                    low += np.where(np.abs(total) >= np.abs(one), (total - both) + one, (one - both) + total)
                    total = both
                mean = np.where(np.isfinite(low), total + low, total) / seen
            held = x.take(pa.array(last, pa.int64())) if last else None
            yield pa.RecordBatch.from_arrays([x.column("_row").take(pa.array(asked)), pa.array(lag, pa.float64(), mask=seen == 0), pa.array(mean, pa.float64(), mask=seen == 0)], [row, "lag_1", f"mean_{n}"])

    return dealt.mapInArrow(run, f"{row} {kind}, lag_1 double, mean_{n} double")


def running(marks: DataFrame, keys: list[str], instant: str, turn: str, values: dict[str, str], width: int = 86_400) -> DataFrame:
    """``marks`` with each of ``values`` (column: "sum" or "max") over all rows of its key up to it, by instant, then ``turn``.

    A key is dealt out by stretches of ``width`` instants; what came before a stretch is a running
    value over its stretches' own, so no row is compared with another and no key is one task's.
    """
    one = {"sum": F.sum, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    x, group = marks.withColumn("_bucket", F.floor(F.col(instant) / width)), [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = x.groupBy(*group).agg(*(one[how](c).alias(f"_own_{c}") for c, how in values.items()))
    carry = carry.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(group)), *(one[how](f"_own_{c}").over(before).alias(f"_before_{c}") for c, how in values.items()))
    x = x.join(carry, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(group)])
    inside = Window.partitionBy(*group).orderBy(instant, turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of one instant and turn that tell something all come before those that ask, so their order is of no account
    return x.select(*(both[how](one[how](c).over(inside), F.col(f"_before_{c}")).alias(c) if (how := values.get(c)) else F.col(c) for c in marks.columns))


def value_as_of(revisions: DataFrame, queries: DataFrame, key: str, instant: str, available: str, value: str, revision: str, row: str) -> DataFrame:
    """The value of the latest revision published by each query's instant; null if none was, or for a null key."""
    told = F.struct(F.col(revision).alias("r"), F.col(value).alias("v"))
    kind = revisions.select(told.alias("x")).schema["x"].dataType
    tell = revisions.filter(F.col(key).isNotNull() & F.col(available).isNotNull()).select(F.col(key).alias("_key"), F.col(available).alias("_instant"), F.lit(0).alias("_turn"), told.alias("_told"), F.lit(None).cast(queries.schema[row].dataType).alias(row))
    ask = queries.select(F.col(key).alias("_key"), F.col(instant).alias("_instant"), F.lit(1).alias("_turn"), F.lit(None).cast(kind).alias("_told"), row)
    return running(tell.unionByName(ask), ["_key"], "_instant", "_turn", {"_told": "max"}).filter("_turn = 1").select(row, F.when(F.col("_key").isNotNull() & F.col("_instant").isNotNull(), F.col("_told.v")).alias(value))


def late_promotion(rows: DataFrame, key: str, row: str, at: str, available: str) -> DataFrame:
    """``pending`` and ``promoted``: earlier rows of the key that at each row's instant are not yet, or already, published. Rows that have none are left out."""
    none = F.lit(0).cast("long")
    base = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    ask = base.select(key, F.col(at).alias("_instant"), F.lit(1).alias("_turn"), none.alias("_all"), none.alias("_known"), none.alias("promoted"), row)
    blank = F.lit(None).cast(rows.schema[row].dataType).alias(row)
    came = base.select(key, (F.col(at) + 1).alias("_instant"), F.lit(0).alias("_turn"), F.lit(1).cast("long").alias("_all"), F.col(available).isNotNull().cast("long").alias("_known"), none.alias("promoted"), blank)
    told = base.filter(F.col(available).isNotNull()).select(key, F.greatest(F.col(at) + 1, F.col(available)).alias("_instant"), F.lit(0).alias("_turn"), none.alias("_all"), none.alias("_known"), F.lit(1).cast("long").alias("promoted"), blank)
    x = running(ask.unionByName(came).unionByName(told), [key], "_instant", "_turn", {"_all": "sum", "_known": "sum", "promoted": "sum"})
    return x.filter("_turn = 1 and _all > 0").select(row, (F.col("_known") - F.col("promoted")).alias("pending"), "promoted")


def overlap_counts(rows: DataFrame, key: str, own: str, starts: str, ends: str, slack: int, width: int = 86_400) -> DataFrame:
    """How many intervals of the same key, but of another ``own``, come within ``slack`` of each ``own``'s; those that have any.

    Of all intervals of the key as many overlap one as start before its end, less those that ended
    before its start: two running counts. Only intervals of one ``own`` are held against each other.
    """
    base = rows.filter(F.col(key).isNotNull() & (F.col(ends) > F.col(starts))).select(key, own, F.col(starts).alias("_s"), F.col(ends).alias("_e"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    blank = F.lit(None).cast(rows.schema[own].dataType).alias(own)
    tells = [base.select(key, blank, (F.col("_s") + 1).alias("_instant"), F.lit(0).alias("_turn"), one.alias("_begun"), none.alias("_over"), none.alias("_sign")), base.select(key, blank, (F.col("_e") + slack).alias("_instant"), F.lit(0).alias("_turn"), none.alias("_begun"), one.alias("_over"), none.alias("_sign"))]
    asks = [base.select(key, own, (F.col("_e") + slack).alias("_instant"), F.lit(1).alias("_turn"), none.alias("_begun"), none.alias("_over"), one.alias("_sign")), base.select(key, own, F.col("_s").alias("_instant"), F.lit(1).alias("_turn"), none.alias("_begun"), none.alias("_over"), (-one).alias("_sign"))]
    marks = reduce(DataFrame.unionByName, [*tells, *asks])
    x = running(marks, [key], "_instant", "_turn", {"_begun": "sum", "_over": "sum"}, width).filter("_turn = 1")
    near = x.groupBy(own).agg(F.sum(F.when(F.col("_sign") > 0, F.col("_begun")).otherwise(-F.col("_over"))).alias("_n"))
    a, b = base.alias("_a"), base.alias("_b")
    same = a.join(b, (F.col(f"_a.{key}") == F.col(f"_b.{key}")) & (F.col(f"_a.{own}") == F.col(f"_b.{own}")) & (F.col("_a._s") < F.col("_b._e") + slack) & (F.col("_b._s") < F.col("_a._e") + slack))
    same = same.groupBy(F.col(f"_a.{own}").alias(own)).agg(F.count("*").alias("_same"))
    return near.join(same, own).select(own, (F.col("_n") - F.col("_same")).alias("clashes")).filter("clashes > 0")


def earlier(df: DataFrame, keys: list[str], row: str, asks: str, at: str, valid, sums: list[str], ties: list[str], n: int, width: int = 86_400, parts: int | None = None) -> DataFrame:
    """row, ``visits``, ``sum_`` of each of ``sums`` and ``latest`` over the rows of the key that are ``valid`` and have ``at`` before the row's ``asks``.

    A join would list every pair. What a row needs of its past is bounded: running sums, and the last
    ``n`` rows (at and ``ties``, latest first). Each row tells and asks; both kinds are dealt out once
    (in ``parts``, if given) by key and stretch of ``width`` instants, the last ``n`` that told are
    those before in their order, and what came before a stretch is carried over by a row a stretch. A
    null key is nobody's past; a null ``asks`` sees nothing.
    """
    present = reduce(lambda x, k: x & F.col(k).isNotNull(), keys[1:], F.col(keys[0]).isNotNull())
    names, none = ["visits", *(f"sum_{c}" for c in sums)], F.lit(None)
    item = F.struct(at, *ties)
    told = F.struct((F.col(at) + 1).cast("long").alias("_instant"), F.lit(0).alias("_turn"), item.alias("_item"), F.lit(1).cast("long").alias("visits"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"sum_{c}") for c in sums))
    kind = df.select(item.alias("x")).schema["x"].dataType
    ask = F.struct(F.col(asks).cast("long").alias("_instant"), F.lit(1).alias("_turn"), none.cast(kind).alias("_item"), F.lit(0).cast("long").alias("visits"), *(F.lit(0.0).alias(f"sum_{c}") for c in sums))
    tells = F.coalesce(valid & present & F.col(at).isNotNull(), F.lit(False))
    marks = df.select(*keys, F.col(row).alias("_own"), F.explode(F.when(tells, F.array(told, ask)).otherwise(F.array(ask))).alias("_mark")).select(*keys, F.when(F.col("_mark._turn") == 1, F.col("_own")).alias("_own"), "_mark.*")
    group = [*keys, "_bucket"]
    marks = marks.withColumn("_bucket", F.floor(F.col("_instant") / width))
    x = marks.repartition(parts, *group) if parts else marks.repartition(*group)

    alike = Window.partitionBy(*group, "_turn").orderBy("_instant", "_item")
    x = x.withColumn("_lately", F.when(F.col("_turn") == 0, F.array_compact(F.array("_item", *(F.lag("_item", k).over(alike) for k in range(1, n))))))
    inside = Window.partitionBy(*group).orderBy("_instant", "_turn", "_item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"_lately": F.last("_lately", ignorenulls=True).over(inside), **{f"_upto_{c}": F.sum(c).over(inside) for c in names}})

    carry = x.groupBy(*group).agg(*(F.sum(c).alias(c) for c in names), F.max(F.when(F.col("_turn") == 0, F.struct("_item", "_lately"))).alias("_end"))
    carry = carry.select(*group, *names, F.col("_end._lately").alias("_lately"), F.col("_end").isNotNull().alias("_told"))
    empty = F.array().cast(x.schema["_lately"].dataType)
    stretches, before = Window.partitionBy(*keys, "_told").orderBy("_bucket"), Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_lately", F.when(F.col("_told"), F.slice(F.concat("_lately", *(F.coalesce(F.lag("_lately", k).over(stretches), empty) for k in range(1, n))), 1, n)))
    carry = carry.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(group)), *(F.sum(c).over(before).alias(f"_before_{c}") for c in names), F.last("_lately", ignorenulls=True).over(before).alias("_before"))
    asked = x.filter("_turn = 1").join(carry, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_key{i}") for i, c in enumerate(group))), "left")
    total = lambda c: F.col(f"_upto_{c}") + F.coalesce(F.col(f"_before_{c}"), F.lit(0))
    latest = F.slice(F.concat(F.coalesce("_lately", empty), F.coalesce("_before", empty)), 1, n)
    return asked.select(F.col("_own").alias(row), *(total(c).alias(c) for c in names), latest.alias("latest"))
