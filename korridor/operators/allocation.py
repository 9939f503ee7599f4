"""Greedy allocations, each group's rows in order, one pass with a bounded state.

What a row gets depends on what the rows before it got, so no join or window says it. Duties are dealt
by group and stretch of time, bundles by group; a task streams sorted rows and holds only the state of
what is at hand: an end for each resource, or the busy intervals that may still matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korridor.operators.asof import running


class _Ends:
    """When each resource of a component is free again: the first from a place on that is free by an instant, in logarithmic time.

    Resources are touched in order, so only those touched are kept; the rest are free.
    """

    def __init__(self, n: int) -> None:
        self.n, self.used, self.size, self.least = n, 0, 1, [float("inf"), float("inf")]

    def _set(self, k: int, end: float) -> None:
        k += self.size
        self.least[k] = end
        while k > 1:
            k //= 2
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def _first(self, low: int, high: int, by: float) -> int | None:
        """The first place in [low, high) that is free by an instant."""
        k, level = low + self.size, 1
        while low < high:
            while k % 2 == 0 and low + 2 * level <= self.size and k > 1:  # the widest block that begins here
                k, level = k // 2, 2 * level
            if self.least[k] <= by:
                while k < self.size:
                    k = 2 * k if self.least[2 * k] <= by else 2 * k + 1
                return k - self.size if k - self.size < high else None
            low += level
            k, level = low + self.size, 1
        return None

    def take(self, cursor: int, by: float, end: float) -> int | None:
        """The next free resource from ``cursor`` on, round the circle, now busy until ``end``."""
        found = self._first(cursor, self.used, by) if cursor < self.used else None
        if found is None and self.used < self.n:
            found = self.used
            self.used += 1
            if self.used > self.size:
                kept, self.size = self.least[self.size :], 2 * self.size
                self.least = [float("inf")] * (2 * self.size)
                for k, x in enumerate(kept):
                    self.least[k + self.size] = x
                for k in range(self.size - 1, 0, -1):
                    self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
        elif found is None:
            found = self._first(0, min(cursor, self.used), by)
        if found is not None:
            self._set(found, end)
        return found


def allocate(duties: DataFrame, fleet: DataFrame, group: str, duty: str, resource: str, starts: str, ends: str, buffer: int, width: int = 86_400) -> DataFrame:
    """group, duty, resource: each duty by start gets the next free resource of its group, round robin; null if none is free.

    A resource is free if its last duty ended ``buffer`` before. A duty that ends before it starts gets
    none. Instants are whole numbers.

    A group's duties are cut where none of those before is still on, buffer included: there all
    resources are free, so what follows depends on what was only by where the round robin stands, and
    turning that turns the answer. So the stretches between cuts are allocated side by side from the first
    resource on, and turned afterwards by a running sum. Cuts come from a running maximum dealt out by
    ``width`` instants. A task holds the ends of one stretch, and finds a free one in logarithmic time.
    """
    fit = F.col(starts).isNotNull() & F.col(ends).isNotNull() & (F.col(ends) >= F.col(starts))
    base = duties.select(F.col(group).alias("_g"), F.col(duty).alias("_d"), F.col(starts).cast("long").alias("_s"), F.col(ends).cast("long").alias("_e"), fit.alias("_fit"))
    valid = base.filter("_fit")
    none = F.lit(None).cast("long")
    tell = valid.select("_g", F.lit(None).cast(base.schema["_d"].dataType).alias("_d"), none.alias("_s"), none.alias("_e"), (F.col("_s") + 1).alias("_instant"), F.lit(0).alias("_turn"), (F.col("_e") + buffer).alias("_on"))
    ask = valid.select("_g", "_d", "_s", "_e", F.col("_s").alias("_instant"), F.lit(1).alias("_turn"), none.alias("_on"))
    cut = running(tell.unionByName(ask), ["_g"], "_instant", "_turn", {"_on": "max"}, width).filter("_turn = 1").withColumn("_stretch", F.when(F.coalesce(F.col("_on") <= F.col("_s"), F.lit(True)), F.col("_s")))
    cut = running(cut, ["_g"], "_instant", "_turn", {"_stretch": "max"}, width).select("_g", "_d", "_s", "_e", "_stretch")
    numbered = fleet.select(F.col(group).alias("_of"), F.col(resource).alias("_resource"), (F.row_number().over(Window.partitionBy(group).orderBy(resource)) - 1).cast("long").alias("_k"))
    sizes = numbered.groupBy("_of").agg(F.count("*").alias("_n"))
    sized = cut.join(sizes, F.col("_g").eqNullSafe(F.col("_of"))).drop("_of")
    dealt = sized.repartition("_g", "_stretch").sortWithinPartitions("_g", "_stretch", "_s", "_d")
    kinds = T.StructType([base.schema["_g"], base.schema["_d"], T.StructField("_stretch", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_turned", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, free, cursor = None, None, 0
        for batch in parts:
            out: list[list] = [[] for _ in kinds]
            for g, d, s, e, stretch, n in zip(*(batch.column(c).to_pylist() for c in ("_g", "_d", "_s", "_e", "_stretch", "_n")), strict=True):
                if (g, stretch) != held:
                    held, free, cursor = (g, stretch), _Ends(n), 0
                at, turned = free.take(cursor, s - buffer, e), 0
                if at is not None:
                    turned = (at + 1) % n - cursor  # sums to where the round robin stands at the end
                    cursor = (at + 1) % n
                for x, v in zip(out, (g, d, stretch, n, at, turned), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(c).type if c in batch.schema.names else pa.int64()) for x, c in zip(out, kinds.names, strict=True)], kinds.names)

    given = dealt.mapInArrow(run, kinds)
    stretches = given.groupBy("_g", "_stretch").agg(F.sum("_turned").alias("_own"))
    stretches = stretches.select(F.col("_g").alias("_of"), F.col("_stretch").alias("_instant"), F.lit(0).alias("_turn"), F.col("_own").alias("_sum"), "_own")
    before = running(stretches, ["_of"], "_instant", "_turn", {"_sum": "sum"}, width).select("_of", F.col("_instant").alias("_from"), (F.col("_sum") - F.col("_own")).alias("_before"))
    turned = given.join(before, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_stretch") == F.col("_from"))).select("_g", "_d", F.pmod(F.col("_at") + F.col("_before"), F.col("_n")).alias("_k0"))
    named = turned.join(numbered, F.col("_g").eqNullSafe(F.col("_of")) & (F.col("_k0") == F.col("_k"))).select(F.col("_g").alias("_g1"), F.col("_d").alias("_d1"), "_resource")
    out = base.select("_g", "_d").join(named, F.col("_g").eqNullSafe(F.col("_g1")) & (F.col("_d") == F.col("_d1")), "left")
    return out.select(F.col("_g").alias(group), F.col("_d").alias(duty), F.col("_resource").alias(resource))


def place_bundles(slots: DataFrame, pool: DataFrame, group: str, slot: str, wanted: str, item: str, owner: str, starts: str, ends: str) -> DataFrame:
    """group, slot, item: each slot in order takes the first unused items of its group whose owner is free during it.

    ``slots``: group, slot, wanted, starts, ends. ``pool``: group, item, owner and the starts and ends
    that its owner is busy now; an item that is taken moves its owner to the slot's times. An owner may
    have several items; none is placed where another of the owner's, moved or not, would overlap.
    Memory: the pool of a group.
    """
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    have = pool.select(group, null(slots, slot), null(slots, wanted), item, owner, starts, ends, F.lit(0).alias("_turn"))
    ask = slots.select(group, slot, wanted, null(pool, item), null(pool, owner), starts, ends, F.lit(1).alias("_turn"))
    rows = have.unionByName(ask).repartition(group).sortWithinPartitions(group, "_turn", slot, item)
    columns = [group, slot, wanted, item, owner, starts, ends, "_turn"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left, busy = None, {}, defaultdict(dict)
        for batch in parts:
            out: list[list] = [[], [], []]
            for g, s, n, i, who, a, b, turn in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if g != held:
                    held, left, busy = g, {}, defaultdict(dict)
                if not turn:
                    left[i] = who
                    busy[who][i] = (a, b)
                    continue
                taken = []
                for item_id, who_else in left.items():
                    if len(taken) >= (n or 0):
                        break
                    if all(b <= x or y <= a for k, (x, y) in busy[who_else].items() if k != item_id):
                        taken.append(item_id)
                        busy[who_else][item_id] = (a, b)
                for item_id in taken:
                    del left[item_id]
                    out[0].append(g)
                    out[1].append(s)
                    out[2].append(item_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(c).type) for x, c in zip(out, (group, slot, item), strict=True)], [group, slot, item])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in (group, slot, item)]))
