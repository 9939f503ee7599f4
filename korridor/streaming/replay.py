"""Answers about what was known when, over a stream, by event time.

Rows of a key wait in state until the watermark has passed their instant; then they are taken in the
order of their instants, whatever order they came in, and answered from a bounded state. So a replay
in any order of arrival, or after a restart, gives what the batch operators give. A timer at
the first instant that waits wakes the key; it takes everything that the watermark has passed. Rows later than
the watermark are dropped by Spark. Instants are timestamps; whole milliseconds are told apart.

The session needs the RocksDB state store (``use_event_time_state``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_event_time_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(instants: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(pd.Timestamp(x).value // 1_000_000) for x in instants]


class Replay(StatefulProcessor):
    """Keeps rows until the watermark has passed them. ``row_type``: of a kept row; ``names``: of an answer."""

    row_type, names = "", []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "instant long, row_id long, asks int", self.row_type)
        self.passed = handle.getValueState("passed", "until long")
        self.start()

    def start(self) -> None:
        """Open what the answers need."""

    def rows(self, part: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        """Instant, row_id, 1 for a question, and what is kept, of each row."""
        raise NotImplementedError

    def answer(self, ready: list[tuple[tuple, tuple]]) -> list[tuple]:
        """Answers to rows in the order of their instants, those that tell before those that ask."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            for instant, row_id, asks, kept in self.rows(part):
                self.waiting.updateValue((instant, row_id, asks), kept)
                first = instant if first is None else min(first, instant)
        if first is not None:
            self.handle.registerTimer(first)  # the next is set when this one is due
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        if self.passed.exists() and self.passed.get()[0] >= until:
            return  # another timer has taken everything
        waiting = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        ready, later = [x for x in waiting if x[0][0] <= until], [x[0][0] for x in waiting if x[0][0] > until]
        if later:
            self.handle.registerTimer(min(later))
        ready.sort(key=lambda x: (x[0][0], x[0][2], x[0][1]))
        out = self.answer(ready)
        for k, _ in ready:
            self.waiting.removeKey(k)
        self.passed.update((until,))
        if out:
            yield pd.DataFrame(out, columns=self.names)


class Promotions(Replay):
    """Of each row: how many earlier ones of its key are not yet published at its instant, and how many are."""

    row_type, names = "available long", ["row_id", "pending", "promoted"]

    def start(self) -> None:
        self.pending = self.handle.getMapState("pending", "available long", "n long")
        self.counts = self.handle.getValueState("counts", "seen long, waiting long, promoted long")

    def rows(self, part: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        for row_id, at, available in zip(part["row_id"], _ms(part["at"]), _ms(part["available"]), strict=True):
            if at is not None:
                yield at, int(row_id), 1, (available,)

    def answer(self, ready: list[tuple[tuple, tuple]]) -> list[tuple]:
        seen, waiting, promoted = self.counts.get() if self.counts.exists() else (0, 0, 0)
        pending = {k[0]: v[0] for k, v in self.pending.iterator()}
        due, out, k = sorted(pending), [], 0
        before = dict(pending)
        while k < len(ready):
            instant, same = ready[k][0][0], k
            while due and due[0] <= instant:
                n = pending.pop(due.pop(0))
                waiting, promoted = waiting - n, promoted + n
            while same < len(ready) and ready[same][0][0] == instant:
                if seen:
                    out.append((ready[same][0][1], waiting, promoted))
                same += 1
            for _, (available,) in ready[k:same]:
                seen += 1
                if available is None:
                    continue
                if available <= instant:
                    promoted += 1
                else:
                    waiting += 1
                    if available not in pending:
                        from bisect import insort

                        insort(due, available)
                    pending[available] = pending.get(available, 0) + 1
            k = same
        for a in before.keys() - pending.keys():
            self.pending.removeKey((a,))
        for a, n in pending.items():
            if before.get(a) != n:
                self.pending.updateValue((a,), (n,))
        self.counts.update((seen, waiting, promoted))
        return out


class Values(Replay):
    """Of each question: the value of the latest revision that its instant may see."""

    row_type, names = "revision long, value double", ["row_id", "value"]

    def start(self) -> None:
        self.latest = self.handle.getValueState("latest", "revision long, value double")

    def rows(self, part: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        for row_id, instant, asks, revision, value in zip(part["row_id"], _ms(part["instant"]), part["asks"], part["revision"], part["value"], strict=True):
            if instant is not None:
                yield instant, int(row_id), int(asks), (None if asks else int(revision), None if asks or pd.isna(value) else float(value))

    def answer(self, ready: list[tuple[tuple, tuple]]) -> list[tuple]:
        latest = self.latest.get() if self.latest.exists() else None
        out = []
        for (_, row_id, asks), told in ready:
            if asks:
                out.append((row_id, latest[1] if latest else None))
            elif latest is None or told[0] > latest[0]:
                latest = told
        if latest is not None:
            self.latest.update(tuple(latest))
        return out


def promotions_stream(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """row_id, pending, promoted of ``rows`` (key, row_id, at timestamp, available timestamp or null), once the watermark on ``at`` has passed; see ``asof.late_promotion``."""
    keyed = rows.withWatermark("at", late).groupBy("key")
    return keyed.transformWithStateInPandas(Promotions(), "row_id long, pending long, promoted long", "append", "EventTime")


def values_stream(marks: DataFrame, late: str = "1 hour") -> DataFrame:
    """row_id, value of the questions among ``marks`` (key, row_id, instant timestamp, asks boolean, revision, value); see ``asof.value_as_of``.

    A revision comes at the instant of its publication, a question at its own; a correction that is
    published later never changes an answer.
    """
    keyed = marks.withWatermark("instant", late).groupBy("key")
    return keyed.transformWithStateInPandas(Values(), "row_id long, value double", "append", "EventTime")
