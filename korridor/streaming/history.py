"""Past-only history over a stream, replayable to the batch result.

Marks (see ``operators.asof``) arrive in the order of publication: an outcome when it is published, a
question at its cutoff. State per key is the ``n`` latest outcomes that may be seen; a watermark on
the instant bounds how late a mark may come, and state of a silent key is dropped.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, row_id long, lag_1 double, mean_n double"
STATE = "seen array<struct<t:long,y:double>>"


def history_stream(marks: DataFrame, n: int = 7, late: str = "1 hour", silent_ms: int = 86_400_000) -> DataFrame:
    """``marks``: key string, instant timestamp, asks boolean, row_id long, t long, y double.

    Within a micro-batch marks of a key are taken by instant, outcomes before questions, as in batch.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = [tuple(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["instant", "asks", "t", "row_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            if r.asks:
                y = [v for _, v in seen]
                out.append((key[0], r.row_id, y[-1] if y else None, sum(y) / len(y) if y else None))
            else:
                insort(seen, (int(r.t), float(r.y)))
                del seen[:-n]
        state.update((seen,))
        state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(out, columns=["key", "row_id", "lag_1", "mean_n"])

    keyed = marks.withWatermark("instant", late).groupBy("key")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_demand(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and time window; rows later than the watermark are dropped, closed windows are final."""
    from pyspark.sql import functions as F

    return events.withWatermark("at", late).groupBy(F.window("at", size), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("key", F.col("window.start").alias("starts"), "n", "total")
