"""Many checks of one table in one pass.

A check that reads its table alone costs a scan, and a shuffle if it looks at neighbours. Here a
table is read once: its parents are joined once each, what its rows need of others of the same key is
added by windows that share a partitioning and an order, and all checks are aggregates of the rows
that come out. So a table costs a scan, a join for each parent and a shuffle for each key, however
many checks there are. A condition on a whole group is a window without an order, counted at the
group's first row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_parent(rows: DataFrame, parent: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """``rows`` with the columns of ``parent`` (its keys unique) as ``name_column``, and ``name_found``."""
    renamed = parent.select(*(F.col(c).alias(f"{name}_{c}") for c in parent.columns), F.lit(True).alias(f"{name}_found"))
    hit = reduce(lambda x, y: x & y, (rows[mine] == renamed[f"{name}_{theirs}"] for mine, theirs in on.items()))
    return rows.join(renamed, hit, "left").withColumn(f"{name}_found", F.coalesce(f"{name}_found", F.lit(False)))


def with_neighbours(rows: DataFrame, keys: list[str], order: list[str], name: str, lags: list[str] = (), leads: list[str] = (), **others: Column) -> DataFrame:
    """``rows`` with ``name_before_`` and ``name_after_`` columns, ``name_first`` and ``name_last`` flags, and ``others``: aggregates over all rows before in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    made = {f"{name}_before_{c}": F.lag(c).over(w) for c in lags} | {f"{name}_after_{c}": F.lead(c).over(w) for c in leads}
    made |= {f"{name}_first": F.row_number().over(w) == 1, f"{name}_last": F.lead(F.lit(1)).over(w).isNull()}
    return rows.withColumns(made | {c: x.over(before) for c, x in others.items()})


def with_group(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """``rows`` with aggregates of all rows of the same key."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: x.over(w) for c, x in sums.items()})


def violations(*tables: tuple[DataFrame, dict[str, Column | tuple[Column]]]) -> DataFrame:
    """check_name, violations: for each table its checks, each the condition of a violating row, or in a tuple an aggregate that counts them."""
    parts = []
    for rows, checks in tables:
        counted = [(F.coalesce(x[0], F.lit(0)) if isinstance(x, tuple) else F.count_if(x)).cast("long").alias(n) for n, x in checks.items()]
        parts.append(rows.agg(*counted).unpivot([], list(checks), "check_name", "violations"))
    return reduce(DataFrame.unionByName, parts)
