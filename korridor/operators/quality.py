"""Data-quality rules that flag and never drop: every rule yields issue rows, the data stay as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("VALID", "ACCEPTED", "FLAGGED", "UNRESOLVED")


def issues(df: DataFrame, row: str, rule: str, bad: Column, column: str, table: str = "") -> DataFrame:
    """(table_name, source_row_id, rule_id, status, column_name, raw_value) of the rows a rule holds against."""
    raw = F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
    return df.filter(bad).select(F.lit(table).alias("table_name"), F.col(row).cast("string").alias("source_row_id"), F.lit(rule).alias("rule_id"), F.lit("FLAGGED").alias("status"), F.lit(column).alias("column_name"), raw.alias("raw_value"))


def typed_timestamps(df: DataFrame, columns: list[str], status: str = "quality_status") -> DataFrame:
    """Texts as timestamps; an unreadable one becomes null, keeps its text beside it and flags the row."""
    bad = [F.col(c).isNotNull() & F.expr(f"try_cast({c} as timestamp)").isNull() for c in columns]
    out = df.withColumns({f"raw_timestamp__{c}": F.col(c) for c in columns})
    if status in df.columns:
        out = out.withColumn(status, F.when(reduce(lambda a, b: a | b, bad), "FLAGGED").otherwise(F.col(status)))
    return out.withColumns({c: F.expr(f"try_cast(raw_timestamp__{c} as timestamp)") for c in columns})


def missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """All copies of each repeated key."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter("_n > 1").drop("_n")


def unknown(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows with a key that ``known`` does not have; null keys are another rule's business."""
    return df.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def leaks(df: DataFrame, available: str, cutoff: str) -> DataFrame:
    """Rows that use what was published after their cutoff."""
    return df.filter(F.col(available) > F.col(cutoff))


def assert_none(df: DataFrame, message: str) -> None:
    """Raise if there is any row; stops at the first."""
    if not df.isEmpty():
        raise ValueError(message)


def reconciliation(df: DataFrame, disposition: str, by: str) -> DataFrame:
    """raw = the sum of all dispositions, per group."""
    kinds = ("UNCHANGED", "CORRECTED", "FLAGGED", "QUARANTINED")
    counts = df.groupBy(by).agg(F.count("*").alias("raw"), *(F.count_if(F.col(disposition) == k).alias(k.lower()) for k in kinds))
    return counts.withColumn("balanced", F.col("raw") == reduce(lambda a, b: a + b, [F.col(k.lower()) for k in kinds]))
