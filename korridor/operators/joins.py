"""Joins that state what they assume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has the columns; found out from the schema, without a job."""
    missing = sorted({*columns} - {*df.columns})
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def exclude(df: DataFrame, bad: DataFrame, key: str, accept: Column | None = None) -> DataFrame:
    """Rows whose key is not listed in ``bad``, and listed ones that ``accept`` holds for."""
    listed = bad.select(key).distinct()
    clean = df.join(listed, key, "left_anti")
    return clean if accept is None else clean.unionByName(df.filter(accept).join(listed, key, "left_semi"))


def serving_filter(df: DataFrame, equal: dict[str, object], starts: str, ends: Column, lower: int, upper: int) -> DataFrame:
    """Rows with the given values (None: any) whose window overlaps [lower, upper)."""
    parts = [F.col(c) == v for c, v in equal.items() if v is not None] + [F.col(starts) < upper, ends > lower]
    return df.filter(reduce(lambda a, b: a & b, parts))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").drop("count")


def checked_join(left: DataFrame, right: DataFrame, key: str, kind: str) -> DataFrame:
    """Left join with ``join_status``; a broken promise of cardinality fails while the query runs.

    The check travels with the join instead of being a job of its own: right keys are grouped, and a
    key with more rows than ``kind`` ("many_to_one" or "one_to_one") allows raises.
    """
    if kind not in ("many_to_one", "one_to_one"):
        raise ValueError(kind)
    fail = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))
    once = lambda df: df.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row")).select(F.when(F.col("_n") > 1, fail.cast("string")).alias("_check"), key, "_row")
    r = once(right).select(key, "_check", *(F.col("_row")[c].alias(c) for c in right.columns if c != key), F.lit(True).alias("_there"))
    if kind == "one_to_one":
        left = once(left).filter("_check is null").select(key, *(F.col("_row")[c].alias(c) for c in left.columns if c != key))
    joined = left.join(r, key, "left").filter("_check is null")
    return joined.withColumn("join_status", F.when(F.col("_there"), "both").otherwise("left_only")).drop("_check", "_there")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """Rows of a left join and how many of them found a partner."""
    a, b = left.select(F.col(left_key).alias("_a")), right.select(F.col(right_key).alias("_b"))
    return a.join(b, F.col("_a") == F.col("_b"), "left").agg(F.lit(name).alias("pair"), F.count("*").alias("n"), F.count("_b").alias("matched"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides and on which side each is."""
    a, b = left.select(key, F.lit(1).alias("_a")), right.select(key, F.lit(1).alias("_b"))
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def any_row(source: DataFrame, probe, factor: int = 4) -> bool:
    """Whether ``probe`` of some files of ``source`` has a row: one file is read, then ``factor`` times as many while none has.

    ``probe``: from a frame of some of the files' rows to a frame; it must have a row for the whole
    source if and only if it has one for some file.
    """
    files, at, lot = sorted(source.inputFiles()), 0, 1
    while at < len(files):
        if not probe(source.sparkSession.read.schema(source.schema).parquet(*files[at : at + lot])).isEmpty():
            return True
        at, lot = at + lot, lot * factor
    return False
