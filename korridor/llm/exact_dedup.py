"""Exact duplicates with the heavy hitters split off. DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. A frequent-items sketch (the
Misra-Gries summary with batched decrements that ``approx_top_k`` keeps per task and merges) names
the digests that may hold more than ``ERROR / tracked`` of all rows; there are no more of them than
``tracked / ERROR``, and that many are asked for. Their exact sizes are counted with map-side sums,
and the verified winners are broadcast: rows of a heavy group get their answer where they are read
and never meet in one task. All other digests go through an ordinary shuffle, where no group is
larger than that share (0.04 % of all rows).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import NO_ID, cut, drop, fresh, identified, unkeyed

ERROR = 3.5  #: the sketch misses nothing above this many rows in a counter's worth of them


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(F.col(text)), 256))


def number(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def heavy_digests(rows: DataFrame, tracked: int = 8192) -> DataFrame:
    """sha, keep, size of each digest that more than ``ERROR / tracked`` of all ``rows`` (sha, doc_id) have; at most ``tracked / ERROR``."""
    short = F.xxhash64("sha").alias("short")
    counted = rows.select(short).agg(F.expr(f"approx_top_k(short, {int(tracked / ERROR) + 1}, {tracked})").alias("top"), F.count("*").alias("n"))
    likely = counted.select(F.explode("top.item").alias("short"), "n")
    found = rows.join(F.broadcast(likely), short == likely["short"]).groupBy("sha").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"), F.first("n").alias("n"))
    return cut(found.filter(F.col("size") * tracked > F.col("n") * F.lit(ERROR)).drop("n"), "heavy")


def exact_groups(docs: DataFrame, tracked: int = 8192) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row; the largest doc_id of a group stays.

    A null text is empty; a null doc_id counts as the smallest. Rows that repeat both text and
    doc_id cannot be told apart here: each counts, and each is marked as kept (``exact_dedup`` keeps
    one). A very long text is one digest. An empty table gives no rows. Other columns are not looked
    at, whatever their names.
    """
    rows = cut(docs.select(number().alias("doc_id"), digest().alias("sha")), "digests")
    heavy = F.broadcast(heavy_digests(rows, tracked))
    rest = rows.join(heavy, "sha", "left_anti")
    light = rest.join(rest.groupBy("sha").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")).hint("merge"), "sha")
    done = rows.join(heavy, "sha").unionByName(light)
    return done.select(unkeyed(), unkeyed("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("doc_id") == F.col("keep")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, tracked: int = 8192) -> DataFrame:
    """One row of ``docs`` for each text, that with the largest doc_id; every column is kept, whatever its name.

    Nulls as in ``exact_groups``. Of rows that share text and doc_id, null or not, one stays: the
    first by where it is stored.
    """
    row, own = fresh(docs, "row", "row_kept")
    named = identified(docs, row)
    rows = cut(named.select(F.col(row).alias("row"), number().alias("doc_id"), digest().alias("sha")), "digests")
    heavy = heavy_digests(rows.select("sha", "doc_id"), tracked)
    best = rows.join(F.broadcast(heavy.select("sha", "keep")), "sha", "left").filter("keep IS NULL OR doc_id = keep")  # a heavy group has its largest id left
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("back"), "row")).alias("first")
    stays = cut(best.groupBy("sha").agg(first).select(F.col("first.row").alias(own)), "stays")
    drop(rows, heavy)
    return named.join(stays.hint("merge"), F.col(row) == F.col(own), "left_semi").select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
