"""A Merkle manifest of a dataset, and a proof for every row by looking up its siblings' coordinates.

A row is a leaf of the tree of its language, in the order of doc_id; eight nodes of a level in a row make
a node of the next; the trees' tops, in the order of the languages, are the leaves of one more tree,
whose top is the root. A node's coordinates are (tree, level, place). Which siblings a leaf needs
follows from its place and its tree's size alone: they are exploded, joined with the table of nodes,
ordered, concatenated and folded.

Every level has an eighth of the nodes of the level under it and is written once. Places come from a
range partitioning: row numbers within a range and the sum of the ranges before. A node near a top is a
sibling of a great part of all leaves; those levels, at most ``FEW`` nodes together, are joined by a
broadcast, all lower ones by a shuffle, in which no node is asked for by more than the leaves of its
run. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korridor.llm.common import cut, drop

WIDTH = 8  #: nodes of a run
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FEW = 8192  #: nodes of upper levels that are broadcast, about a megabyte
RANGE = 1 << 20  #: rows of a range of places, about
TOP = ""  #: names the tree of the languages' tops; a language's tree is named by its field


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value: no two sequences of fields read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(text: Column) -> Column:
    return hashed(*(field(text if c == "text" else F.col(c)) for c in FIELDS))


def altered(text: Column) -> Column:
    """What an altered copy holds in the rows whose doc_id has a crc32 that 3 divides: the text in lower case (A-Z)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def placed(rows: DataFrame, tree: Column, *order: str) -> DataFrame:
    """``rows`` with ``tree``, ``place`` (from 0, by ``order``, nulls first) and ``size`` of the tree."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    ranged = cut(rows.withColumn("tree", tree).repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()), "ranged")
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"))
    starts = cut(starts.select("tree", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("size")), "starts")
    inside = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order))
    out = cut(ranged.withColumn("inside", inside).join(starts, ["tree", "part"]).withColumn("place", F.col("start") + F.col("inside") - 1).drop("part", "inside", "start"), "placed")
    drop(ranged, starts)
    return out


def _steps(size: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while size > 1:
        size, n = -(-size // WIDTH), n + 1
    return n


def grown(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """tree, place, digest, size of each level, the leaves first; ``size`` counts the tree's nodes of that level."""
    out = [leaves.select("tree", "place", "digest", "size")]
    for level in range(levels):
        runs = out[-1].filter("size > 1").groupBy("tree", F.expr(f"place div {WIDTH}").alias("place"), F.ceil(F.col("size") / WIDTH).alias("size"))
        run = F.array_sort(F.collect_list(F.struct("place", "digest")))
        digest = hashed(F.array_join(F.transform(run, lambda x: shown(x["digest"])), ""))
        out.append(cut(runs.agg(digest.alias("digest")).select("tree", "place", "digest", "size"), f"level-{level + 1}"))
    return out


def _coordinates(tree: Column, place: str, size: str, levels: int, first: int) -> Column:
    """The siblings that a leaf at ``place`` of ``size`` needs, level by level; ``first`` is the number of its first step."""

    def siblings(level: int) -> Column:
        span = WIDTH**level
        own, nodes = F.expr(f"{place} div {span}"), F.ceil(F.col(size) / span).cast("long")
        begin = F.expr(f"{WIDTH} * ({place} div {WIDTH * span})")
        others = F.filter(F.sequence(begin, F.least(begin + (WIDTH - 1), nodes - 1)), lambda x: x != own)
        made = F.transform(others, lambda x: F.struct(F.lit(first + level).alias("step"), tree.alias("tree"), F.lit(level).alias("level"), x.alias("place")))
        return F.when(F.col(size) > span, made).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("step"), F.lit("").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"))), lambda x: F.lit(False)))

    return F.flatten(F.array(*(siblings(level) for level in range(levels)))) if levels else F.array().cast("array<struct<step:int,tree:string,level:int,place:bigint>>")


class Manifest:
    """The written trees of ``docs``: ``leaves`` (row, doc_id, leaf, again, tree, place, size), ``levels``, ``tops`` and ``root``.

    ``again`` is the leaf of the altered copy. Rows that repeat a doc_id, or have none, follow one
    another by their leaves; equal rows have places of their own. A null lang is a language of its
    own, the first. A long text is hashed whole; an empty table has no root.
    """

    def __init__(self, docs: DataFrame) -> None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), field(F.col("lang")).alias("language"), leaf(F.col("text")).alias("leaf"), leaf(altered(F.col("text"))).alias("again"))
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
        self.leaves = placed(rows, F.col("language"), "doc_id", "leaf", "row").drop("language")
        drop(rows)
        largest, count = self.leaves.agg(F.max("size"), F.count("*")).first()
        self.levels = grown(self.leaves.withColumnRenamed("leaf", "digest"), _steps(largest or 0))
        done = [x.filter("size = 1").select("tree", "digest") for x in self.levels]
        tops = done[0]
        for x in done[1:]:
            tops = tops.unionByName(x)
        name = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
        tops = tops.select(F.col("tree").alias("own"), "digest", name.alias("name"))
        self.tops = placed(tops, F.lit(TOP), "name")
        self.languages = self.tops.count()
        self.top_levels = grown(self.tops, _steps(self.languages))
        last = self.top_levels[-1].filter("size = 1").first()  # one row
        self.root = last and bytes(last.digest).hex()
        sizes = self.leaves.select("tree", "size").distinct()
        count = sizes.agg(*(F.sum(F.when(F.col("size") > WIDTH**k, F.ceil(F.col("size") / WIDTH ** k)).otherwise(0)).alias(f"n{k}") for k in range(len(self.levels)))).first()
        #: nodes of each level that have siblings, of the languages' trees and of the top
        self.counts = [[int(x or 0) for x in count], [-(-self.languages // WIDTH**k) for k in range(len(self.top_levels))]]

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """tree, level, place, digest: the table of nodes in two parts, lower levels and the ``FEW`` nodes of upper ones."""
        every = sorted(((n, level, x) for of, tables in zip(self.counts, (self.levels, self.top_levels), strict=True) for level, (n, x) in enumerate(zip(of, tables, strict=True))), key=lambda x: (x[0], -x[1]))
        parts, held = ([], []), 0
        for n, level, x in every:
            held += n
            parts[held <= FEW].append(x.select("tree", F.lit(level).alias("level"), "place", "digest"))
        empty = self.levels[0].limit(0).select("tree", F.lit(0).alias("level"), "place", "digest")
        out = []
        for some in parts:
            whole = empty if not some else some[0]
            for x in some[1:]:
                whole = whole.unionByName(x)
            out.append(whole)
        return out[0], out[1]

    def proofs(self) -> DataFrame:
        """Each leaf with ``top`` (its tree's), ``siblings`` (step, place, digest in order), and its place and size at the top."""
        below, above = self.nodes()
        tops = self.tops.select(F.col("own").alias("tree"), F.col("digest").alias("top"), F.col("place").alias("top_place"), F.col("size").alias("top_size"))
        leaves = self.leaves.join(tops, "tree")
        steps = len(self.levels) - 1
        wanted = F.concat(_coordinates(F.col("tree"), "place", "size", steps, 0), _coordinates(F.lit(TOP), "top_place", "top_size", len(self.top_levels) - 1, steps))
        asked = leaves.select("row", F.explode(wanted).alias("at")).select("row", "at.*")
        key, kept = ["tree", "level", "place"], ["row", "step", "place", "digest"]
        found = asked.join(F.broadcast(above), key).select(*kept).unionByName(asked.join(below.hint("merge"), key).select(*kept))
        own = F.struct("doc_id", "leaf", "again", "place", "size", "top", "top_place", "top_size")
        both = found.select("row", F.struct("step", "place", "digest").alias("sibling")).unionByName(leaves.select("row", own.alias("own")), allowMissingColumns=True)
        gathered = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("sibling")).alias("siblings"))
        return gathered.select("own.*", "siblings")

    def folded(self, start: Column) -> Column:
        """The root that follows from a leaf and its siblings."""
        steps = len(self.levels) - 1

        def step(number: int, place: str, size: str, span: int) -> Column:
            mine = F.filter("siblings", lambda x: x["step"] == number)
            own = F.expr(f"{place} div {span}")
            side = lambda keep: F.array_join(F.transform(F.filter(mine, keep), lambda x: shown(x["digest"])), "")
            return F.struct((F.col(size) > span).alias("there"), side(lambda x: x["place"] < own).alias("before"), side(lambda x: x["place"] > own).alias("after"))

        every = [step(k, "place", "size", WIDTH**k) for k in range(steps)] + [step(steps + k, "top_place", "top_size", WIDTH**k) for k in range(len(self.top_levels) - 1)]
        if not every:
            return shown(start)
        return F.aggregate(F.array(*every), shown(start), lambda done, x: F.when(x["there"], F.sha2(F.concat(x["before"], done, x["after"]), 256)).otherwise(done))


def verified_rows(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of each row; ``folded_root`` of the altered copy and whether it is the root.

    Nulls, repeats, long texts and the empty table as in ``Manifest``. A row without a doc_id is not
    altered. Of columns only those of ``FIELDS`` are looked at.
    """
    m = Manifest(docs)
    proof = F.sha2(F.array_join(F.transform("siblings", lambda x: shown(x["digest"])), ""), 256)
    out = m.proofs().select("doc_id", shown(F.col("leaf")).alias("leaf"), shown(F.col("top")).alias("subroot"), F.lit(m.root).cast("string").alias("root"), proof.alias("proof_sha256"), m.folded(F.col("again")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALTERED = f"(CASE WHEN crc % 3 = 0 THEN {_LOWER} ELSE text END)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join("(" + _FIELD.format(text if c == "text" else c) + ")" for c in FIELDS) + ")"


SQL = f"""
WITH RECURSIVE c AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) END AS crc FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("text")} AS leaf, {_leaf_sql(_ALTERED)} AS again FROM c),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM p UNION ALL SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n),
tops AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, n, h FROM tops UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n),
root AS (SELECT h FROM top WHERE n = 1),
sib AS MATERIALIZED (SELECT lang, level, i, coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (PARTITION BY lang, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM up WHERE n > 1),
top_sib AS MATERIALIZED (SELECT level, i, coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM top WHERE n > 1),
fold AS (SELECT r, lang, 0 AS level, i, again AS h, '' AS proof, n FROM p UNION ALL SELECT r, f.lang, f.level + 1, f.i // 8, sha256(before || h || after), proof || before || after, (n + 7) // 8 FROM fold f JOIN sib s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.i = f.i),
high AS (SELECT f.r, 0 AS level, t.i, f.h, f.proof, t.n FROM fold f JOIN tops t ON t.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1 UNION ALL SELECT r, f.level + 1, f.i // 8, sha256(before || h || after), proof || before || after, (n + 7) // 8 FROM high f JOIN top_sib s ON s.level = f.level AND s.i = f.i)
SELECT p.doc_id, p.leaf, tops.h AS subroot, root.h AS root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = root.h AS verified
FROM p JOIN tops ON tops.lang IS NOT DISTINCT FROM p.lang JOIN high ON high.r = p.r AND high.n = 1 CROSS JOIN root
"""
