"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

A source's words are dealt by a seeded hash into shards and each shard's documents, in seeded order,
form a stream that is tiled with blocks of equal length. The targets are apportioned twice by the
highest quotients weight / (2 seats + 1): blocks to sources, then a source's blocks to its shards,
so every shard has an integer quota. A shard takes whole rounds of its blocks and, for the rest of
its quota, the blocks with the least seeded hashes.

Only quotients that can decide are ranked. With n parties and m seats the deciding quotient lies in
[W / (m + n/2), W / (m - n/2)], W being all weight; seats above the band are sure, and the band holds
about 2n quotients, however many seats there are.

A block has ``total / blocks`` words, but no more than ``LONGEST`` and, in a small corpus, no fewer
than 64 unless a source would then have under 256 blocks. There is a shard for each ``shard_blocks``
blocks, however many words there are, so a source with a third of all words has a third of all
shards and no task sorts more than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korridor.llm.common import NO_ID, WORD, cut, drop, fresh, identified, unkeyed

LONGEST = 1 << 16  #: words of a block at most


def sainte_lague(parties: DataFrame, weight: str, seats: str, tie: str, group: list[str]) -> DataFrame:
    """``parties`` with ``quota``: the seats each gets of its group's ``seats``. Ties go to the lesser ``tie``."""
    whole = Window.partitionBy(*group)
    x = parties.withColumn("_n", F.count("*").over(whole)).withColumn("_w", F.sum(weight).over(whole))
    least, most = F.col("_w") / (F.col(seats) + F.col("_n") / 2), F.col(seats) - F.col("_n") / 2
    sure = F.when((most > 0) & (F.col("_w") > 0), F.greatest(F.lit(0), F.floor(F.col(weight) * most / F.col("_w") + 0.5) - 1)).otherwise(F.lit(0)).cast("long")
    last = F.when(F.col("_w") > 0, F.floor(F.col(weight) / least + 0.5) + 1).otherwise(F.lit(0)).cast("long")
    x = x.withColumn("_sure", sure).withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    band = x.withColumn("_last", last).filter(f"_last > _sure and {weight} > 0").select(*group, tie, weight, "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_last"))).alias("_seat"))
    quotient = (F.col(weight) / (2 * F.col("_seat") - 1)).desc()
    won = band.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(quotient, F.col(tie)))).filter("_rank <= _left").groupBy(*group, tie).agg(F.count("*").alias("_won"))
    return x.join(won, [*group, tie], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_n", "_w", "_sure", "_left", "_won")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """place, source_size, target of each source: filled by weight up to ``most`` times its size."""
    alone = Window.partitionBy(F.lit(0))
    x = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(alone))
    order = alone.orderBy(F.col("cap") / F.col("w"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    # while sources stop at their caps the level of the others rises; from the first that does not, it falls
    x = x.withColumn("level", (F.col("total") - before) / rest).withColumn("level", F.max("level").over(alone))
    return x.select("place", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"), "total")


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def _length(total: str, blocks: int, least: str) -> str:
    """SQL for the words of a block; ``least``: the words of the smallest source that has any."""
    return f"greatest(1, least({LONGEST}, greatest(ceil(({total}) / {blocks}), least(64, floor(({least}) / 256)))))"


def _dealt(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, blocks: int, shard_blocks: int, seed: int, *also: str) -> DataFrame:
    """Each row's place in the stream of its shard, and the plan of that shard.

    ``also``: columns that go along. ``end`` counts words from the start of the stream, ``before[b]``
    those of the extra blocks before block b, ``extra[b]`` says whether b is taken once more than ``rounds``.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *also)
    rows = cut(rows, "sizes")
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name))
    sources = cut(sources, "sources")
    goal = source_targets(sources.drop("source"), weights, share, most)
    goal = goal.withColumn("least", F.min(F.expr("nullif(source_size, 0)")).over(Window.partitionBy(F.lit(0)))).withColumn("long", F.expr(f"cast(coalesce({_length('total', blocks, 'least')}, 1) as long)"))
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / (F.col("long") * shard_blocks) + 0.5)).cast("long"))
    goal = cut(sources.select("place", "source").join(goal, "place"), "targets")

    salt = _digest(str(seed), "document", F.col("doc_id").cast("string"), F.col("digest"))
    dealt = rows.join(F.broadcast(goal), rows["source"].eqNullSafe(goal["source"])) if goal.count() <= 10_000 else rows.join(goal, rows["source"].eqNullSafe(goal["source"]))
    dealt = dealt.select("doc_id", rows["source"], "size", "place", "source_size", "target", "long", "shards", salt.alias("salt"), *also)
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("salt", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("long").alias("long"))
    shards = cut(shards.filter("words > 0").withColumn("n", F.ceil(F.col("words") / F.col("long")).cast("long")), "shards")
    seats = shards.groupBy("place").agg(F.sum("n").alias("n"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    seats = seats.withColumn("share", F.col("target") * F.col("n") / F.col("source_size")).withColumn("seats", F.floor(F.round(F.sum("share").over(Window.partitionBy(F.lit(0))), 6) + 0.5).cast("long"))
    seats = sainte_lague(seats.withColumn("all", F.lit(0)), "share", "seats", "place", ["all"]).select("place", F.least(F.col("quota"), most * F.col("n")).alias("seats"))
    quotas = sainte_lague(shards.join(seats, "place").withColumn("n_double", F.col("n").cast("double")), "n_double", "seats", "shard", ["place"])
    quotas = quotas.select("place", "shard", "words", "n", F.least(F.col("quota"), most * F.col("n")).alias("quota"))

    # the chosen blocks, and for each block the words of the chosen ones before it
    tile = quotas.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pick = Window.partitionBy("place", "shard").orderBy(_digest(str(seed), "block", F.col("place").cast("string"), F.col("shard").cast("string"), F.col("block").cast("string")), "block")
    tile = tile.withColumn("extra", F.row_number().over(pick) <= F.expr("quota % n"))
    gain = F.when(F.col("extra"), F.expr("(block + 1) * words div n - block * words div n")).otherwise(F.lit(0))
    so_far = Window.partitionBy("place", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tile = tile.withColumn("before", F.coalesce(F.sum(gain).over(so_far), F.lit(0)).cast("long"))
    plan = tile.groupBy("place", "shard", "words", "n", F.expr("quota div n").alias("rounds")).agg(F.sort_array(F.collect_list(F.struct("block", "extra", "before"))).alias("tiles"))  # a shard's blocks, at most about twice shard_blocks
    plan = cut(plan.select("place", "shard", "words", "n", "rounds", F.col("tiles.extra").alias("extra"), F.col("tiles.before").alias("before")), "plan")

    stream = Window.partitionBy("place", "shard").orderBy("salt", *also)
    placed = dealt.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    drop(sources, shards)
    return placed.join(plan, ["place", "shard"], "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, blocks: int = 1 << 20, shard_blocks: int = 1024, seed: int = 20240229) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of ``docs``.

    Sources by code point, null last, get the ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size. ``taken`` counts a document's words
    in the chosen blocks, repeats included, so never over ``most`` times its size. The same rows and
    seed give the same mix in whatever order they are stored: shard and place follow from doc_id and
    text. A null text or one without words has size 0 and takes nothing; rows that repeat a doc_id, or
    have none, are documents of their own, equal ones next to each other in one shard. A long text may span many blocks.
    An empty table gives no rows. Other columns are not looked at, whatever their names.
    """

    def chosen(x: str) -> Column:
        """Words of the chosen blocks before position x of the stream."""
        block = f"least((({x}) + 1) * n - 1, words * n - 1) div words"
        return F.expr(f"before[{block}] + if(extra[{block}], ({x}) - ({block}) * words div n, 0L)")

    placed = _dealt(docs, weights, share, most, blocks, shard_blocks, seed)
    taken = F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + chosen("end") - chosen("end - size")).otherwise(F.lit(0)).cast("long")
    return placed.select(unkeyed(), "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, blocks: int = 1 << 20, shard_blocks: int = 1024, seed: int = 20240229) -> DataFrame:
    """``docs`` as the mix has them: a row for each time a document is taken; every column is kept, whatever its name.

    A document is taken as often as the block in which its first word lies, so whole documents follow
    the seeded choice of blocks and no document comes more than ``most`` times. What has no words is
    not in a mix. Rows are told apart by where they are stored, so ids may repeat or be null.
    """
    row, own, times = fresh(docs, "row", "row_taken", "times")
    named = identified(docs, row)
    told = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))  # rows of one id and text, by what else they hold
    placed = _dealt(named.select("doc_id", "text", "source", told.alias("told"), F.col(row).alias("row")), weights, share, most, blocks, shard_blocks, seed, "told", "row")
    again = F.expr("rounds + if(extra[((end - size + 1) * n - 1) div words], 1, 0)").cast("int")
    parts = cut(placed.filter("size > 0").select(F.col("row").alias(own), again.alias(times)).filter(F.col(times) > 0), "taken")
    out = named.join(parts.hint("merge"), F.col(row) == F.col(own))
    return out.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(times)).select(*docs.columns)


def sql(seed: int = 20240229, blocks: int = 1 << 20, shard_blocks: int = 1024, whole: bool = False) -> str:
    """The same mix of ``documents`` in DuckDB, by listing every block a document overlaps; ``whole``: how often ``mixed`` has each."""

    def apportion(name: str, party: str, weight: str, group: str) -> str:
        return f"""
{name}_w AS (SELECT *, count(*) OVER ({group}) AS k, sum({weight}) OVER ({group}) AS w FROM {name}_in),
{name}_s AS (SELECT *, CASE WHEN seats - k / 2 > 0 AND w > 0 THEN greatest(0, floor({weight} * (seats - k / 2) / w + 0.5) - 1) ELSE 0 END::BIGINT AS sure,
  CASE WHEN w > 0 THEN floor({weight} / (w / (seats + k / 2)) + 0.5) + 1 ELSE 0 END::BIGINT AS last FROM {name}_w),
{name}_l AS (SELECT *, seats - sum(sure) OVER ({group}) AS spare FROM {name}_s),
{name}_b AS (SELECT *, unnest(range(sure + 1, last + 1)) AS seat FROM {name}_l WHERE {weight} > 0),
{name}_r AS (SELECT *, row_number() OVER ({group} ORDER BY {weight} / (2 * seat - 1) DESC, {party}) AS r FROM {name}_b),
{name}_g AS (SELECT place, {party} AS party, count(*) AS won FROM {name}_r WHERE r <= spare GROUP BY place, {party}),
{name} AS (SELECT l.*, l.sure + coalesce(g.won, 0) AS quota FROM {name}_l l LEFT JOIN {name}_g g ON l.place = g.place AND l.{party} = g.party)"""

    last = """e AS (SELECT o.doc_id, sum(greatest(0, least(o.finish, (y.block + 1) * y.words // y.n) - greatest(o.finish - o.size, y.block * y.words // y.n)) * (y.quota // y.n + y.extra::INT))::BIGINT AS taken
  FROM o JOIN y ON o.place = y.place AND o.shard = y.shard AND y.block >= ((o.finish - o.size + 1) * y.n - 1) // y.words AND y.block <= (o.finish * y.n - 1) // y.words WHERE o.size > 0 GROUP BY o.doc_id)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(e.taken, 0) AS taken FROM o LEFT JOIN e USING (doc_id)"""
    if whole:
        last = "z AS (SELECT 1) SELECT o.doc_id, y.quota // y.n + y.extra::INT AS times FROM o JOIN y ON o.place = y.place AND o.shard = y.shard AND y.block = ((o.finish - o.size + 1) * y.n - 1) // y.words WHERE o.size > 0 AND y.quota // y.n + y.extra::INT > 0"
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
c AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap::DOUBLE / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT place, source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target, coalesce({_length("total", blocks, "min(nullif(source_size, 0)) OVER ()")}, 1)::BIGINT AS long FROM f),
u AS (SELECT *, greatest(1, floor(source_size::DOUBLE / (long * {shard_blocks}) + 0.5))::BIGINT AS shards FROM t),
p AS (SELECT d.doc_id, d.size, u.*, md5('{seed}|document|' || d.doc_id::VARCHAR || '|' || d.digest) AS salt FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
q AS (SELECT *, ('0x' || substr(salt, 1, 8))::BIGINT % shards AS shard FROM p),
h AS (SELECT place, shard, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(source_size) AS source_size, ceil(sum(size)::DOUBLE / any_value(long))::BIGINT AS n FROM q GROUP BY place, shard HAVING sum(size) > 0),
a_0 AS (SELECT place, sum(n)::BIGINT AS n, any_value(target) * sum(n)::BIGINT / any_value(source_size) AS share FROM h GROUP BY place),
a_in AS (SELECT *, 0 AS one, floor(round(sum(share) OVER (), 6) + 0.5)::BIGINT AS seats FROM a_0),
{apportion("a", "place", "share", "PARTITION BY one").replace(chr(10), " ", 1)},
b_in AS (SELECT h.*, h.n::DOUBLE AS n_double, least(a.quota, 2 * a.n)::BIGINT AS seats FROM h JOIN a USING (place)),
{apportion("b", "shard", "n_double", "PARTITION BY place").replace(chr(10), " ", 1)},
v AS (SELECT place, shard, words, n, least(quota, 2 * n)::BIGINT AS quota FROM b),
x AS (SELECT *, unnest(range(0, n)) AS block FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY place, shard ORDER BY md5('{seed}|block|' || place || '|' || shard || '|' || block), block) <= quota % n AS extra FROM x),
o AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY salt ROWS UNBOUNDED PRECEDING)::BIGINT AS finish FROM q),
{last}
"""
