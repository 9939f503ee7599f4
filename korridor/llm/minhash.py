"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct five-word shingles. Two permutations of the 32-bit universe make the
whole signature (Li and Li, "C-MinHash"): ``SIGMA`` shuffles the set once, ``PI``, circularly shifted
by k places, orders it for coordinate k. So ``BANDS * ROWS`` coordinates cost two permutations, not as
many seeds. Sets that link at 85 % miss all 28 bands of six with a chance of two in a million.

Equal sets are one node. Nodes that share a band are candidates; 168 coordinates of one byte estimate
the resemblance of a candidate pair, and pairs more than five deviations under the threshold go. All
others are decided on the full sets, in two rounds: each node with the most similar of its buckets'
pivots; then, within a bucket, every two nodes that are not connected yet. Pairs inside one component
need no test, so a bucket of copies costs a pair per node and no link is lost. In the second round the
sets of nodes that look like a node of another component go to their buckets; a task gives a forest of
the links it finds, never its pairs.

A bucket with a third of all nodes is met by joins that Spark splits where they are skewed. In the
second round the nodes that are connected with its pivot are dealt out over parts of ``PART`` bytes, and
only those that are not are copied to each, they too in parts of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import bytes_of, cut, drop, fresh, identified, keyed, release, unkeyed
from korridor.llm.graph import components
from korridor.llm.pieces import groups, ranges, white

SHINGLE, PERCENT = 5, 85  #: words of a shingle; a link has at least so many hundredths of the union in common
ROWS, BANDS = 6, 28
SURE = 0.71  #: estimates under it are more than five standard deviations below the threshold
PART = 16 << 20  #: bytes of a bucket that one task compares at a time
SHARE = 4096  #: sets that more than this part of all rows have are joined by a broadcast
SIGMA, PI = (0x9E3779B1, 0x85EBCA77), (0x7FEB352D, 0x846CA68B)  #: odd multipliers of the two permutations
_CHUNK, _SLICE = 1 << 16, 1 << 20  # shingles that get coordinates, bytes that are hashed at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = np.random.default_rng(2).integers(0, 1 << 63, (SHINGLE + 1, SHINGLE), np.uint64) * np.uint64(2) + np.uint64(1)  # by words of the shingle and place in it


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` starts, and its hash: a polynomial in its bytes, from running sums."""
    blank = white(raw)
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    power = np.full(len(raw), _ODD)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * np.multiply.accumulate(power, out=power), dtype=np.uint64)])
    back = np.full(len(raw), _INVERSE)
    np.multiply.accumulate(back, out=back)
    return start, _mixed((total[end] - total[start]) * back[start])


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same a slice at a time; slices end at white space."""
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(raw):
        stop = at + _SLICE
        while stop < len(raw):
            gap = np.flatnonzero(white(raw[stop : stop + _SLICE]))
            stop += int(gap[0]) if len(gap) else _SLICE
            if len(gap):
                break
        start, found = _word_hashes(raw[at:stop])
        starts.append(start + at)
        hashes.append(found)
        at = stop
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, given all bytes and where each text ends."""
    spaced, ends = np.insert(raw, ends, 32), ends + np.arange(1, len(ends) + 1)
    start, word = _words(spaced)
    count = np.diff(np.searchsorted(start, ends), prepend=0)
    last, out = 0, []
    for n in count.tolist():
        w, last = word[last : last + n], last + n
        m = min(n, SHINGLE)
        total = np.zeros(max(0, n - m + 1) if n else 0, np.uint64)
        for j in range(m):
            total += _mixed(w[j : n - m + 1 + j] ^ _PLACE[m, j]) * _PLACE[m, j]
        out.append(np.unique(_mixed(total)))
    return out


def _permuted(x: np.ndarray, multipliers: tuple[int, int], room: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    for shift, by in zip((16, 15), multipliers, strict=True):
        np.right_shift(x, np.uint32(shift), out=room)
        np.bitwise_xor(x, room, out=x)
        np.multiply(x, np.uint32(by), out=x)
    np.right_shift(x, np.uint32(16), out=room)
    return np.bitwise_xor(x, room, out=x)


def signatures(sets: list[np.ndarray], coordinates: int = ROWS * BANDS) -> np.ndarray:
    """Circulant signatures of sets that are not empty: coordinate k is the least of PI, shifted by k places, over SIGMA of the set."""
    out, k = np.empty((len(sets), coordinates), np.uint32), 0
    while k < len(sets):
        stop, size = k, 0
        while stop < len(sets) and (stop == k or size + len(sets[stop]) <= _CHUNK):
            size += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[k:stop]) >> np.uint64(32)).astype(np.uint32)
        room, now = np.empty_like(x), np.empty_like(x)
        _permuted(x, SIGMA, room)
        first = np.cumsum([0, *(len(s) for s in sets[k : stop - 1])])
        for c in range(coordinates):
            np.subtract(x, np.uint32(c), out=now)
            out[k:stop, c] = np.minimum.reduceat(_permuted(now, PI, room), first)
        k = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, bands.shape[:2]).copy()
    for r in range(ROWS):
        total = _mixed(total ^ bands[:, :, r]) * _ODD
    return total.view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    text = batch.column("text").cast(pa.large_binary())
    for a, b in groups(text):
        yield a, b, shingle_sets(*bytes_of(text.slice(a, b - a)))


def _signed(named: DataFrame, row: str) -> DataFrame:
    """row, doc_id, n, digest of the set, its band keys and a byte of each coordinate."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, sets in _texts(batch):
                some = [s for s in sets if len(s)]
                made = signatures(some)
                keys, low = band_keys(made).tolist(), (made & np.uint32(255)).astype(np.uint8)
                at = np.cumsum([bool(len(s)) for s in sets]) - 1
                full = [bool(len(s)) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([keys[i] if f else [] for i, f in zip(at, full, strict=True)], pa.list_(pa.int64())),
                    pa.array([low[i].tobytes() if f else b"" for i, f in zip(at, full, strict=True)], pa.binary()),
                ], ["row", "doc_id", "n", "digest", "keys", "sig"])
        release()

    rows = keyed(named, F.col(row).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, doc_id long, n long, digest binary, keys array<long>, sig binary")


def _sets(named: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """node, shingles of the ``wanted`` nodes (node, row): their texts are read again rather than all sets kept."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a, b, sets in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
        release()

    texts = named.select(F.col(row).alias("row"), F.coalesce("text", F.lit("")).alias("text")).join(wanted.hint("merge"), "row").select("node", "text")
    return cut(texts.mapInArrow(run, "node long, shingles array<long>"), "sets", "zstd")


def _estimated(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """About the resemblance of signatures of one byte a coordinate; unequal coordinates agree once in 256 times."""
    return ((one == other).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _bytes(column: pa.Array) -> np.ndarray:
    return bytes_of(column)[0].reshape(-1, ROWS * BANDS)


def _with_pivots(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v: each node with the pivot, of those of its buckets, that looks most similar."""
    sized = nodes.select("node", "n", "sig")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            about = _estimated(_bytes(batch.column("one")), _bytes(batch.column("other")))
            some = pa.array(about >= SURE)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(some), batch.column("v").filter(some), pa.array(about).filter(some)], ["u", "v", "about"])

    pairs = met.filter("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    pairs = pairs.join(sized.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sig").alias("other")), "v")
    pairs = pairs.join(sized.select(F.col("node").alias("u"), "n", F.col("sig").alias("one")), "u").filter(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    found = pairs.select("u", "v", "one", "other").mapInArrow(run, "u long, v long, about double")
    return found.groupBy("v").agg(F.max(F.struct("about", "u")).alias("best")).select(F.col("best.u").alias("u"), "v")


def _cells(met: DataFrame, own: DataFrame, size: str) -> DataFrame:
    """key, p, q, asks, other, node, comp: the nodes of each bucket with several components, dealt out to cells.

    ``own``: node, comp and ``size`` (bytes to compare). A node of the component of the bucket's pivot
    goes to the cells of its part p; any other node asks in the cells of its q, and is met in those
    of its p. Parts are as many as PART goes into the bucket's bytes, q as many as into those that ask.
    """
    labelled = met.join(own.select("node", "comp", size), "node")
    sums = labelled.groupBy("key", "comp").agg(F.sum(size).alias("w"), F.max(F.col("node") == F.col("pivot")).alias("main"))
    count = lambda w: F.greatest(F.lit(1), F.ceil(F.coalesce(w, F.lit(0)) / PART)).cast("int")
    mixed = sums.groupBy("key").agg(count(F.sum("w")).alias("ps"), count(F.sum(F.when(~F.col("main"), F.col("w")))).alias("qs"), F.max(F.when(F.col("main"), F.col("comp"))).alias("main"), F.count("*").alias("k")).filter("k > 1")
    rows = labelled.join(cut(mixed.drop("k"), "mixed").hint("merge"), "key")
    rows = rows.withColumns({"p": F.pmod(F.xxhash64("node"), F.col("ps")).cast("int"), "q": F.pmod(F.xxhash64("node", F.lit(1)), F.col("qs")).cast("int")})
    cell = lambda p, q, asks, other: F.struct(p.alias("p"), q.alias("q"), asks.alias("asks"), other.alias("other"))
    yes, no = F.lit(True), F.lit(False)
    met_in = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: cell(F.col("p"), q, no, yes))
    asks_in = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: cell(p, F.col("q"), yes, p == F.col("p")))
    elsewhere = F.filter(met_in, lambda x: x["q"] != F.col("q"))
    at = F.when(F.col("comp") == F.col("main"), met_in).otherwise(F.concat(asks_in, elsewhere))
    return rows.select("key", "node", "comp", F.explode(at).alias("at")).select("key", "at.*", "node", "comp")


def _by_cell(parts: Iterator[pa.RecordBatch], value) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each cell, of rows sorted by cell; ``value`` makes a column out of what is compared."""
    held = None
    for batch in parts:
        now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "p", "q", "asks", "other", "node", "comp", "n")} | {"value": value(batch)}
        held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
        new = np.flatnonzero(np.logical_or.reduce([held[k][1:] != held[k][:-1] for k in ("key", "p", "q")])) + 1
        for a, b in zip([0, *new[:-1]], new, strict=False):
            yield {k: v[a:b] for k, v in held.items()}
        held = {k: v[int(new[-1]) if len(new) else 0 :] for k, v in held.items()}
    if held is not None and len(held["key"]):
        yield held


def _fits(x: dict[str, np.ndarray], i, j: np.ndarray) -> np.ndarray:
    """Whether the sizes of two sets allow a link."""
    return 100 * np.minimum(x["n"][i], x["n"][j]) >= PERCENT * np.maximum(x["n"][i], x["n"][j])


def _likely(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that look like enough a node of another component of their cell."""
    for x in _by_cell(parts, lambda batch: _bytes(batch.column("sig"))):
        asks, others, found = np.flatnonzero(x["asks"]), np.flatnonzero(x["other"]), np.zeros(len(x["node"]), bool)
        for k in range(0, len(asks), 16):
            some = asks[k : k + 16][:, None]
            i, j = np.nonzero((x["comp"][some] != x["comp"][others]) & _fits(x, some, others))
            i, j = some[i, 0], others[j]
            for a in range(0, len(i), 8192):
                near = _estimated(x["value"][i[a : a + 8192]], x["value"][j[a : a + 8192]]) >= SURE
                found[i[a : a + 8192][near]] = found[j[a : a + 8192][near]] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(x["node"][found])], ["node"])


def _links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the exact links between the components of each cell."""

    def sets(batch: pa.RecordBatch) -> np.ndarray:
        column, out = batch.column("shingles"), np.empty(len(batch), object)
        for i in range(len(batch)):
            out[i] = column[i].values.to_numpy()
        return out

    for x in _by_cell(parts, sets):
        size = np.array([len(v) for v in x["value"]])
        place = np.unique(np.concatenate(x["value"]), return_inverse=True)[1]
        start = np.cumsum(size) - size
        marked, u, v = np.zeros(int(place.max()) + 1, bool), [], []
        others, comp = np.flatnonzero(x["other"]), x["comp"].copy()
        for i in np.flatnonzero(x["asks"]).tolist():
            j = others[(comp[others] != comp[i]) & _fits(x, i, others)]
            if not len(j):
                continue
            own = place[start[i] : start[i] + size[i]]
            marked[own] = True
            shared = np.add.reduceat(marked[place[ranges(start[j], size[j])]], np.cumsum(size[j]) - size[j], dtype=np.int64)
            marked[own] = False
            j = j[100 * shared >= PERCENT * (size[i] + size[j] - shared)]
            if len(j):
                _, first = np.unique(comp[j], return_index=True)
                u += [int(x["node"][i])] * len(first)
                v += x["node"][j[first]].tolist()
                comp[np.isin(comp, comp[j])] = comp[i]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _sorted_cells(cells: DataFrame, more: DataFrame, value: str) -> DataFrame:
    return cells.join(more.hint("merge"), "node").select("key", "p", "q", "asks", "other", "node", "comp", "n", value).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have at least PERCENT hundredths of their union in common."""
    whole = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("other")).hint("merge"), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("one")).hint("merge"), "u")
    shared = F.size(F.array_intersect("one", "other")).cast("long")
    return whole.filter(100 * shared >= PERCENT * (F.size("one") + F.size("other") - shared)).select("u", "v")


def _joined(named: DataFrame, row: str, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, digest, n, least doc_id, ``many`` rows), and node, component of the linked ones."""
    grouped = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    postings = cut(nodes.select("node", F.explode("keys").alias("key")), "postings")
    buckets = cut(postings.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("pivot")).filter("c > 1"), "buckets")
    met = cut(postings.join(buckets.hint("merge"), "key"), "met")
    drop(postings, buckets)
    pairs = cut(_with_pivots(met, nodes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")

    def of(wanted: DataFrame) -> DataFrame:
        rows = cut(wanted.join(nodes.select("node", "row"), "node"), "wanted")
        out = _sets(named, row, rows)
        drop(rows)
        return out

    have = of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    links = cut(_verified(pairs, have), "verified")
    joined = components(links)
    drop(pairs)

    own = nodes.join(joined, "node", "left").select("node", "n", "sig", F.coalesce("component", "node").alias("comp"), F.lit(ROWS * BANDS).alias("bytes"), (8 * F.col("n")).alias("set_bytes"))
    likely = cut(_sorted_cells(_cells(met, own, "bytes"), nodes.select("node", "n", "sig"), "sig").mapInArrow(_likely, "node long").distinct(), "likely")
    if not likely.isEmpty():
        more = of(likely.join(have.select("node"), "node", "left_anti"))
        cells = _cells(met.join(likely.hint("merge"), "node"), own, "set_bytes")
        sets = have.unionByName(more).join(nodes.select("node", "n"), "node")
        found = cut(_sorted_cells(cells, sets, "shingles").mapInArrow(_links, "u long, v long"), "links")
        joined = components(links.unionByName(found))
        drop(more, found)
    drop(met, have, links, likely)
    return nodes, joined


def _labelled(signed: DataFrame, nodes: DataFrame, joined: DataFrame, *columns: str) -> DataFrame:
    """The ``signed`` rows with their component and the least doc_id in it. An empty set is a component for each row."""
    named = nodes.join(joined, "node", "left").select("digest", "least", "many", "n", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    named = cut(named.drop("least").join(least, "component"), "named")
    many = F.broadcast(named.filter(F.col("many") * SHARE > F.lit(signed.count())).select("digest", "component", "least"))
    rows = signed.select("digest", "doc_id", "n", *columns)
    return rows.join(many, "digest").unionByName(rows.join(many, "digest", "left_anti").join(named.select("digest", "component", "least").hint("merge"), "digest"))


def minhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept of each row.

    A null or empty text, or one of white space, has an empty set and is linked with nothing, not with
    another such text. A null doc_id comes before all others. Rows that repeat a doc_id are linked by
    their texts alone; each that has the least id of its component is marked as kept. A long text is
    hashed a slice at a time. An empty table gives no rows. Other columns are not looked at, whatever
    their names.
    """
    (row,) = fresh(docs, "row")
    named = identified(docs, row)
    signed = cut(_signed(named, row), "signed")
    done = _labelled(signed, *_joined(named, row, signed))
    least = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return done.select(unkeyed(), F.col("n").alias("n_shingles"), F.when(least != F.lit(-(1 << 63)), least).alias("component_id"), (F.col("doc_id") == least).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that with the least doc_id; every column is kept, whatever its name.

    Nulls as in ``minhash_groups``; every row with an empty set stays. Of rows that share the least
    doc_id of a component, null or not, one stays: the first by where it is stored.
    """
    row, own = fresh(docs, "row", "row_kept")
    named = identified(docs, row)
    signed = cut(_signed(named, row), "signed")
    done = _labelled(signed, *_joined(named, row, signed), "row")
    first = done.filter("n > 0 AND doc_id = least").groupBy("component").agg(F.min("row").alias(own)).select(own)
    stays = cut(first.unionByName(done.filter("n = 0").select(F.col("row").alias(own))), "stays")
    return named.join(stays.hint("merge"), F.col(row) == F.col(own), "left_semi").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
k AS MATERIALIZED (SELECT r, unnest(s) AS g, len(s) AS n FROM s),
links AS MATERIALIZED (SELECT a.r AS u, b.r AS v FROM k a JOIN k b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT r AS u, r AS v FROM s UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u),
least AS (SELECT reach.u, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.v GROUP BY reach.u)
SELECT s.doc_id, len(s.s) AS n_shingles, least.component_id, s.doc_id = least.component_id AS kept FROM s JOIN least ON s.r = least.u
"""
