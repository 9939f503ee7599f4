"""SimHash near-duplicate groups by an inverted index on positional bytes.

A fingerprint is eight bytes at eight positions. Fingerprints that differ in at most three bits
differ in at most three bytes, so they share at least five positional bytes: the guaranteed minimum
of the count filter. The index is on bytes with their positions; the fingerprints of a posting are
compared, their shared positional bytes tallied, pairs that reach five kept, and those verified by
their differing bits.

A posting list of one positional byte would hold 1/256 of all fingerprints, and the pairs to tally
would grow with the square of the corpus. So a posting is entered under *three* bytes at once. The
positions are halved, {0..3} and {4..7}: of any five shared positions three lie in one half, so the
eight triples within the halves miss no pair that the count filter would keep.

A posting with more than ``hot`` fingerprints is entered again under five positional bytes (the
triple and each pair of the other five). What shares five bytes varies in 24 bits only, so there the
neighbours within three flipped bits are looked up instead of paired.

Each posting gives a forest of links, never all its pairs. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korridor.llm.common import batches, cut, drop, fresh, identified, keyed, release, unkeyed
from korridor.llm.graph import components

BITS = 3  #: differing bits of a link
SHARED = 8 - BITS  #: positional bytes that a link shares at least
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])
FLIPS = np.array(sorted(sum(1 << b for b in c) for n in range(1, BITS + 1) for c in combinations(range(24), n)), np.uint32)
PAIRED = 2048  #: fingerprints in a posting up to which comparing them costs less than looking up neighbours


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - shingle + 1
    for k in range(0, n, 1 << 16):
        m = min(n, k + (1 << 16))
        whole = b"".join([digest(line[a:b], seed) for a, b in zip(starts[k:m].tolist(), ends[k + shingle - 1 : m + shingle - 1].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(whole, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *also: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row, and the columns ``also``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *(batch.column(c) for c in also)], ["doc_id", "fp", *also])
        release()

    rows = keyed(docs, *also)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType()), *(rows.schema[c] for c in also)]))


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _triple(t: int) -> Column:
    a, b, c = TRIPLES[t]
    return F.lit(t << 24).cast("long") + _byte(a) * 65536 + _byte(b) * 256 + _byte(c)


def _linked(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The count filter, then the verification."""
    differ = one ^ other
    out = np.zeros(differ.shape, bool)
    near = np.flatnonzero(np.bitwise_count(differ.ravel()) <= 8 * BITS)  # no more bits than three bytes have
    some = np.ascontiguousarray(differ.ravel()[near])
    tally = (some.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = near[tally >= SHARED]
    out.ravel()[near] = np.bitwise_count(differ.ravel()[near]) <= BITS
    return out


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each fingerprint that others reach, by places in ``fps``."""
    if len(fps) == 2:
        return [(0, 1)] if _linked(fps[:1], fps[1:])[0] else []
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            near = _linked(fps[front.pop()], fps[left])
            found = left[near]
            left = left[~near]
            out += [(root, int(i)) for i in found]
            front += found.tolist()
    return out


def _flipped(fps: np.ndarray) -> list[tuple[int, int]]:
    """The same for many fingerprints that differ in three bytes at most: neighbours are looked up."""
    moving = [p for p in range(8) if len(np.unique(fps >> np.uint64(8 * p) & np.uint64(255))) > 1]
    low = np.zeros(len(fps), np.uint32)
    for k, p in enumerate(moving):
        low |= (fps >> np.uint64(8 * p) & np.uint64(255)).astype(np.uint32) << np.uint32(8 * k)
    order = np.argsort(low)
    low, root = low[order], np.arange(len(fps))
    for flip in FLIPS[FLIPS < 1 << 8 * len(moving)]:
        at = np.searchsorted(low, low ^ flip)
        at[at == len(low)] = 0
        one = np.flatnonzero(low[at] == (low ^ flip))
        other = at[one]
        while True:
            a, b = root[one], root[other]
            apart = a != b
            if not apart.any():
                break
            one, other = one[apart], other[apart]
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
    return [(int(order[r]), int(order[i])) for i, r in enumerate(root) if r != i]


def _postings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each posting, of rows sorted by key."""

    def links(key: np.ndarray, fps: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        two = two[_linked(fps[two], fps[two + 1])] if len(two) else two
        u, v = [doc[two]], [doc[two + 1]]
        for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            part = fps[a : a + n]
            narrow = n > PAIRED and sum(len(np.unique(part >> np.uint64(8 * p) & np.uint64(255))) > 1 for p in range(8)) <= BITS
            found = np.array(_flipped(part) if narrow else _forest(part), np.int64).reshape(-1, 2)
            u.append(doc[a + found[:, 0]])
            v.append(doc[a + found[:, 1]])
        yield from batches(LINK, {"u": np.concatenate(u), "v": np.concatenate(v)})

    held = None
    for batch in parts:
        now = [batch.column(k).to_numpy() for k in ("key", "fp", "doc")]
        now[1] = now[1].view(np.uint64)
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        stop = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if len(held[0]) and (held[0] != held[0][-1]).any() else 0
        if stop:
            yield from links(*(x[:stop] for x in held))
            held = [x[stop:] for x in held]
    if held is not None and len(held[0]):
        yield from links(*held)


def near_links(nodes: DataFrame, hot: int = 4096) -> DataFrame:
    """u, v: a forest of links for each posting of ``nodes`` (fp distinct, doc: its name)."""
    postings = nodes.select("fp", "doc", F.explode(F.array(*(_triple(t) for t in range(len(TRIPLES))))).alias("key"))
    large = cut(postings.groupBy("key").count().filter(F.col("count") > hot).select("key"), "large")
    few = postings.join(large, "key", "left_anti")
    wide = [sum(255 << 8 * p for p in c) for c in combinations(range(8), SHARED)]
    signed = [m - (1 << 64) if m >> 63 else m for m in wide]
    of = [[signed[j] for j, c in enumerate(combinations(range(8), SHARED)) if {*t} <= {*c}] for t in TRIPLES]
    triple = F.shiftright("key", 24).cast("int")
    masks = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in of)), triple + 1)
    many = postings.join(large, "key").select("fp", "doc", F.explode(masks).alias("mask")).distinct()
    many = many.select("fp", "doc", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    return _by_key(few).unionByName(_by_key(many))


def _by_key(postings: DataFrame) -> DataFrame:
    return postings.select("key", "fp", "doc").repartition("key").sortWithinPartitions("key").mapInArrow(_postings, "u long, v long")


def _grouped(done: DataFrame, hot: int, share: int = 4096) -> DataFrame:
    """``done`` (fp, doc_id and more) with its ``component`` (a fingerprint) and ``least``, the least doc_id in it.

    A fingerprint is a node of its own name, so repeated and null ids join nothing. Fingerprints that
    more than 1 / ``share`` of all rows have, fewer than ``share``, are broadcast; the rest is shuffled.
    """
    nodes = cut(done.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes")
    links = components(near_links(nodes.select("fp", F.col("fp").alias("doc")), hot))
    linked = nodes.join(links, nodes["fp"] == links["node"], "left").select("fp", "doc_id", "n", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = cut(linked.drop("doc_id").join(least, "component"), "named")
    drop(nodes)
    many = F.broadcast(named.filter(F.col("n") * share > F.lit(done.count())).drop("n"))
    return done.join(many, "fp").unionByName(done.join(many, "fp", "left_anti").join(named.drop("n"), "fp"))


def simhash_groups(docs: DataFrame, shingle: int = 3, seed: int = 42, hot: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of each row.

    A null text is empty; a text without words has fingerprint zero and is linked like any other. A
    null doc_id comes before all others. Rows that repeat a doc_id are each fingerprinted and linked
    by their texts alone. A long text is hashed a lot of shingles at a time. An empty table gives no
    rows. Other columns are not looked at, whatever their names.
    """
    done = _grouped(cut(fingerprints(docs, shingle, seed), "fingerprints"), hot)
    return done.select(unkeyed(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), unkeyed("least").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 3, seed: int = 42, hot: int = 4096) -> DataFrame:
    """One row of ``docs`` for each group, that with the least doc_id; every column is kept, whatever its name.

    Nulls as in ``simhash_groups``. Of a group's rows that share the least doc_id, null or not, one
    stays: the first by where it is stored.
    """
    row, own = fresh(docs, "row", "row_kept")
    named = identified(docs, row)
    done = cut(fingerprints(named.select("doc_id", "text", F.col(row).alias("row")), shingle, seed, "row"), "fingerprints")
    stays = _grouped(done, hot).filter("doc_id = least").groupBy("component").agg(F.min("row").alias(own))
    stays = cut(stays.select(own), "stays")
    drop(done)
    return named.join(stays.hint("merge"), F.col(row) == F.col(own), "left_semi").select(*docs.columns)
