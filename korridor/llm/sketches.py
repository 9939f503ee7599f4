"""Bottom-k sketches of word shingles: fingerprints that can be merged and compared.

A sketch is the ``k`` least distinct hashes of a text's shingles (five words in a row, A-Z
lower-cased; fewer words: all of them as one; none: nothing). With fewer than ``k`` shingles it is
the whole set and every estimate is exact. The k least of two sketches together are the sketch of
both texts' shingles, whatever parts they came from; from it follow resemblance, containment and
the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import batches, keyed, unkeyed

K, SHINGLE, DIGITS = 256, 5, 10  #: hashes kept, words of a shingle, hex digits of a hash
BLOCK, MOST = 16 << 20, 1 << 16  #: bytes of a block of neighbouring documents, until there are so many blocks (1 TiB); then blocks grow
_SPACE = 1 << 4 * DIGITS
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
_ADD = [np.uint64(int(x) * (j + 1) & (1 << 64) - 1) for j, x in enumerate(_MULTIPLY)]
PAIRED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
BLOCKED = pa.schema([("block", pa.int64()), ("own", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("text", pa.string())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def sketch(text: str, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """The k least distinct shingle hashes, ascending."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(word) - shingle + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(word))):
        total += _mixed(word[j : n + j] + _ADD[j % 5])
        total *= _MULTIPLY[(j + 1) % 5]
    found = _mixed(total) >> np.uint64(64 - 4 * DIGITS)
    if len(found) > 8 * k:  # a repeated hash counts once, so more than k are needed
        few = np.unique(np.partition(found, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(found)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both sets together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """About how many distinct shingles the sketched set has."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _SPACE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """About the share of all shingles of both sets that are in both; 1 for two empty sets."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(shared, both[-1], side="right")) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """About the share of a's shingles that are in b; 1 for an empty a."""
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k)) if len(a) else 1.0


def to_text(a: np.ndarray) -> str:
    return "".join(f"{x:0{DIGITS}x}" for x in a.tolist())


def merged(parts: DataFrame, by: str, k: int = K, held: int = 4096) -> DataFrame:
    """``by``, fingerprint: the sketches of all parts of each group (``by`` and fingerprint of each part) as one.

    Bottom-k sketches merge in any order, so a task merges what it has of a group before the shuffle,
    for up to ``held`` groups at a time, and a group costs a sketch a task, however many parts it has.
    """

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(groups), kind), pa.array([to_text(x) for x in groups.values()], pa.string())], [by, "fingerprint"])
            groups.clear()
            return out

        kind = None
        for batch in batches_in:
            kind = batch.schema.field(by).type
            for group, text in zip(batch.column(by).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                now = from_text(text or "")
                groups[group] = merge(groups[group], now, k) if group in groups else now
                if len(groups) > held:
                    yield done()
        if groups:
            yield done()

    schema = parts.select(by, "fingerprint").schema
    once = parts.select(by, "fingerprint").mapInArrow(run, schema)
    return once.repartition(by).sortWithinPartitions(by).mapInArrow(_joined(by, k), schema)


def _joined(by: str, k: int):
    """Sketches of each group as one, of rows sorted by group."""

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches_in:
            names, texts = [], []
            for group, text in zip(batch.column(by).to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
                now = from_text(text)
                if held is not None and group == at:
                    held = merge(held, now, k)
                    continue
                if held is not None:
                    names.append(at)
                    texts.append(to_text(held))
                held, at = now, group
            kind = batch.schema.field(by).type
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(texts, pa.string())], [by, "fingerprint"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([to_text(held)], pa.string())], [by, "fingerprint"])

    return run


def estimates(pairs: DataFrame, one: str, other: str, k: int = K) -> DataFrame:
    """``pairs`` with ``resemblance``, ``containment`` (of ``one`` in ``other``) and ``distinct`` (shingles of ``one``), from two columns of sketches."""
    from pyspark.sql import types as T

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            a, b = ([from_text(x or "") for x in batch.column(c).to_pylist()] for c in (one, other))
            made = [[resemblance(x, y, k) for x, y in zip(a, b, strict=True)], [containment(x, y, k) for x, y in zip(a, b, strict=True)], [distinct(x, k) for x in a]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m, pa.float64()) for m in made)], [*batch.schema.names, "resemblance", "containment", "distinct"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema, *(T.StructField(c, T.DoubleType()) for c in ("resemblance", "containment", "distinct"))]))


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_text(sketch(t, k)) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return keyed(docs).mapInArrow(run, "doc_id long, fingerprint string").withColumn("doc_id", unkeyed())


SUB = 20  #: bits of a block's number that tell the parts of one id apart


def _blocked(texts: DataFrame, blocks: int) -> DataFrame:
    """block, own, doc_id, tie, text: rows dealt by ranges of doc_id, with a copy of the row that comes after a block's last.

    An id that fills more than two blocks (null ids may) is dealt out by ranges of ``tie``, a hash of
    the text, which is even. Blocks ascend with doc_id; those of one id ascend as its ties descend.
    """
    ids = texts.select("doc_id")
    n, bounds = ids.agg(F.count("*"), F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()
    full = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") * blocks > 2 * n).collect()  # fewer than half as many ids as blocks
    parts = {r.doc_id: min((1 << SUB) - 1, -(-r.n * blocks // n)) for r in full}
    hot = np.array(sorted(parts), np.int64)
    bounds = np.unique(np.concatenate([np.array(bounds or [], np.int64), hot, hot[hot > np.iinfo(np.int64).min] - 1]))
    block_of = _block_of(bounds, parts)

    def numbered(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            ids, tie = batch.column("doc_id"), batch.column("tie")
            yield pa.RecordBatch.from_arrays([pa.array(block_of(ids.to_numpy(), tie.to_numpy())), ids, tie], ["block", "doc_id", "tie"])

    first = F.min(F.struct(F.bitwise_not("doc_id").alias("back"), "tie")).alias("first")
    last = texts.select("doc_id", "tie").mapInArrow(numbered, "block long, doc_id long, tie long").groupBy("block").agg(first).orderBy("block").collect()  # a row per block
    after = {(~r.first.back, r.first.tie): last[(i + 1) % len(last)].block for i, r in enumerate(last)}  # the last block's goes to the first
    names = np.array(sorted({i for i, _ in after}), np.int64)

    def deal(parts_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_in:
            ids, tie, text = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy(), batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array(block_of(ids, tie)), pa.array(np.ones(len(ids), bool)), batch.column("doc_id"), batch.column("tie"), text], schema=BLOCKED)
            copy = [k for k in np.flatnonzero(np.isin(ids, names)).tolist() if (int(ids[k]), int(tie[k])) in after]
            if copy:
                to = [after[int(ids[k]), int(tie[k])] for k in copy]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.zeros(len(copy), bool)), pa.array(ids[copy]), pa.array(tie[copy]), text.take(pa.array(copy))], schema=BLOCKED)

    return texts.mapInArrow(deal, "block long, own boolean, doc_id long, tie long, text string")


def _block_of(bounds: np.ndarray, parts: dict[int, int]):
    """A block's number from ids and ties: the range of the id, then, for ids with several parts, the part from the greatest tie down."""

    def of(ids: np.ndarray, tie: np.ndarray) -> np.ndarray:
        block = np.searchsorted(bounds, ids, side="left").astype(np.int64) << SUB
        for one, n in parts.items():
            mine = ids == one
            block[mine] |= n - 1 - (((tie[mine] >> 32) + (1 << 31)) * n >> 32)
        return block

    return of


def compare_with_next(docs: DataFrame, k: int = K, blocks: int | None = None) -> DataFrame:
    """Each row's sketch against that of its edited text and of the next document by descending doc_id.

    The edited text has the last floor(n_chars / 2) code points replaced by as many (or all) from the
    start of the next document; after the last comes the first, and a lone document follows itself. A
    null text is empty and a null doc_id the smallest. Rows that share a doc_id follow one another in
    the order of a hash of their texts. Other columns are not looked at.

    Texts are shuffled once, by ranges of doc_id (a range for each BLOCK bytes, however many there are),
    each with a copy of the one row it borders on.
    """
    rows = keyed(docs).withColumn("tie", F.xxhash64("text"))
    if blocks is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // BLOCK)))

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, {c: [] for c in PAIRED.names}

        def put(x: tuple, y: tuple) -> None:
            _, doc_id, text, own = x
            half = len(text) // 2
            edited = text[: len(text) - half] + y[2][:half]
            changed = sketch(edited, k)
            out["doc_id"].append(doc_id)
            out["n_chars"].append(len(text))
            out["edited_sha256"].append(hashlib.sha256(edited.encode()).hexdigest())
            out["fingerprint"].append(to_text(own))
            out["edited_fingerprint"].append(to_text(changed))
            out["near_edited"].append(resemblance(own, changed, k))
            out["near_next"].append(resemblance(own, y[3], k))

        closed = None
        for batch in parts:
            for block, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in BLOCKED.names if c != "tie"), strict=True):
                if not own and block == closed:
                    continue  # only the first of the rows behind a block matters
                now = (block, doc_id, text, sketch(text, k))
                if before is not None and before[0] == block:
                    put(before, now)
                closed = None if own else block
                before = now if own else None
            yield from batches(PAIRED, out)
            out = {c: [] for c in PAIRED.names}

    texts = _blocked(rows, blocks)
    dealt = texts.repartition(blocks, "block").sortWithinPartitions("block", F.desc("own"), F.desc("doc_id"), "tie", "text")
    return dealt.mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", unkeyed())
