"""Which tokens of one tokenizer stand where those of another do: groups, links and their counts.

A text's tokens by either tokenizer cut the same bytes. Bytes where tokens of both end cut them into
groups; the bytes between two neighbouring ends, of whichever tokenizer, belong to one token of each,
and these two are a link. So a document has as many links as it has distinct ends.

Counts are dense. The ids of the first tokenizer are dealt to ``STRIPES`` by their remainder, so that
its frequent ids lie in different stripes. A task counts the documents of each pair in matrices of
``BLOCK`` ids of a stripe by all ids of the second tokenizer (``np.add.at``); a row's maximum is the
best partner's count. Links are kept in lots of documents, one packed row for each lot and stripe, and
are scored in the task that has the stripe's counts: the counts, at most a number a cell, are copied to
as many parts as the stripe's links fill, so an id with a great share of all links is no one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import bytes_of, cut, drop, keyed, release, unkeyed
from korridor.llm.pieces import PieceEncoder, flat, groups, parted, ranges
from korridor.llm.sentencepiece_backend import Backend, _part_starts
from korridor.llm.token_files import _BYTES, ByteBpe

STRIPES, BLOCK = 64, 128
PART = 32 << 20  #: packed bytes of a stripe's links that one task scores
MERGED = 1 << 22  #: pairs that a task holds before it adds up those that are equal
LOT = 2 << 20  #: bytes of text in a lot; a longer document is a lot of its own
MANY = 60_000  #: documents of a lot
_ROW = np.uint64(22)  # bits of an id of the second tokenizer; above them, ten of the first one's place in its stripe
DOC = pa.schema([("chunk", pa.int64()), ("stripe", pa.int32()), ("payload", pa.binary()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_LINKS = "chunk long, stripe int, payload binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed string: the first bytes of all numbers, then the second ones, and so on."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<u4").tobytes()
    raw = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return head + pa.compress(raw, codec="zstd", asbytes=True) if raw else head


def unpacked(payload: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    shape = np.frombuffer(payload, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    size = sum(w * k for w, k in shape)
    raw = np.frombuffer(pa.decompress(payload[4 + 8 * n :], size, codec="zstd", asbytes=True), np.uint8) if size else np.empty(0, np.uint8)
    out, at = [], 0
    for w, k in shape:
        out.append(np.ascontiguousarray(raw[at : at + w * k].reshape(w, k).T).view(f"<u{w}").ravel())
        at += w * k
    return out


def _spelt() -> tuple[np.ndarray, np.ndarray]:
    """Ids of 16 bits with a comma, a bar or a semicolon behind them, six bytes each, and how many count."""
    rows = np.array([f"{i}{s}" for s in ",|;" for i in range(1 << 16)], "S6")
    return rows.view(np.uint8).reshape(-1, 6), np.char.str_len(rows).astype(np.int64)


class Aligner:
    """Both tokenizers of a process."""

    _made: dict[tuple[str, str], Aligner] = {}

    def __init__(self, bpe: str, pieces: str) -> None:
        self.bpe, self.backend = ByteBpe(bpe, as_text=True), Backend(pieces)
        tokens = self.bpe.tokenizer.get_vocab()
        back, out = {chr(v): k for k, v in _BYTES.items()}, [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.bytes_a, self.size_a = np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out], np.int64)
        self.at_a = np.cumsum(self.size_a) - self.size_a
        self.pieces = PieceEncoder(_part_starts, self._original, lot=2 << 20)
        self.rows, self.length = _spelt()

    @classmethod
    def of(cls, bpe: str, pieces: str) -> Aligner:
        if (bpe, pieces) not in cls._made:
            cls._made.clear()  # a worker holds one pair
            cls._made[bpe, pieces] = cls(bpe, pieces)
        return cls._made[bpe, pieces]

    def _original(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts by the sentencepiece library, many at a time with line feeds, which join nothing, between."""
        feed, feeds = self.backend.feed[0], np.array([p == "\n" for p in parts])
        lots = ["\n" + "\n".join("" if p == "\n" else p for p in parts[i : i + 200]) for i in range(0, len(parts), 200)]
        ids, _ = flat([x[x.index(feed) :] for x in self.backend.original.encode(lots, num_threads=1)])
        count = parted(ids, feed, len(parts))
        start, count = np.cumsum(count + 1) - count - feeds, count + feeds
        return ids[ranges(start, count)], count, np.zeros(len(parts), np.uint8)

    def _encoded(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By each tokenizer: the ids of texts that begin with a space, where each text's end, the bytes of all tokens, each token's length."""
        ids, stop, _ = self.bpe.pieces.texts(raw, ends)
        yield ids, stop, self.bytes_a[ranges(self.at_a[ids], self.size_a[ids])], self.size_a[ids]
        if self.backend.by_part:
            ids, stop, _ = self.pieces.texts(raw, ends)
        else:
            texts = [raw[a:b].tobytes().decode()[1:] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            ids, count = flat([self.backend.original.encode(t, num_threads=1) if t else [] for t in texts])
            stop = np.cumsum(count)
        yield ids, stop, *self.backend._bytes(ids)

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> tuple[dict[str, np.ndarray], list[str], np.ndarray]:
        """Counts of each text, the digest of its groups, and a sorted number for each link: stripe, place in it, partner, text."""
        size = np.diff(ends, prepend=0)
        some = size > 0
        raw, ends = np.insert(raw, (ends - size)[some], 32), ends + np.cumsum(some)  # the space before each text
        size, sides = size + some, list(self._encoded(raw, ends))
        good, whole = some.copy(), raw.tobytes()
        for _, stop, data, length in sides:
            reach = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], stop])]
            mine = data.tobytes()
            good &= np.array([mine[a:b] == whole[c:d] for a, b, c, d in zip(reach[:-1].tolist(), reach[1:].tolist(), (ends - size).tolist(), ends.tolist(), strict=True)], bool)
        kept, until = [], np.cumsum(size * good)
        for ids, stop, _, length in sides:
            count = np.diff(stop, prepend=0)
            keep = np.repeat(good, count)
            kept.append((ids[keep].astype(np.int64), np.cumsum(length[keep]), count * good))
        (a, end_a, n_a), (b, end_b, n_b) = kept
        every = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two ascending runs
        new = np.concatenate([every[1:] != every[:-1], [True]]) if len(every) else np.empty(0, bool)
        shared = np.zeros(len(every), bool)
        shared[1:] = every[1:] == every[:-1]
        shared, cell = every[shared], every[new]
        doc = np.searchsorted(until, cell, side="left")
        out = {"n_a": n_a, "n_b": n_b, "n_links": np.bincount(doc, minlength=len(ends)), "n_groups": np.bincount(np.searchsorted(until, shared, side="left"), minlength=len(ends))}
        one, other = a[np.searchsorted(end_a, cell, side="left")], b[np.searchsorted(end_b, cell, side="left")]
        links = (one % STRIPES << 58 | (one // STRIPES << int(_ROW) | other) << 26 | doc).astype(np.uint64)
        links.sort()
        return out, self._digests(a, b, end_a, end_b, shared, n_a + n_b), links

    def _digests(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, shared: np.ndarray, tokens: np.ndarray) -> list[str]:
        """The digest of each text's groups, spelt as ids of a, a bar, ids of b and a semicolon between groups."""
        in_a, in_b, number = np.searchsorted(shared, end_a, side="left"), np.searchsorted(shared, end_b, side="left"), np.arange(len(shared))
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(in_b, number, side="left")[in_a]] = a + np.where(np.append(in_a[1:] != in_a[:-1], True)[: len(a)], 1 << 16, 0)
        code[np.arange(len(b)) + np.searchsorted(in_a, number, side="right")[in_b]] = b + np.where(np.append(in_b[1:] != in_b[:-1], True)[: len(b)], 2 << 16, 0)
        out, at = [], 0
        for k in range(0, len(tokens), 256):  # so that few bytes are spelt at a time
            n = tokens[k : k + 256]
            part = code[at : at + int(n.sum())]
            at += len(part)
            spelt = self.rows[part].ravel()
            spelt = memoryview(spelt[spelt != 0])
            stop = np.concatenate([[0], np.cumsum(self.length[part])])[np.concatenate([[0], np.cumsum(n)])].tolist()
            out += [hashlib.sha256(spelt[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(stop[:-1], stop[1:], strict=True)]
        return out


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in a row."""
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


def _by_stripe(links: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed row for each stripe: distinct pairs (as differences), documents of each, the documents, how often each has the pair."""
    key, times = _runs(links)
    cuts = np.searchsorted(key, np.arange(STRIPES + 1, dtype=np.uint64) << np.uint64(58)) if STRIPES < 64 else np.append(np.searchsorted(key, np.arange(64, dtype=np.uint64) << np.uint64(58)), len(key))
    for stripe, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if y > x:
            pair, docs = _runs((key[x:y] >> np.uint64(26)).astype(np.uint32))
            yield stripe, packed(np.diff(pair, prepend=np.uint32(0)), docs.astype(np.uint32), (key[x:y] & np.uint64((1 << 26) - 1)).astype(np.uint16), times[x:y].astype(np.uint32))


def _aligned(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """A row for each document, and one for each lot and stripe with the lot's links."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = Aligner.of(bpe, pieces), TaskContext.get().partitionId() << 32
        for batch in parts:
            text = batch.column("text").cast(pa.large_binary())
            for x, y in groups(text, LOT):
                for a in range(x, y, MANY):
                    b = min(y, a + MANY)
                    counts, digests, links = aligner(*bytes_of(text.slice(a, b - a)))
                    lots = list(_by_stripe(links))
                    m, n = b - a, len(lots)
                    none = pa.nulls
                    columns = {"chunk": np.full(m, chunk), "at": np.arange(m, dtype=np.int32), "doc_id": batch.column("doc_id").slice(a, m), **counts, "groups_sha256": digests}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else none(m, f.type) for f in DOC], schema=DOC)
                    columns = {"chunk": np.full(n, chunk), "stripe": [s for s, _ in lots], "payload": [p for _, p in lots]}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else none(n, f.type) for f in DOC], schema=DOC)
                    chunk += 1
        release()

    return keyed(docs).mapInArrow(run, f"{_LINKS}, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


def _partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, added up within a task: a packed row for each block of each stripe."""
    pairs, counts = [], []

    def add() -> None:
        key, n = np.concatenate(pairs), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pairs[:], counts[:] = [key[first]], [np.add.reduceat(n[order], first)]

    def rows() -> pa.RecordBatch:
        add()
        key, n, out = pairs[0], counts[0], {"stripe": [], "block": [], "payload": []}
        for x, y in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(29) != key[:-1] >> np.uint64(29)])), len(key)).tolist()), strict=True):
            out["stripe"].append(int(key[x] >> np.uint64(32)))
            out["block"].append(int(key[x] >> np.uint64(29)) & 7)
            out["payload"].append(packed(np.diff(key[x:y].astype(np.uint32), prepend=np.uint32(0)), n[x:y]))
        pairs.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(out["stripe"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["payload"], pa.binary())], ["stripe", "block", "payload"])

    for batch in parts:
        for stripe, payload in zip(batch.column("stripe").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            pair, docs, _, _ = unpacked(payload)
            pairs.append(np.cumsum(pair, dtype=np.uint32).astype(np.uint64) | np.uint64(stripe << 32))
            counts.append(docs.astype(np.uint64))
            if sum(map(len, pairs)) > MERGED:
                add()
                if len(pairs[0]) > MERGED // 2:
                    yield rows()
    if pairs:
        yield rows()


def _dense(partners: int):
    """Adds partial counts up in dense blocks; a row for each block: its pairs, their counts, and 1 where a count is its row's maximum."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, matrix = None, np.zeros((BLOCK, partners), np.int64)

        def done() -> pa.RecordBatch:
            best = matrix.max(1)
            row, partner = np.nonzero(matrix)
            count = matrix[row, partner]
            pair = ((row + block[1] * BLOCK) << int(_ROW) | partner).astype(np.uint32)
            payload = packed(np.diff(pair, prepend=np.uint32(0)), count.astype(np.uint64), (count == best[row]).astype(np.uint8))
            matrix[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([block[0]], pa.int32()), pa.array([block[1]], pa.int32()), pa.array([payload], pa.binary())], ["stripe", "block", "payload"])

        for batch in parts:
            for *key, payload in zip(*(batch.column(c).to_pylist() for c in ("stripe", "block", "payload")), strict=True):
                if block is not None and key != block:
                    yield done()
                block, (pair, count) = key, unpacked(payload)
                pair = np.cumsum(pair, dtype=np.uint32)
                np.add.at(matrix, ((pair >> np.uint32(_ROW)) % BLOCK, pair & np.uint32((1 << int(_ROW)) - 1)), count.astype(np.int64))
        if block is not None:
            yield done()

    return run


def pair_counts(links: DataFrame, partners: int) -> DataFrame:
    """stripe, block, payload of all counts, from the packed ``links``."""
    partial = links.mapInArrow(_partial, "stripe int, block int, payload binary")
    return partial.repartition("stripe", "block").sortWithinPartitions("stripe", "block").mapInArrow(_dense(partners), "stripe int, block int, payload binary")


def _scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each lot: how many links are best ones, and the sum of counts, of each document; a stripe's counts come before its links."""
    held, known, counts, best, key = [], None, None, None, None
    for batch in parts:
        for stripe, part, chunk, payload in zip(*(batch.column(c).to_pylist() for c in ("stripe", "part", "chunk", "payload")), strict=True):
            if (stripe, part) != key:
                key, held, known = (stripe, part), [], None
            if chunk is None:
                held.append(unpacked(payload))
                continue
            if known is None:
                known = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in held])
                order = np.argsort(known)
                known, counts, best = known[order], np.concatenate([x[1] for x in held])[order].astype(np.int64), np.concatenate([x[2] for x in held])[order].astype(np.int64)
                held = []
            pair, docs, doc, times = unpacked(payload)
            at = np.searchsorted(known, np.cumsum(pair, dtype=np.uint32))
            times, n = times.astype(np.int64), int(doc.max()) + 1
            sums, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, doc, times * np.repeat(counts[at], docs))
            np.add.at(top, doc, times * np.repeat(best[at], docs))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([packed(top.view(np.uint64), sums.view(np.uint64))], pa.binary())], ["chunk", "payload"])
    release()


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, at, n_best, count_sum of each document that has links, of rows sorted by lot."""
    now, total = None, [np.empty(0, np.int64)] * 2

    def done() -> pa.RecordBatch:
        some = np.flatnonzero(total[0] | total[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now)), pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["chunk", "at", "n_best", "count_sum"])

    for batch in parts:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if now is not None and chunk != now:
                yield done()
                total = [np.empty(0, np.int64)] * 2
            now, found = chunk, [x.view(np.int64) for x in unpacked(payload)]
            n = max(len(found[0]), len(total[0]))
            total = [np.pad(t, (0, n - len(t))) + np.pad(x, (0, n - len(x))) for t, x in zip(total, found, strict=True)]
    if now is not None:
        yield done()


def aligned(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    A null or empty text has no tokens; nor has one whose tokens do not join to a space and the text
    (one with the metaspace mark in it). Rows that repeat a doc_id, or have none, are documents of
    their own, and each counts. Equal counts of an id's partners are all best. A long text is one
    lot. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    from sentencepiece import SentencePieceProcessor

    rows = cut(_aligned(docs, bpe, pieces), "aligned")
    links = rows.filter("stripe IS NOT NULL").select("chunk", "stripe", "payload")
    counts = cut(pair_counts(links.select("stripe", "payload"), SentencePieceProcessor(model_file=pieces).get_piece_size()), "pair-counts")
    size = dict(links.groupBy("stripe").agg(F.sum(F.octet_length("payload"))).collect())  # a row a stripe
    many = F.element_at(F.array(*(F.lit(int(-(-size.get(s, 0) // PART) or 1)) for s in range(STRIPES))), F.col("stripe") + 1)
    copied = counts.select("stripe", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), F.lit(None).cast("long").alias("chunk"), "payload")
    dealt = copied.unionByName(links.select("stripe", F.pmod(F.xxhash64("chunk"), many).cast("int").alias("part"), "chunk", "payload"))
    scored = dealt.repartition("stripe", "part").sortWithinPartitions("stripe", "part", "chunk").mapInArrow(_scored, "chunk long, payload binary")
    totals = cut(scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk long, at int, n_best long, count_sum long"), "scores")
    drop(counts)
    found = rows.filter("stripe IS NULL").drop("stripe", "payload").join(totals, ["chunk", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(unkeyed(), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
