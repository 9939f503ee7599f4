"""Token ids of every document in compact files, and back.

Ids are replaced by their rank in the corpus (0: the most frequent), so that frequent ids are small,
and ranks are written in a byte-aligned variable-length code whose control bytes stand apart from the
data: two bits of a control byte say how many bytes (1 to 4) each of four ranks takes. Decoding looks
the lengths of four ranks up by control byte and gathers all data bytes with numpy.

A shard holds the documents of one range of doc_id, ascending:

    magic 8 bytes | n_docs u64 | n_tokens u64 | n_data u64 | doc_id i64 each | length u64 each | control | data

all little-endian. The files are a Parquet table with a shard a row (``range`` of doc_id, ``part`` within
it, n_docs, n_tokens, ``payload``), so any store that Spark writes to will do,
beside a table of one row with the id of each rank. The ranks are bounded by the tokenizer's
vocabulary; nothing else is broadcast or collected.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korridor.llm.common import batches, bytes_of, cut, drop, keyed, shared_dir, unkeyed
from korridor.llm.pieces import PieceEncoder, flat, groups, parted, ranges

MAGIC = b"KRTOKEN1"
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
SHARD = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
READ = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: byte-level BPE writes each byte as a character: printable ones as themselves, the rest from 256 on
_BYTES = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_NEVER, _LATIN_END = chr(_BYTES[255]), "\u0240"  # a byte that no text has; letters up to U+023F are so in every Unicode version
#: white space beyond ASCII, its last three bytes as a number (a byte that is not its own is masked out)
_WIDE = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_KIND = np.zeros(256, np.uint8)  # of a byte: 1 white space, 2 an ASCII letter, 4 any other ASCII sign, 8 unsure (FS to US), 0 not ASCII
_KIND[:128], _KIND[[9, 10, 11, 12, 13, 32]], _KIND[65:91], _KIND[97:123], _KIND[28:32] = 4, 1, 2, 2, 8
_made: dict[tuple[str, bool], ByteBpe] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes where byte-level BPE begins a new word whatever stands around.

    Its words are runs of letters, of digits, of other signs, each with one space before it, or white
    space; none has white space after something else, and none goes on from letters into other signs.
    So a text may be cut before white space, after a lone line feed, and after a letter that an ASCII
    sign follows. Bytes beyond ASCII are looked at only as far as needed; in doubt nothing is cut.
    """
    kind, mark = _KIND[raw], np.zeros(len(raw), bool)
    if len(raw) < 2:
        return mark
    here, before = kind[1:], kind[:-1]
    mark[1:] = (before == 2) & ((here == 1) | (here == 4) | (here == 8)) | (before == 4) & (here == 1)
    mark[2:] |= (raw[1:-1] == 10) & ((kind[:-2] == 2) | (kind[:-2] == 4)) & ((kind[2:] == 2) | (kind[2:] == 4) | (raw[2:] >> 3 == 24) & (raw[2:] >= 0xC3))
    after = np.flatnonzero((before == 0) & (here != 0) & (here != 2)) + 1  # the character before is not ASCII
    after = after[after >= 3]
    if len(after):
        last, middle, first = (raw[after - k].astype(np.int64) for k in (1, 2, 3))
        latin = (middle >= 0xC3) & (middle <= 0xC8) & ~((middle == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        blank = (middle == 0xC2) & ((last == 0x85) | (last == 0xA0)) | np.isin(first << 16 | middle << 8 | last, _WIDE)
        mark[after] = np.where(kind[after] == 1, ~blank, latin)
    return mark


class ByteBpe:
    """A tokenizer file, applied piece by piece (see ``pieces``).

    Special tokens that stand in a text get their own ids, as in a plain call of the library; with
    ``as_text`` they are ordinary text. Distinct pieces of letters go to the tokenizer's model as they
    are, many in a row with a byte between that no text has and no merge joins; all others go through
    the whole tokenizer in batches.
    """

    def __init__(self, path: str, as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("a special token that takes in what stands around it")
        self.special = [t.content.encode() for t in added if not as_text]
        self.model = Tokenizer.from_str(self.tokenizer.to_str())
        self.model.pre_tokenizer = self.model.post_processor = None
        never = self.model.encode(_NEVER, add_special_tokens=False).ids
        self.never = never[0] if len(never) == 1 else None
        self.pieces = PieceEncoder(self._starts, self._encode)

    def _starts(self, raw: np.ndarray) -> np.ndarray:
        mark, whole = word_starts(raw), raw.tobytes() if self.special else b""
        for token in self.special:
            at = -1
            while (at := whole.find(token, at + 1)) >= 0:
                mark[at + 1 : at + len(token)] = False
            tail = max((k for k in range(1, len(token)) if whole.endswith(token[:k])), default=0)
            mark[len(raw) - tail + 1 :] = False  # one that these bytes cut short
        return mark

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [self.never is not None and (w := p[1:] if p[0] == " " else p).isalpha() and (w.isascii() or max(w) < _LATIN_END) for p in pieces]
        letters = [p for p, ok in zip(pieces, plain, strict=True) if ok]
        other = [p for p, ok in zip(pieces, plain, strict=True) if not ok]
        lots = [b"".join(b"\xff" + p.encode() for p in letters[i : i + 100]).decode("latin-1").translate(_BYTES) for i in range(0, len(letters), 100)]
        ids = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(lots, add_special_tokens=False)]
        one = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        n_one = parted(one, self.never, len(letters)) if letters else np.empty(0, np.int64)
        two, n_two = flat([e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)] if other else [])
        # back to the order of the pieces
        place = np.empty(len(pieces), np.int64)
        ok = np.array(plain, bool)
        place[ok], place[~ok] = np.arange(len(letters)), len(letters) + np.arange(len(other))
        count = np.concatenate([n_one, n_two])
        whole = np.concatenate([one[one != self.never] if letters else one, two])
        start = np.cumsum(count) - count
        return whole[ranges(start[place], count[place])], count[place], np.zeros(len(pieces), np.uint8)


def byte_bpe(path: str, as_text: bool = False) -> ByteBpe:
    """The one of this process for the tokenizer file at ``path``."""
    if (path, as_text) not in _made:
        _made.clear()  # a worker holds one tokenizer
        _made[path, as_text] = ByteBpe(path, as_text)
    return _made[path, as_text]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (unsigned 32-bit)."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks that ``pack`` was given."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.frombuffer(data + bytes(3), np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        out |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[length]


def pack_shard(docs: list[tuple[int, bytes]], rank: np.ndarray) -> bytes:
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
    control, data = pack(rank[ids])
    head = np.array([len(docs), len(ids), len(data)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array([d for d, _ in docs], "<i8").tobytes(), np.array([len(x) // 2 for _, x in docs], "<u8").tobytes(), control, data])


def unpack_shard(payload: bytes, ids_by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and length of each document of a shard, and all their ids in a row."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_tokens, n_data = (int(x) for x in np.frombuffer(payload, "<u8", 3, 8))
    doc_id, length = np.frombuffer(payload, "<i8", n_docs, 32), np.frombuffer(payload, "<u8", n_docs, 32 + 8 * n_docs)
    at = 32 + 16 * n_docs
    end = at + -(-n_tokens // 4)
    return doc_id, length.astype(np.int64), ids_by_rank[unpack(payload[at:end], payload[end : end + n_data], n_tokens)]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 1 << 16, shard_tokens: int = 4 << 20, as_text: bool = False) -> None:
    """Encode every whole text and write it, with ``end_id`` appended, to ``path`` in ascending doc_id order.

    A null text is empty and has the end id alone; a null doc_id sorts first. Rows that repeat a
    doc_id, or have none, are written one after the other, by a hash of their tokens, in as many ranges as
    they fill. A long text is one row of a
    shard however long it is. An empty table has no shards. Other columns are not looked at, whatever
    their names. ``vocabulary`` bounds the ids, at 65,536 at most; ``as_text``: see ``ByteBpe``.
    """
    spark = docs.sparkSession

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer, as_text).pieces
        for batch in parts:
            text = batch.column("text").cast(pa.large_binary())
            for a, b in groups(text):
                ids, stop, _ = encoder.texts(*bytes_of(text.slice(a, b - a)))
                out = np.insert(ids.astype("<u2"), stop, end_id)
                offsets = np.concatenate([[0], 2 * (stop + np.arange(1, b - a + 1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(out)])], schema=TOKENS)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in parts:
            for x in batch.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=vocabulary) if x.as_buffer().size > vocabulary else 0
            small = b"".join(x.as_py() for x in batch.column("ids") if x.as_buffer().size <= vocabulary)
            total += np.bincount(np.frombuffer(small, "<u2"), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield from batches(COUNTS, {"id": seen, "n": total[seen]})

    tokens = keyed(docs).mapInArrow(encode, "doc_id long, ids binary").withColumns({"tie": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    tokens = cut(tokens, "tokens", "zstd")
    order = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # no more rows than the vocabulary has ids
    seen, total = np.array([r.id for r in order], np.int64), sum(r.n for r in order)
    ids_by_rank = seen.astype("<u4")
    rank = np.zeros(vocabulary, np.uint32)
    rank[seen] = np.arange(len(seen))
    shared = spark.sparkContext.broadcast(rank)

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, place = [], 0, 0, TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            return next(batches(SHARD, {"range": [place], "part": [part], "n_docs": [len(held)], "n_tokens": [size // 2], "payload": [pack_shard(held, shared.value)]}))

        for batch in parts:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc_id, ids))
                size += len(ids)
                if size >= 2 * shard_tokens:
                    yield shard()
                    held, size, part = [], 0, part + 1
        if held:
            yield shard()

    # ranges of about eight shards, however many tokens there are
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * shard_tokens)))
    ranged = tokens.repartitionByRange(many, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    ranged.select("doc_id", "ids").mapInArrow(shards, "range long, part long, n_docs long, n_tokens long, payload binary").write.parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(ids_by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    shared.unpersist()
    drop(tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the files at ``path``."""
    ids_by_rank = np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first().ids), "<u4")  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(ids_by_rank)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(len(batch)):
                doc_id, length, ids = unpack_shard(batch.column("payload")[i].as_py(), shared.value)
                end = np.cumsum(length)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
                same = np.full(len(doc_id), 0, np.int64)
                yield from batches(READ, {"range": same + batch.column("range")[i].as_py(), "part": same + batch.column("part")[i].as_py(), "doc_id": doc_id.astype(np.int64), "at": end - length, "n_tokens": length, "ids_crc32": crc})

    files = spark.read.parquet(f"{path}/shards")
    first = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    ranged = files.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", first.alias("first"))
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("range", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside")).join(ranged, "range")
    rows = files.select("range", "part", "payload").mapInArrow(read, "range long, part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(before, ["range", "part"]).select(unkeyed(), (F.col("first") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, as_text: bool = False) -> DataFrame:
    """Write the files (to the shared folder if no ``path`` is given) and read every document back from them."""
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id, as_text=as_text)
    return read_token_files(docs.sparkSession, path)
