"""SentencePiece models on the tokenizers library: rebuilt from the model file, checked against the original.

``parse_model`` reads the protobuf wire format. ``rebuild`` makes a tokenizer from it: the model's
normaliser (precompiled map, spaces removed, dummy prefix, the metaspace marker), unigram scores or
the merges that the scores of a BPE model imply, byte fallback, and a decoder. Texts are encoded in
multithreaded batches.

Large corpora repeat words, so texts are cut before a space that follows another character, and
around line feeds, if no piece of the vocabulary reaches across such a place; then no merge or
segment can either. Each distinct part is encoded once a lot of texts (see ``pieces``). Models whose
normaliser does more than mark spaces, or whose pieces reach across, have their texts encoded whole.

The ids are always this backend's. Parity: each distinct part (or whole text) is also encoded by the
sentencepiece library, whatever the model, and the document says in ``parity`` whether both agree.
They differ only where two merges that make the same piece compete for a character: the original
takes the leftmost, a merge list has an order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from korridor.llm.common import batches, bytes_of, keyed, release, unkeyed
from korridor.llm.pieces import PieceEncoder, flat, groups, parted, ranges

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


def parse_model(path: str) -> Model:
    model = Model()
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            x = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0], x[3]))
        elif number == 2:
            x = dict(_fields(value))
            model.bpe, model.byte_fallback = x.get(3, 1) == 2, bool(x.get(35, 0))
        elif number == 3:
            x = dict(_fields(value))
            model.charsmap = x.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best-scored piece first; of one piece, the longest left part first."""
    place = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in place.items():
        for k in range(1, len(piece)):
            left, right = place.get(piece[:k]), place.get(piece[k:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], i, -k, piece[:k], piece[k:]))
    return [(x[3], x[4]) for x in sorted(found)]


def rebuild(model: Model):
    """A tokenizer with the ids of the model. Only its normaliser knows of spaces."""
    from tokenizers import Tokenizer, decoders, models

    unknown = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
    if model.bpe:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        inner = models.BPE(vocabulary, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        inner = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(inner)
    tokenizer.normalizer = normaliser(model)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


def normaliser(model: Model):
    """What ``rebuild`` does to a text before its model sees it."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


class Backend:
    """Encoding and decoding with one model file; one for each process and path."""

    _made: dict[str, Backend] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        self.model = model = parse_model(path)
        self.tokenizer = rebuild(model)
        self.normaliser, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = not model.charsmap and not model.remove_extra_spaces and model.dummy_prefix and model.escape_spaces
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_part = plain and len(self.feed) == 1 and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, kind in model.pieces if kind in (NORMAL, USER))
        self.parts = PieceEncoder(_part_starts, self._encode, lot=2 << 20)
        out = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.bytes, self.size = np.frombuffer(b"".join(out), np.uint8), np.array([len(x) for x in out], np.int64)
        self.at = np.cumsum(self.size) - self.size

    @classmethod
    def of(cls, path: str) -> Backend:
        if path not in cls._made:
            cls._made.clear()  # a worker holds one model
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of parts, how many each has, and 1 for each where the original has others, 2 where decoding gives another text.

        A line feed joins no piece, so many parts are encoded at a time with line feeds between.
        """
        lots = ["\n" + "\n".join("" if p == "\n" else p for p in parts[i : i + 200]) for i in range(0, len(parts), 200)]
        feeds = np.array([p == "\n" for p in parts])
        found = []
        for rows in ([e.ids for e in self.tokenizer.encode_batch_fast([x.replace(" ", MARK) for x in lots], add_special_tokens=False)], self.original.encode(lots, num_threads=1)):
            rows = [x[x.index(self.feed[0]) :] for x in rows]  # the original begins with its dummy prefix
            ids, _ = flat(rows)
            found.append((ids, parted(ids, self.feed[0], len(parts))))
        (mine, count), (theirs, expect) = found
        flags = np.zeros(len(parts), np.uint8)
        if not np.array_equal(mine, theirs):
            flags[count != expect] = 1
            same = np.flatnonzero(count == expect)
            one, other = (ids[ranges((np.cumsum(n + 1) - n)[same], n[same])] for ids, n in found)
            flags[same[np.unique(np.repeat(np.arange(len(same)), count[same])[one != other])]] = 1
        # a feed is its own id, of any other part the feed before it goes
        start, count = np.cumsum(count + 1) - count - feeds, count + feeds
        ids, text = mine[ranges(start, count)], [p.encode() for p in parts]
        back, size = self._bytes(ids)
        back = back.tobytes()
        if back != b"".join(text):
            reach = np.concatenate([[0], np.cumsum(size)])
            stop = np.cumsum(count)
            flags |= np.array([2 * (back[a:b] != t) for a, b, t in zip(reach[stop - count].tolist(), reach[stop].tolist(), text, strict=True)], np.uint8)
        return ids, count, flags

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts given as UTF-8 bytes, where each text's end, whether both libraries agree, whether decoding gives the text."""
        size = np.diff(ends, prepend=0)
        if not self.by_part:
            texts = [raw[b - n : b].tobytes().decode("utf-8", "replace") for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
            rows = [e.ids for e in self.tokenizer.encode_batch_fast([self.normaliser.normalize_str(t) if t else "" for t in texts], add_special_tokens=False)]
            ids, count = flat(rows)
            agree = np.array([a == b for a, b in zip(rows, self.original.encode(texts, num_threads=1), strict=True)], bool)
            return ids, np.cumsum(count), agree, np.array([self.decode(np.array(a, np.int64)) == t for a, t in zip(rows, texts, strict=True)], bool)
        some = size > 0
        raw, ends = np.insert(raw, (ends - size)[some], 32), ends + np.cumsum(some)  # the dummy prefix
        ids, stop, flags = self.parts.texts(raw, ends)
        return ids, stop, flags & 1 == 0, flags & 2 == 0

    def _bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ids stand for, and how many bytes each has."""
        length = self.size[ids]
        return self.bytes[ranges(self.at[ids], length)], length

    def decode(self, ids: np.ndarray) -> str:
        text = self._bytes(ids)[0].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _part_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes where no piece reaches across: a space after another character, and both sides of a line feed."""
    mark = np.zeros(len(raw), bool)
    feed = raw == 10
    mark[1:] = feed[1:] | feed[:-1] | (raw[1:] == 32) & (raw[:-1] != 32)
    if len(raw) > 3:  # the marker itself is a space to the model
        marker = np.flatnonzero((raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81) & (raw[3:] == 32))
        mark[marker + 3] = False
    return mark


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned, of little-endian 32-bit ids), round_trip, parity of each row.

    ``round_trip``: decoding every id gives the text back, character for character (a text with the
    marker itself does not come back). ``parity``: the sentencepiece library gives the same ids. A
    null or empty text has no ids. Rows that repeat a doc_id are encoded each, long texts a lot at a
    time; other columns are not looked at, whatever their names. An empty table gives no rows.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = Backend.of(path)
        for batch in parts:
            text = batch.column("text").cast(pa.large_binary())
            for a, b in groups(text):
                ids, stop, agree, whole = backend.encode(*bytes_of(text.slice(a, b - a)))
                begin = np.concatenate([[0], stop[:-1]])
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield from batches(ENCODED, {"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": stop - begin, "ids_crc32": crc, "round_trip": whole, "parity": agree})
        release()

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean").withColumn("doc_id", unkeyed())
