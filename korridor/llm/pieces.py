"""Ids of whole texts by way of their distinct pieces, in arrays.

A tokenizer says where a text may be cut without changing its ids. All bytes of many texts are cut at
once; Arrow finds the distinct pieces; only those that were not met lately go to the tokenizer; the
ids of every text are gathered by piece. No string is made for a piece that is known, and what is
remembered is bounded: a word list and three arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOT = 4 << 20  #: bytes that are cut at a time
ONCE = 20_000  #: pieces that are encoded at a time

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def white(raw: np.ndarray) -> np.ndarray:
    """Bytes that are ASCII white space."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids as one array and their lengths."""
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for row in rows for i in row), np.uint32, int(n.sum())), n


def parted(ids: np.ndarray, separator: int, pieces: int) -> np.ndarray:
    """How many ids each piece has in ``ids``, a separator before each piece."""
    at = np.flatnonzero(ids == separator)
    if len(at) != pieces:
        raise ValueError("a separator joined a piece")
    return np.diff(np.append(at, len(ids))) - 1


class PieceEncoder:
    """Encodes texts piece by piece.

    ``cuts`` marks the bytes where a piece begins; it is given bytes that begin with a piece. ``encode``
    gives for distinct pieces all their ids in a row, how many each has, and a flag of eight bits for
    each. At most about ``most`` pieces are remembered; then only those of the last lot stay.
    """

    def __init__(self, cuts: Callable[[np.ndarray], np.ndarray], encode: Encode, most: int = 250_000, lot: int | None = None) -> None:
        self.cuts, self.encode, self.most, self.lot = cuts, encode, most, lot
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.count, self.flags = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint8)

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each piece among those remembered; missing ones are encoded first."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            missing, before = at.is_null(), len(self.words)
            new = words.filter(missing)
            found = [(self.ids, self.count, self.flags), *(self.encode(new.slice(i, ONCE).to_pylist()) for i in range(0, len(new), ONCE))]
            self.words = pa.concat_arrays([self.words, new])
            self.ids, self.count, self.flags = (np.concatenate(x) for x in zip(*found, strict=True))
            at = at.to_numpy(zero_copy_only=False)
            new = np.isnan(at)
            at[new] = before + np.arange(int(new.sum()))
            return at.astype(np.int64)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _trim(self, used: np.ndarray) -> None:
        if len(self.words) <= self.most:
            return
        keep = np.unique(used)
        start = np.cumsum(self.count) - self.count
        self.ids = self.ids[ranges(start[keep], self.count[keep])]
        self.words, self.count, self.flags = self.words.take(pa.array(keep)), self.count[keep], self.flags[keep]

    def _lots(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Where pieces begin and the last ends, a lot at a time. ``starts``: where texts begin."""
        at = 0
        while at < len(raw):
            size = self.lot or LOT
            while True:
                part = raw[at : at + size]
                mark = self.cuts(part)
                first, last = np.searchsorted(starts, (at, at + len(part)))
                mark[starts[first:last] - at] = True
                mark[0] = True
                begin = np.flatnonzero(mark)
                if at + size >= len(raw):
                    begin = np.append(begin, len(part))
                    break
                if len(begin) > 1:
                    break
                size *= 2
            yield begin + at
            at += int(begin[-1])

    def __call__(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each lot of all texts' bytes: its ids, the text of each piece, the ids and flags of each.

        Yields (ids, owner, count, flags); a text longer than a lot goes on in the next.
        """
        starts = np.concatenate([[0], ends[:-1]])
        for begin in self._lots(raw, starts[ends > starts]):
            low, high = begin[0], begin[-1]
            pieces = pa.Array.from_buffers(pa.large_string(), len(begin) - 1, [None, pa.py_buffer((begin - low).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[low:high]))])
            coded = pieces.dictionary_encode()
            place = self._known(coded.dictionary)[coded.indices.to_numpy()]
            start = np.cumsum(self.count) - self.count
            count = self.count[place]
            yield self.ids[ranges(start[place], count)], np.searchsorted(ends, begin[:-1], side="right"), count, self.flags[place]
            self._trim(place)

    def texts(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, where each text's end, and each text's flags (or-ed)."""
        ids, total, flags = [], np.zeros(len(ends), np.int64), np.zeros(len(ends), np.uint8)
        for found, owner, count, flag in self(raw, ends):
            ids.append(found)
            total += np.bincount(owner, count, len(ends)).astype(np.int64)
            marked = np.flatnonzero(flag)
            np.bitwise_or.at(flags, owner[marked], flag[marked])
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.cumsum(total), flags


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``count`` of them."""
    end = np.cumsum(count)
    return np.repeat(start - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)


def groups(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Slices of an Arrow column of large binary values, about ``most`` bytes each and one value at least."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, stop
        at = stop
