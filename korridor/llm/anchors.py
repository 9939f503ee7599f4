"""Names of byte strings by prefix doubling, and the sampled positions that carry them.

``names(raw, 2h)[p]`` is made from the pair ``(names(raw, h)[p], names(raw, h)[p + h])``: the
classic doubling step, with a 64-bit mix of the pair in the place of a dense rank, so that equal
strings have equal names in every task without a global sort per length.

A window of ``width`` bytes owns one position, its *anchor*: the place inside it where the name of
``KEY`` bytes is least (the leftmost of ties). Equal windows own the same place relative to their
start, so two equal strings always meet at an anchor, and one position in about 35 is an anchor.
"""

from __future__ import annotations

import numpy as np

KEY = 32  #: bytes under an anchor
LONG = 64  #: bytes of the longest name
_POS = np.uint64((1 << 24) - 1)
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * j & (1 << 64) - 1 | 1) for j in range(8)]
_BYTES = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pair(left: np.ndarray, right: np.ndarray, k: np.uint64) -> np.ndarray:
    """The name of a pair of names."""
    out = left * k
    out += right
    out ^= out >> np.uint64(31)
    out *= _ODD[0]
    out ^= out >> np.uint64(32)
    return out


def names(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the KEY and of the LONG bytes that start at each position (as many as fit)."""
    x, h, key = _BYTES[raw], 1, None
    while h < LONG:
        x = _pair(x[:-h], x[h:], _ODD[h.bit_length()])
        h *= 2
        if h == KEY:
            key = x
    return key, x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    h = 1
    while 2 * h <= width:
        x = np.minimum(x[:-h], x[h:])
        h *= 2
    return np.minimum(x[: len(x) - (width - h)], x[width - h :]) if width > h else x


def anchors(raw: np.ndarray, ends: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The anchors of all windows of ``width`` bytes within the documents that end at ``ends``.

    Returns arrays with an entry for each anchor: ``doc`` (index), ``lo`` and ``hi`` (the first and
    last start of the windows that own it, from the start of the document), ``at`` (the anchor),
    ``name`` (its KEY bytes) and ``context`` (all bytes that its windows cover).
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    empty = {k: np.empty(0, np.int64) for k in ("doc", "lo", "hi", "at", "name", "context")}
    if len(raw) < width or not (ends - starts >= width).any():
        return empty
    key, long = names(raw)
    least = _least((key & ~_POS) | np.arange(len(key), dtype=np.uint64) & _POS, width - KEY + 1)
    n = len(raw) - width + 1
    owner = (least[:n] & _POS).astype(np.int64)
    doc_len = ends - starts
    valid = np.zeros(n + 1, np.int8)
    ok = doc_len >= width
    np.add.at(valid, starts[ok], 1)
    np.add.at(valid, ends[ok] - width + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    owner[~valid] = -1
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [n]]) - 1
    keep = owner[lo] >= 0
    lo, hi = lo[keep], hi[keep]
    at = owner[lo]
    stop = hi + width - LONG
    context = _pair(_pair(long[lo], long[(lo + stop) // 2], _ODD[1]), long[stop], _ODD[2])
    context = _pair(context, ((hi - lo) * 4096 + at - lo).astype(np.uint64), _ODD[3])
    doc = np.searchsorted(ends, lo, side="right")
    return {"doc": doc, "lo": lo - starts[doc], "hi": hi - starts[doc], "at": at - starts[doc], "name": key[at].view(np.int64), "context": context.view(np.int64)}


def window_names(raw: np.ndarray, width: int) -> np.ndarray:
    """The name of the ``width`` bytes (64 to 128) that start at each position."""
    _, long = names(raw)
    return _pair(long[: len(raw) - width + 1], long[width - LONG :], _ODD[4]).view(np.int64)


def pair(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """The name of a pair of names, apart for each ``k`` below eight."""
    return _pair(left, right, _ODD[k])
