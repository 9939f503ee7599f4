from __future__ import annotations

import hashlib
import random

import pytest

from korridor.llm.suffix_dedup import suffix_dedup


def brute(rows, width=100):
    """Each byte under a string that starts earlier, by looking at every start."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w in seen:
                gone[p : p + width] = [True] * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 40)) for _ in range(r.randint(0, 4))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 60)
            parts.insert(r.randint(0, len(parts)), s[a : a + r.randint(60, 200)])
        rows.append((i * 3, " ".join(parts)))
    rows += [(1000, "x" * 500), (1001, "x" * 350), (1002, "ab" * 150), (1003, None), (1004, ""), (None, shared[0]), (1005, rows[5][1]), (1006, rows[5][1] + "!")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [1024, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_start(spark, monkeypatch, seed, share):
    import korridor.llm.suffix_dedup as m

    monkeypatch.setattr(m, "SHARE", share)  # with the larger one every name is hot
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
    assert got == brute(rows)


def test_long_document_in_segments(spark, monkeypatch):
    import korridor.llm.suffix_dedup as m

    rows = [(i, t) for i, t in corpus(3, 20) if i is not None]
    from korridor.llm.anchors import anchors
    import numpy as np

    monkeypatch.setattr(m, "SEGMENT", 256)
    monkeypatch.setattr(m, "BUFFER", 128)
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    ends = np.cumsum([len((t or "").encode()) for _, t in rows])
    windows = set()
    for piece, stops, ids, shift in m._segments(raw, ends, np.arange(len(rows)), 100):
        x = anchors(piece, stops, 100)
        for d, lo, hi in zip(x["doc"], x["lo"], x["hi"]):
            windows |= {(int(ids[d]), int(p + shift[d])) for p in range(lo, hi + 1)}
    assert windows == {(i, p) for i, (_, t) in enumerate(rows) for p in range(len((t or "").encode()) - 99)}


def test_repeated_rows_empty_table_and_other_columns(spark):
    text = "the same words again and again, " * 1 + "z" * 90
    df = spark.createDataFrame([(1, text, "a", 7), (1, text, "b", 8), (2, "short", None, None)], "doc_id long, text string, name string, lo int")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, 0)]
    assert suffix_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1024, 100_000])
def test_ids_that_repeat_with_different_texts(spark, monkeypatch, share):
    """Rows of one id with different texts are documents in some order of their own: each string goes but once."""
    import korridor.llm.suffix_dedup as m

    monkeypatch.setattr(m, "SHARE", share)
    r = random.Random(4)
    words = lambda k: " ".join(str(r.randint(0, 10**9)) for _ in range(k))
    passage = words(30)
    rows = [(i, words(20) + passage + words(20)) for i in (1, 1, 2, None, None, 7, 7)] + [(7, passage)] * 2
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    removed = sorted((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in got)
    whole = [n for _, _, n in removed if n >= len(passage)]
    assert len(whole) == len(rows) - 1 and min(x[2] for x in removed if not x[0]) == 0  # one null id's text comes first
    assert {x.n_removed for x in got if x.n_bytes == len(passage)} == {len(passage)}


def test_one_very_long_text(spark, monkeypatch):
    import korridor.llm.suffix_dedup as m

    monkeypatch.setattr(m, "SEGMENT", 5_000)
    r = random.Random(6)
    words = lambda k: " ".join(str(r.randint(0, 10**6)) for _ in range(k))
    passage = words(60)
    rows = [(1, words(3_000) + passage + words(2_000) + passage + words(300)), (2, passage[7:] + words(5)), (3, "x" * 20_000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
