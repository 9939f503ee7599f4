from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import korridor.llm.alignment as m  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def corpus(seed=1, n=120):
    r = random.Random(seed)
    wild = ["".join(r.choice("ab  \n\t\x85.,'é😀<s>12\r") for _ in range(r.randint(0, 60))) for _ in range(n)]
    plain = [" ".join(r.choice(["the", "Haus,", "schön.", "don't", "x1", "ñandú"]) for _ in range(r.randint(1, 80))) for _ in range(n)]
    texts = [*wild, *plain, None, "", " ", "  two", "mark ▁ here", "<|endoftext|>", "</s>", "<0x41>", "a\nb\n c", "word. " * 30_000]
    return [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BPE), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printed)}
    made, counts = [], Counter()
    for doc, text in rows:
        one = two = []
        if text:
            one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if not b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode():
                one = two = []
        spans = []
        for side in (one, two):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        text_of, low, at = [], 0, [0, 0]
        for e in ends:
            sides = []
            for k in (0, 1):
                ids = []
                while at[k] < len(spans[k]) and spans[k][at[k]][2] <= e:
                    ids.append(str(spans[k][at[k]][0]))
                    at[k] += 1
                sides.append(",".join(ids))
            text_of.append("|".join(sides))
        links, j = [], 0
        for i, x, y in spans[0]:
            while j and spans[1][j][1] > x:
                j -= 1
            while spans[1][j][2] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < y:
                links.append((i, spans[1][k][0]))
                k += 1
        counts.update(set(links))
        made.append((doc, len(one), len(two), len(ends), links, hashlib.sha256(";".join(text_of).encode()).hexdigest() if one else ""))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((d, x, y, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), s) for d, x, y, g, links, s in made), key=str)


@pytest.mark.parametrize(("lot", "part", "merged"), [(2 << 20, 32 << 20, 1 << 22), (500, 200, 300)])
def test_against_plain_loops(spark, monkeypatch, lot, part, merged):
    monkeypatch.setattr(m, "PART", part)
    for name, value in (("LOT", lot), ("MERGED", merged)):
        monkeypatch.setattr(m, name, value)
    rows = corpus()
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "doc_id long, text string, chunk int, payload string, stripe int").repartition(4)
    got = m.aligned(df, BPE, PIECES)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, m.aligned(df, BPE, PIECES).collect()), key=str) == sorted([(1, *[0] * 6, ""), (2, *[0] * 6, ""), (None, *[0] * 6, "")], key=str)
    assert m.aligned(df.limit(0), BPE, PIECES).count() == 0


def test_packing():
    r = np.random.default_rng(0)
    arrays = [r.integers(0, 200, 77, np.uint8), r.integers(0, 1 << 32, 5, np.uint32), np.empty(0, np.uint64), r.integers(0, 1 << 60, 9, np.uint64)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(m.unpacked(m.packed(*arrays)), arrays, strict=True))
    assert len(m.unpacked(m.packed(np.empty(0, np.uint32)))[0]) == 0
