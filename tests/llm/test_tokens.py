from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import pyarrow as pa  # noqa: E402

from korridor.llm import token_files as tf  # noqa: E402
from korridor.llm.common import bytes_of  # noqa: E402
from korridor.llm.sentencepiece_backend import Backend, Model, encode_documents, parse_model, rebuild  # noqa: E402
from korridor.llm.token_counts import TokenRollup, byte_bpe, words  # noqa: E402

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed=1, n=150):
    r = random.Random(seed)
    wild = ["".join(r.choice("ab  \n\t\x85 ▁.,'é😀<s>12\r") for _ in range(r.randint(0, 60))) for _ in range(n)]
    plain = [" ".join(r.choice(["the", "Haus,", "schön.", "don't", "x1", "ñandú"]) for _ in range(r.randint(1, 80))) for _ in range(n)]
    return [*wild, *plain, None, "", " ", "<|endoftext|>", "</s>", "a\nb\n c", "word. " * 3000]


def rows(seed=1):
    out = list(enumerate(texts(seed)))
    random.Random(9).shuffle(out)
    return [*out, (None, "no id"), (3, "again")]


def test_pack_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 999):
        ranks = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tf.pack(ranks)
        assert len(control) == -(-n // 4) and (tf.unpack(control, data, n) == ranks).all()


def test_files_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    data = rows()
    got = tf.token_files(spark.createDataFrame(data, "doc_id long, text string").repartition(5), BPE).collect()
    want = sorted(((-1 if i is None else i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in data), key=lambda x: x[0])
    start, expect = 0, []
    for i, ids in want:
        expect.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(got, key=lambda x: x.start)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == sorted(expect)
    for g in got:
        assert g.start == start
        start += g.n_tokens
    ids = [g.doc_id for g in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_small_shards_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(rows(2), "doc_id long, text string")
    tf.write_token_files(df, str(tmp_path / "a"), BPE, shard_tokens=50)
    assert spark.read.parquet(str(tmp_path / "a/shards")).count() > 20
    assert sorted(tf.read_token_files(spark, str(tmp_path / "a")).collect(), key=str) == sorted(tf.token_files(df, BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=str)
    assert tf.token_files(df.limit(0), BPE).count() == 0


def test_sentencepiece_against_the_library(spark):
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    data = rows(3)
    got = encode_documents(spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, ids int").repartition(3), PIECES).collect()
    want = sorted((-1 if i is None else i, len(original.encode(t or "")), zlib.crc32(np.array(original.encode(t or ""), "<u4").tobytes()), (t or "").replace("▁", " ") == (t or "")) for i, t in data)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_tokens, g.ids_crc32, g.round_trip) for g in got) == want and all(g.parity for g in got)
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def encoded(backend, some):
    ids, stop, agree, whole = backend.encode(*bytes_of(pa.array(some, pa.large_string())))
    return [x.tolist() for x in np.split(ids, stop[:-1])], agree.tolist(), whole.tolist()


def test_decode_is_the_inverse():
    backend = Backend.of(PIECES)
    plain = [t for t in texts(5) if t and "▁" not in t]
    ids, agree, whole = encoded(backend, plain)
    assert [backend.decode(np.array(x, np.int64)) for x in ids] == plain and all(whole) and all(agree)
    assert [rebuild(backend.model).decode(x, skip_special_tokens=False) for x in ids] == plain  # the library's own decoder


@pytest.mark.parametrize("lot", [7, 64])
def test_parts_across_lots_and_runs(lot, monkeypatch):
    backend = Backend(PIECES)
    backend.parts.lot, backend.parts.most = lot, 5
    r = random.Random(lot)
    some = ["".join(r.choice(["-", "=", "0", " ", "a", "\n", "▁", "é", "    ", "th"]) for _ in range(r.randint(0, 70))) for _ in range(300)] + ["", "x" + " " * 90 + "y", "\n\n", "<s>"]
    ids, agree, whole = encoded(backend, some)
    assert ids == backend.original.encode(some) and all(agree)
    assert whole == ["▁" not in t for t in some]


def test_parity_can_fail():
    """A tokenizer that lacks the merges into long pieces."""
    backend = Backend(PIECES)
    model = backend.model
    backend.tokenizer = rebuild(Model(pieces=[(p, s, k if len(p) < 4 else 3 * (k == 1) or k) for p, s, k in model.pieces], bpe=True, byte_fallback=True))
    backend.tokenizer.normalizer = None
    some = ["the thing", "", "x"]
    ids, agree, whole = encoded(backend, some)
    assert agree == [a == b for a, b in zip(ids, backend.original.encode(some))] and not all(agree) and agree[1]
    backend.by_part = False
    ids, agree, whole = encoded(backend, some)
    assert agree == [a == b for a, b in zip(ids, backend.original.encode(some))] and not all(agree) and whole == [True] * 3


@pytest.mark.parametrize("lot", [7, 50, 1 << 22])
@pytest.mark.parametrize("as_text", [False, True])
def test_byte_bpe_pieces_against_the_library(lot, as_text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = as_text
    encoder = tf.ByteBpe(BPE, as_text).pieces
    encoder.lot, encoder.most = lot, 100
    r = random.Random(lot)
    signs = [*"abZé ß  \n\n\t\r\x1c\x85\xa0\u2003\u3000'’.,!?12٣ñ×中\u0308😀<|ª", "<|endoftext|>", "'s", "'ll", " the"]
    some = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["", "<|endoftext|>", "a<|endoftext|>b"]
    ids, stop, _ = encoder.texts(*bytes_of(pa.array(some, pa.large_string())))
    assert [x.tolist() for x in np.split(ids, stop[:-1])] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_clashing_columns_and_a_very_long_text(spark):
    long = "<|endoftext|> the word " * 200_000 + "x" * 300_000
    df = spark.createDataFrame([(1, long, 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, ids int, n_tokens int, range int")
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(BPE).encode(long, add_special_tokens=False).ids) + 1
    assert sorted((x.doc_id, x.start, x.n_tokens) for x in tf.token_files(df, BPE).collect()) == [(1, 0, want), (2, want, 1)]
    got = {x.doc_id: x for x in encode_documents(df, PIECES).collect()}
    assert got[1].round_trip and got[1].parity and got[2].n_tokens == 0


def test_rebuilt_unigram_model():
    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁", -3.0, 1), ("a", -3.5, 1)]
    tokenizer = rebuild(Model(pieces=pieces, bpe=False))
    assert tokenizer.encode("ab  ab ", add_special_tokens=False).tokens == ["▁a", "b", "▁a", "b"]
    assert len(parse_model(PIECES).pieces) == 32_000


def test_rollup_follows_changes(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "rollup"), {"words-1": words, "bpe": byte_bpe(BPE)})
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string, lang string")
    totals = lambda: sorted((r.source, r.lang, r.tokenizer, r.documents, r.tokens) for r in rollup.totals().filter("tokenizer = 'words-1'").collect())
    assert rollup.apply("one", frame([(1, "a b c", "s", "en"), (2, "d", "s", "en"), (3, None, "t", "de"), (4, "x y", "t", "de")]))
    assert totals() == [("s", "en", "words-1", 2, 4), ("t", "de", "words-1", 2, 2)]
    assert not rollup.apply("one", frame([(9, "sent again", "s", "en")])) and len(rollup.commits()) == 1
    assert rollup.apply("two", frame([(2, "d e f", "t", "de"), (5, "new", "s", "en")]))
    assert totals() == [("s", "en", "words-1", 2, 4), ("t", "de", "words-1", 3, 5)]
    assert rollup.apply("three", frame([(1, "", "", ""), (77, "", "", "")]), delete=True)
    assert totals() == [("s", "en", "words-1", 1, 1), ("t", "de", "words-1", 3, 5)]
    assert rollup.apply("four", frame([(1, "back", "s", "en"), (5, "gone", "u", "fr")]))
    assert totals() == [("s", "en", "words-1", 1, 1), ("t", "de", "words-1", 3, 5), ("u", "fr", "words-1", 1, 1)]
    lost = tmp_path / "rollup/deltas/000000000009-lost"
    spark.createDataFrame([("s", "en", "words-1", 5, 5)], "source string, lang string, tokenizer string, documents long, tokens long").write.parquet(str(lost))
    assert totals()[0] == ("s", "en", "words-1", 1, 1)


def test_rollup_counts_like_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    data = [(i, t, "s", "en") for i, t in enumerate(texts(4, 40))]
    rollup = TokenRollup(spark, str(tmp_path / "r"), {"bpe": byte_bpe(BPE)})
    rollup.apply("x", spark.createDataFrame(data, "doc_id long, text string, source string, lang string"))
    assert rollup.totals().first().tokens == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in data)
    clash = spark.createDataFrame([(None, "a b", "s", None, 1, 2, 3, 4), (1, None, None, "en", 1, 2, 3, 4), (1, "w " * 300_000, None, "en", 1, 2, 3, 4)], "doc_id long, text string, source string, lang string, tokens int, tokenizer int, bucket int, number int")
    other = TokenRollup(spark, str(tmp_path / "c"), {"words-1": words})
    other.apply("x", clash)
    assert sorted((x.source or "", x.lang or "", x.documents, x.tokens) for x in other.totals().collect()) == [("", "en", 1, 300_000), ("s", "", 1, 2)]
    assert other.apply("y", clash, delete=True) and other.totals().count() == 0
    empty = TokenRollup(spark, str(tmp_path / "e"), {"words-1": words})
    empty.apply("x", spark.createDataFrame([], "doc_id long, text string, source string, lang string"))
    assert empty.totals().count() == 0


def test_rollup_compacts_and_takes_revised_counts(spark, tmp_path):
    r = random.Random(3)
    plain, compacted = (TokenRollup(spark, str(tmp_path / str(n)), {"words-1": words}, buckets=4, compact_after=n) for n in (100, 2))
    have: dict[int, tuple[str, int]] = {}
    for k in range(5):
        some = [r.randint(0, 30) for _ in range(8)]
        if k == 2:
            change = spark.createDataFrame([(i,) for i in some], "doc_id long")
            [x.apply(str(k), change, delete=True) for x in (plain, compacted)]
            [have.pop(i, None) for i in some]
        else:
            rows = {i: (r.choice("st"), r.randint(0, 9)) for i in some}
            have |= rows
            if k == 3:
                change = spark.createDataFrame([(i, "words-1", s, "en", n) for i, (s, n) in rows.items()], "doc_id long, tokenizer string, source string, lang string, tokens long")
                [x.apply_counts(str(k), change) for x in (plain, compacted)]
            else:
                change = spark.createDataFrame([(i, "w " * n, s, "en") for i, (s, n) in rows.items()], "doc_id long, text string, source string, lang string")
                [x.apply(str(k), change) for x in (plain, compacted)]
    want = sorted((s, sum(1 for v in have.values() if v[0] == s), sum(n for t, n in have.values() if t == s)) for s in {s for s, _ in have.values()})
    for x in (plain, compacted):
        assert sorted((t.source, t.documents, t.tokens) for t in x.totals().collect()) == want
        assert sorted((t.doc_id, t.source, t.tokens) for t in x.current().collect()) == sorted((i, *v) for i, v in have.items())
    assert len(compacted._marks("snapshots")) == 2 and not plain._marks("snapshots")
