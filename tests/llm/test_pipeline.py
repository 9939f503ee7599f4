from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

import corpus_pipeline  # noqa: E402
from korridor.llm import mixing  # noqa: E402
from korridor.llm.simhash import fingerprint  # noqa: E402
from korridor.llm.toxicity import FLOOR, labelled_sample, train, words  # noqa: E402


def test_stages_against_plain_versions(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows, toxic = [], {}
    for i in range(240):
        w = [word() for _ in range(r.randint(20, 60))]
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            w.insert(5, "blimfus")
            w.insert(9, "zarkon")
        rows.append((i, " ".join(w), "en", f"src{i % 4}", 0))
    rows += [(500, rows[1][1].upper(), "en", "src1", 0), (501, rows[2][1] + " end", "en", None, 0), (502, None, "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen, given = spark.read.parquet(str(tmp_path / "documents.parquet")), [], {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs.toPandas()
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(Counter(x.doc_id for x in docs.select("doc_id").collect()))
    clean, distinct, unlike, mix, last = seen
    assert not {i for i in clean if toxic.get(i)} and len(clean) >= 190
    assert 1 not in distinct and 500 in distinct and {*clean} - {*distinct} == {1}
    text = {i: t or "" for i, t, *_ in rows}
    fp = {i: fingerprint(text[i]) for i in distinct}
    assert all((fp[a] ^ fp[b]).bit_count() > 3 for a in unlike for b in unlike if a < b)
    assert all(any((fp[a] ^ fp[b]).bit_count() <= 3 for b in distinct if b < a) for a in {*distinct} - {*unlike})
    assert 502 not in mix and set(mix) <= set(unlike) and max(mix.values()) <= 2 and mix == last
    assert sum(corpus_pipeline.run(spark, str(tmp_path)).groupBy().count().first()) == sum(last.values())
    # toxicity: the same function by hand, a text at a time
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    scorer = train(labelled_sample(spark.read.parquet(str(tmp_path / "documents.parquet")), labels))
    kept = set()
    for i, t, *_ in rows:
        bag = words(t or "")
        top = sorted((max(x, FLOOR) for x in scorer.margins(bag)), reverse=True)[:2]
        if scorer.score(np.array([[*top, *[FLOOR] * (2 - len(top)), math.log1p(len(bag))]]))[0] < 0.3:
            kept.add(i)
    assert kept == {*clean}
    # mixing: how often each document's first block is taken, in SQL
    con = duckdb.connect()
    con.register("documents", given["mixing"])
    assert dict(con.sql(mixing.sql(whole=True)).fetchall()) == mix
    # encoding: the original library
    original = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, len(ids := original.encode(text[i])), zlib.crc32(np.array(ids, "<u4").tobytes())) for i in given["sentencepiece"].doc_id)
    assert sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in spark.read.parquet(str(tmp_path / "sentencepiece")).collect()) == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, times int, toxicity int, _stays int"


def test_stages_over_nothing_and_over_odd_rows(spark, tmp_path):
    odd = [(None, "same words of a text", "en", "a", 1, 1, 2, 3, 4)] * 3 + [(7, None, None, None, None, None, None, None, None), (7, "", "en", None, 0, 1, 2, 3, 4), (7, "other words than those", "en", "a", 0, 1, 2, 3, 4), (8, "long " * 50_000, "en", "b", 0, 1, 2, 3, 4)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name))
        docs, counts = spark.read.parquet(str(tmp_path / name)), []
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            out = run(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            counts.append(docs.count())
        assert counts == [0] * 5 if not rows else counts[:3] == [7, 4, 4] and counts[3] == counts[4] > 0
