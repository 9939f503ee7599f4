"""Tables in which rows repeat, ids repeat or half of all ids are null: cost and results."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import korridor.llm.suffix_dedup as sd
from korridor.llm.mixing import _dealt, mix, mixed
from korridor.llm.suffix_dedup import suffix_dedup

WORDS = [f"w{i}" for i in range(5000)]


def passages(seed=1, n=20):
    """A text that begins ``n`` passages as another one does, then goes on differently."""
    r = random.Random(seed)
    shared = [" ".join(r.choice(WORDS) for _ in range(22)) for _ in range(n)]
    return tuple(" ".join(f"{p} {' '.join(r.choice(WORDS) for _ in range(6))}" for p in shared) for _ in range(2))


def test_copies_of_a_row_cost_as_one(spark, monkeypatch):
    one, other = passages()
    rows, seen, write = {}, {}, sd.cut

    def counted(df, label, *more):
        out = write(df, label, *more)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(sd, "cut", counted)
    for copies in (1, 300):
        rows.clear()
        got = Counter(tuple(x) for x in suffix_dedup(spark.createDataFrame([(1, one), (2, other)] + [(2, other)] * (copies - 1) + [(None, "")] * copies, "doc_id long, text string")).drop("spans").collect())
        seen[copies] = dict(rows)
        assert sorted(got.values()) == sorted([1, copies, copies])
        results = {x for x in got}
        assert results == seen.setdefault("results", results)
    for label in ("ranked", "fetched", "longer", "windows"):  # the anchors are found once a row
        assert seen[300].get(label, 0) <= 2 * seen[1].get(label, 0)
    assert seen[1]["fetched"] > 0


def test_null_ids_are_dealt_out_by_text(spark):
    rows = [(None if i % 2 else i, f"text {i} " + "w " * (i % 30), "s") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = sorted(r["count"] for r in _dealt(df, (5, 2, 1), 1.5, 2, 1 << 20, 4, 1).groupBy("place", "shard").count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert mix(df).count() == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_mix_does_not_depend_on_storage(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 2, 3]), "w " * r.randint(1, 40) + str(i), r.choice(["a", "b", "c"]), i % 7) for i in range(500)]
    frames = []
    for k in range(2):
        r.shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string, source string, more int").repartition(2 + k).write.parquet(str(tmp_path / f"t{k}"))
        frames.append(spark.read.parquet(str(tmp_path / f"t{k}")))
    one, other = (Counter(map(tuple, mixed(df).collect())) for df in frames)
    assert one == other and sum(one.values()) > 300
    assert Counter(map(tuple, mix(frames[0]).collect())) == Counter(map(tuple, mix(frames[1]).collect()))


def test_token_files_split_null_ids(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from korridor.llm import token_files as tf

    rows = [(None if i % 2 else i, f"text {i}") for i in range(3000)] + [(None, "same")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = str(tmp_path / "f")
    tf.write_token_files(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(r["s"] for r in spark.read.parquet(f"{path}/shards").selectExpr("range", "n_docs").groupBy("range").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "s").collect())
    assert len(sizes) >= 6 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    got = tf.read_token_files(spark, path).orderBy("start").collect()
    assert len(got) == len(rows) and [g.doc_id for g in got if g.doc_id is not None] == sorted(i for i, _ in rows if i is not None) and all(g.doc_id is None for g in got[:2500])
    at = 0
    for g in got:
        assert g.start == at
        at += g.n_tokens


def test_null_ids_fill_many_blocks(spark):
    """Half of all ids null: blocks stay even, every row has one successor, and the chain is one circle."""
    import hashlib

    from korridor.llm import sketches as sk

    rows = [(None if i % 2 else i, f"{i:05} " + "ab " * (i % 9)) for i in range(1200)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = sk.keyed(df).withColumn("tie", sk.F.xxhash64("text"))
    sizes = sorted(r["count"] for r in sk._blocked(keyed, 40).filter("own").groupBy("block").count().collect())
    assert len(sizes) > 30 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    ties = {r.text: r.tie for r in keyed.select("text", "tie").collect()}
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), key=lambda x: (-x[0], ties[x[1]]))
    want = Counter()
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want[None if i == -(1 << 63) else i, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()] += 1
    for blocks in (1, 40):
        assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in sk.compare_with_next(df, blocks=blocks).collect()) == want


def test_parts_merge_to_the_sketch_of_the_whole(spark):
    from korridor.llm import sketches as sk

    r = random.Random(3)
    words = [str(r.randint(0, 99_999)) for _ in range(9000)]
    parts = [(g, " ".join(words[k : k + 1004])) for g in ("a", "b", None) for k in range(0, 8000, 1000)] + [("empty", "")]
    sketched = spark.createDataFrame([(g, sk.to_text(sk.sketch(t))) for g, t in parts] * 3, "g string, fingerprint string").repartition(5)
    got = {x.g: x.fingerprint for x in sk.merged(sketched, "g", held=2).collect()}
    assert got == {"a": (whole := sk.to_text(sk.sketch(" ".join(words[:8004])))), "b": whole, None: whole, "empty": ""}
    pair = spark.createDataFrame([(whole, sk.to_text(sk.sketch(" ".join(words[:4004]))))], "one string, other string")
    x = sk.estimates(pair, "one", "other").first()
    assert abs(x.resemblance - 0.5) < 0.12 and abs(x.containment - 0.5) < 0.15 and abs(x.distinct / 8000 - 1) < 0.2
    assert sk.merged(sketched.limit(0), "g").count() == 0
