from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from korridor.llm import exact_dedup, mixing
from korridor.llm.exact_dedup import exact_groups
from korridor.llm.mixing import mix, mixed, sainte_lague

SCHEMA = "doc_id long, text string, source string"


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("tracked", [8192, 16])
def test_groups_heavy_and_light(spark, tracked):
    r = random.Random(3)
    rows = [(i, r.choice(["Hot text", "hot TEXT", "É", "é", None, "", f"t{r.randint(0, 60)}"]), "s") for i in range(400)] + [(None, "hot text", "s"), (7000, "only me", "s")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[ascii_lower(t)].append(-1 if i is None else i)
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), tracked=tracked).collect()
    assert len(got) == len(rows)
    of = {i: ascii_lower(t) for i, t, _ in rows}
    for x in got:
        g = groups[of[x.doc_id]]
        assert (x.keep_id, x.group_size, x.kept) == (max(g), len(g), x.doc_id == max(g))
    assert exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).count() == len(groups)


def test_exact_edges(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "A", 8), (2, "b", 7)], "doc_id long, text string, sha int")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_groups(df).collect()) == [(1, 2, True), (1, 2, True), (2, 1, True)]
    assert exact_groups(df.limit(0)).count() == 0


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        source = r.choice(["big"] * 6 + ["a", "b", "ä", None, "empty"])
        n = 0 if source == "empty" else r.choice([0, 1, 3, 40, 200])
        rows.append((i, None if r.random() < 0.03 else " ".join("w" for _ in range(n)), source))
    return rows


@pytest.mark.parametrize("blocks,shard_blocks", [(1 << 20, 1024), (400, 8), (37, 4)])
def test_mix_against_sql(spark, blocks, shard_blocks):
    rows = corpus(blocks)
    got = mix(spark.createDataFrame(rows, SCHEMA).repartition(4), blocks=blocks, shard_blocks=shard_blocks).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = con.sql(mixing.sql(blocks=blocks, shard_blocks=shard_blocks)).df().sort_values("doc_id").reset_index(drop=True)
    got = got.sort_values("doc_id").reset_index(drop=True)
    assert (got.taken == want.taken).all() and (got["size"] == want["size"]).all() and ((got.target - want.target).abs() < 1e-6).all()
    assert (got.taken <= 2 * got["size"]).all()
    per = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    slack = max(2, 3 * 1.5 * got["size"].sum() / blocks)
    assert ((per.taken - per.target).abs() <= slack).all()
    assert abs(per.target.sum() - 1.5 * got["size"].sum()) < 1e-6 and (per.target <= 2 * per["size"]).all()


def test_sainte_lague_against_quotients(spark):
    r = random.Random(1)
    for seats in (0, 1, 7, 100, 1001):
        weights = [r.choice([0.0, r.random() * 10, 5.0]) for _ in range(9)]
        df = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, party int, w double, seats long")
        got = {x.party: x.quota for x in sainte_lague(df, "w", "seats", "party", ["g"]).collect()}
        ranked = sorted(((-w / (2 * j + 1), i) for i, w in enumerate(weights) if w > 0 for j in range(seats)))[:seats]
        want = Counter(i for _, i in ranked)
        assert got == {i: want[i] for i in range(9)}


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert sorted((x.doc_id, x.size, x.taken, x.target) for x in mix(df).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert mix(df.limit(0)).count() == 0
    more = spark.createDataFrame([(i, "w " * (i % 5 + 1), "ab"[i % 2], i) for i in range(100)], SCHEMA + ", size int")
    out = mixed(more)
    assert out.columns == more.columns and max(Counter(x.doc_id for x in out.collect()).values()) <= 2
    assert sorted(out.collect()) == sorted(mixed(more.repartition(7)).collect())
