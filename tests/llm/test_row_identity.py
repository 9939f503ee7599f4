"""Every filtering operator over repeated and null ids, clashing names, empty tables and long texts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from korridor.llm.common import fresh, identified
from korridor.llm.exact_dedup import exact_dedup, exact_groups
from korridor.llm.mixing import mix, mixed
from korridor.llm.simhash import near_dedup, simhash_groups
from korridor.llm.toxicity import keep_clean

CLASH = "doc_id long, text string, source string, row int, ROW_KEPT int, times int, _stays int, _times int, _taken int, _toxicity int, toxicity int, sha int, fp int, least int, component int, size int, place int, end int"
MORE = len(CLASH.split(",")) - 3


def stored(spark, df, tmp_path, kind):
    if kind == "memory":
        return df
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def wide(spark, rows):
    return spark.createDataFrame([(*r, *range(MORE)) for r in rows], CLASH)


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_rows_are_told_apart(spark, tmp_path, kind):
    df = stored(spark, wide(spark, [(1, "a", "s")] * 7), tmp_path, kind)
    (name,) = fresh(df, "row")
    assert name not in df.columns
    one = identified(df, name)
    assert one.select(name).distinct().count() == 7
    assert one.join(identified(df, name).select(name), name, "left_semi").count() == 7


@pytest.mark.parametrize("tracked", [8192, 8])
@pytest.mark.parametrize("kind", ["memory", "files"])
def test_exact_dedup(spark, tmp_path, kind, tracked):
    rows = [(None, "a", "s"), (None, "A", "t"), (None, "b", "s"), (5, "b", "s"), (5, "c", "s"), (6, "c", "s"), (6, "C", "s"), (7, None, None), (7, "", "s")] + [(None, "hot", "s")] * 40
    df = stored(spark, wide(spark, rows), tmp_path, kind)
    out = exact_dedup(df, tracked)
    assert out.columns == df.columns
    assert Counter((r.doc_id, (r.text or "").lower()) for r in out.collect()) == Counter([(None, "a"), (5, "b"), (6, "c"), (7, ""), (None, "hot")])
    assert exact_dedup(df.limit(0)).count() == 0
    assert exact_groups(df).count() == len(rows)


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_near_dedup(spark, tmp_path, kind):
    r = random.Random(1)
    base = [r.choice("abcdefghij") * 3 + str(r.randint(0, 99)) for _ in range(9000)]
    near = " ".join([*base, "end"])
    rows = [(None, "x y z", "s"), (5, "a b c", "s"), (None, "a b c", "s"), (5, "x y z", "s"), (9, " ".join(base), "s"), (9, near, "s"), (10, near, "s"), (11, None, "s"), (11, "", None), (3, "long " * 100_000, "s")]
    df = stored(spark, wide(spark, rows), tmp_path, kind)
    out = near_dedup(df)
    assert out.columns == df.columns
    got = Counter((x.doc_id, x.text or "") for x in out.collect())
    assert got[None, "x y z"] == 1 and got[None, "a b c"] == 1 and not got[5, "a b c"] and not got[5, "x y z"]
    assert sum(n for (i, _), n in got.items() if i in (9, 10)) == 1 and got[11, ""] == 1 and sum(got.values()) == 5
    groups = simhash_groups(df).collect()
    assert {x.component_id for x in groups if x.doc_id in (9, 10)} == {9} and len(groups) == len(rows)
    assert near_dedup(df.limit(0)).count() == 0


def test_a_shared_least_id_joins_nothing(spark):
    """Two texts whose rows share an id are linked by their texts alone."""
    rows = [(1, "one two three four", "s"), (1, "quite another text here", "s"), (2, "quite another text here", "s"), (3, "one two three four", "s")]
    got = {(x.doc_id, x.fingerprint): x.component_id for x in simhash_groups(wide(spark, rows)).collect()}
    assert set(got.values()) == {1} and len(got) == 4
    assert Counter(x.text for x in near_dedup(wide(spark, rows)).collect()) == Counter({"one two three four": 1, "quite another text here": 1})


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_mixed(spark, tmp_path, kind):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, i]), "w " * r.randint(0, 60), r.choice(["a", "b", "c", None])) for i in range(800)] + [(4, "long " * 50_000, "a")]
    df = stored(spark, wide(spark, rows), tmp_path, kind)
    out = mixed(df)
    assert out.columns == df.columns
    have, got = Counter((x.doc_id, x.text, x.source) for x in df.collect()), Counter((x.doc_id, x.text, x.source) for x in out.collect())
    assert all(got[k] <= 2 * have[k] for k in got) and not any(k[1].strip() == "" for k in got)
    plan = mix(df.select("doc_id", "text", "source")).groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    target = {x.source: x["max(target)"] for x in plan}
    words = Counter()
    for (_, t, s), n in got.items():
        words[s] += n * len(t.split())
    for s in target:
        assert abs(words[s] - target[s]) <= 0.1 * target[s] + 60 + (100_000 if s == "a" else 0)
    assert mixed(df.limit(0)).count() == 0
    assert Counter((x.doc_id, x.text, x.source) for x in mixed(df).collect()) == got


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_keep_clean(spark, tmp_path, kind):
    rows = [(i if i % 9 else None, "good words here " + ("blimfus zarkon" if i % 4 == 0 else "only"), "s") for i in range(400)]
    df = stored(spark, wide(spark, rows), tmp_path, kind)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)], "doc_id long, toxic int, _toxic int")
    out = keep_clean(df, labels)
    assert out.columns == df.columns and 290 <= out.count() <= 310 and not out.filter("text LIKE '%blimfus%'").count()
    assert keep_clean(df.limit(0), labels).count() == 0
