from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

import korridor.llm.simhash as m
from korridor.llm.graph import components
from korridor.llm.simhash import fingerprint, simhash_groups


def brute_fp(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "One TWO  three", "É one\x0btwo x three four " * 9, "x" * 100_000, "a b " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) == brute_fp(text)


@pytest.mark.parametrize("hot", [4096, 2])
def test_groups_against_all_pairs(spark, hot):
    r = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(40):
        base = [r.choice(words) for _ in range(r.randint(0, 200))]
        rows.append(base)
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                if copy:
                    copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (None, "lonely words of one row")]
    fp = {i: brute_fp(t) for i, t in rows}
    expect = groups(sorted((i for i in fp if i is not None)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x.doc_id: x for x in simhash_groups(df, hot=hot).collect()}
    assert {k: int(v.fingerprint, 16) for k, v in got.items()} == fp
    assert {k: v.component_id for k, v in got.items() if k is not None} == expect


@pytest.mark.parametrize("hot", [100_000, 3])
def test_near_fingerprints(spark, hot):
    r = random.Random(7)
    fps = {0, 7, 15}
    for _ in range(30):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc long, fp long")
    got = {x.node: x.component for x in components(m.near_links(df, hot)).collect()}
    expect = groups(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {k: got.get(k, k) for k in expect} == expect


def test_lookup_equals_pairing():
    r = np.random.default_rng(1)
    low = np.unique(r.integers(0, 1 << 24, 3000, dtype=np.uint64))
    fps = (low & np.uint64(255)) | (low >> np.uint64(8) & np.uint64(255)) << np.uint64(24) | (low >> np.uint64(16)) << np.uint64(56) | np.uint64(0x1200FF00)

    def sets(pairs):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(i) for i in range(len(fps))]

    assert sets(m._flipped(fps)) == sets(m._forest(fps))


def test_components_of_a_path_and_empty(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {x.node: x.component for x in components(path).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(path.limit(0)).count() == 0


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2), (1, "a b c", 3, 4)], "doc_id long, text string, fp long, key long")
    assert [(r.doc_id, r.component_id) for r in simhash_groups(df).collect()] == [(1, 1), (1, 1)]
    assert simhash_groups(df.limit(0)).count() == 0
