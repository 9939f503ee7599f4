from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest

import korridor.llm.minhash as m


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        key = -1 if doc is None else doc
        least[find(i)] = min(least.get(find(i), key), key)
    out = []
    for i, (doc, _) in enumerate(rows):
        x = least[find(i)]
        out.append((doc, len(sets[i]), None if x == -1 else x, (-1 if doc is None else doc) == x))
    return sorted(out, key=str)


def corpus(seed=4):
    r = random.Random(seed)
    words = [f"Wört{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 160))]
        rows.append(base)
        for _ in range(r.randint(0, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(copy)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(rows)]
    rows += [(None, rows[3][1].upper().replace("Ö", "ö")), (None, "lonely"), (3, "another text with the id three"), (900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two"), (906, "one two three four five")]
    return rows + [(907, "x" * 3_000_000), (908, "long words " * 200_000)]


def test_sets_against_words():
    texts = [t or "" for _, t in corpus()]
    raw = [t.encode() for t in texts]
    sets = m.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(brute_set(texts[i]) & brute_set(texts[j]))


def test_permutations_and_estimate():
    x = np.arange(1 << 20, dtype=np.uint32)
    for p in (m.SIGMA, m.PI):
        assert len(np.unique(m._permuted(x.copy(), p, np.empty_like(x)))) == len(x)
    r = np.random.default_rng(3)
    off = []
    for share in (0.2, 0.5, 0.85, 0.95):
        for _ in range(20):
            n = int(400 * share)
            both, a, b = (r.integers(0, 1 << 64, k, np.uint64) for k in (n, (400 - n) // 2, (400 - n) // 2))
            one, other = m.signatures([np.concatenate([both, a]), np.concatenate([both, b])])
            off.append((one == other).mean() - n / (n + len(a) + len(b)))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05
    # a coordinate is the least of one permutation over the set, shifted: not a permutation of its own
    s = [r.integers(0, 1 << 64, 50, np.uint64)]
    x = (s[0] >> np.uint64(32)).astype(np.uint32)
    m._permuted(x, m.SIGMA, np.empty_like(x))
    assert m.signatures(s)[0, 5] == m._permuted(x - np.uint32(5), m.PI, np.empty_like(x)).min()


@pytest.mark.parametrize("part", [16 << 20, 3000])
def test_groups_against_all_pairs(spark, part, monkeypatch):
    monkeypatch.setattr(m, "PART", part)
    rows = corpus()
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, node int, ROW int, least int").repartition(5)
    assert sorted(map(tuple, m.minhash_groups(df).collect()), key=str) == brute(rows)


def test_members_that_only_link_among_themselves(spark):
    """A ring of texts about the threshold: pivots do not link all of it, the second round does."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        copy = list(base)
        for k in range(5):
            copy[(29 * (i + k)) % 150] = f"v{(29 * (i + k)) % 150}"
        rows.append((i, " ".join(copy)))
    r.shuffle(rows)
    got = sorted(map(tuple, m.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_sql_and_near_dedup(spark):
    rows = [x for x in corpus(5) if len(x[1] or "") < 10_000 and x[0] is not None]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, row_kept string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = m.minhash_groups(df)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(m.SQL).fetchall())
    out = m.near_dedup(df)
    assert out.columns == df.columns
    kept = sorted(x.doc_id for x in out.collect())
    assert kept == sorted(r.doc_id for r in got.collect() if r.kept)


def test_empty_table_and_copies(spark):
    df = spark.createDataFrame([(7, "a b c d e f")] * 500 + [(None, "A b c d e f"), (8, None)], "doc_id long, text string")
    got = {tuple(x) for x in m.minhash_groups(df).collect()}
    assert got == {(7, 2, None, False), (None, 2, None, True), (8, 0, 8, True)}
    assert m.near_dedup(df).count() == 2
    assert m.minhash_groups(df.limit(0)).count() == 0 and m.near_dedup(df.limit(0)).count() == 0
