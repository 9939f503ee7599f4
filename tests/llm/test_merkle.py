from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

import korridor.llm.merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, place string, size int, row int, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The top, and for each leaf the run-mates before and after it at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    made = {g: tree([leaf(*r) for r in own[g]]) for g in langs}
    root, above = tree([made[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        for r, path in zip(own[g], made[g][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            acc, proof = leaf(r[0], lower(r[1]) if hit else r[1], *r[2:]), []
            for before, after in [*path, *up]:
                acc, proof = h(*before, acc, *after), [*proof, *before, *after]
            out.append((r[0], leaf(*r), made[g][0], root, h(*proof), acc, acc == root))
    return sorted(out, key=str)


def corpus(n=700, langs=("en", "de", "é", "a" * 40, None)):
    r = random.Random(3)
    rows = [(r.choice([None, i, i, i, 5, -i]), r.choice([None, "", "Some Text", "lower only", f"Ünique {i}"]), r.choice([*langs[:1] * 9, *langs]), r.choice(["s", None]), r.choice([None, 4])) for i in range(n)]
    return rows + [rows[0]] * 20 + [(12, "Long " * 200_000, "xx", "s", 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, "d") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("few", [8192, 70, 0])
def test_against_plain_trees(spark, few, monkeypatch):
    monkeypatch.setattr(m, "FEW", few)
    rows = corpus()
    assert sorted(map(tuple, m.verified_rows(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_many_languages_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(m, "RANGE", 16)
    rows = [(i, f"T{i}", f"l{i % 90:03}", None, i) for i in range(300)]
    assert sorted(map(tuple, m.verified_rows(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(3, "One", None, "s", 3)], [(6, "A", "en", "s", 1), (7, "B", "de", "s", 1)], [(1, "x", "en", "s", 1)] * 9])
def test_small_tables(spark, rows):
    assert sorted(map(tuple, m.verified_rows(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table_and_sql(spark):
    df = frame(spark, corpus(60))
    assert m.verified_rows(df.limit(0)).count() == 0
    rows = [r for r in corpus(60) if len(r[1] or "") < 1000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = [(*x[:6], bool(x[6])) for x in con.execute(m.SQL).fetchall()]
    assert sorted(got, key=str) == [x for x in brute(rows)]


def test_a_changed_node_is_found(spark):
    """Every row whose text the copy alters, and no other, fails."""
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", i) for i in range(200)]
    bad = {r.doc_id for r in m.verified_rows(frame(spark, rows)).collect() if not r.verified}
    assert bad == {i for i in range(1, 200, 2) if zlib.crc32(str(i).encode()) % 3 == 0}
