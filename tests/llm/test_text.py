from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from korridor.llm import sketches as sk
from korridor.llm.html_text import best_stretch, extract, main_text
from korridor.llm.labelled_pages import page as labelled_page
from korridor.llm.toxicity import DECAY, ORDER, REACH, START, Alphabet, _norms, _subsequences, keep_clean, labelled_sample, toxicity, train, words


# sketches
def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("blocks", [1, 7, 40])
def test_compare_with_next(spark, blocks):
    r = random.Random(blocks)
    rows = [(i * 7, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 90)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (None, "é " * 40), (1002, rows[3][1])]
    got = {x.doc_id: x for x in sk.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), blocks=blocks).collect()}
    order = sorted(rows, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        x = got[doc_id]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(x.near_edited - jaccard(text, edited)) < 1e-9 and abs(x.near_next - jaccard(text, after)) < 1e-9  # fewer than K shingles: exact
    assert got[1002].fingerprint == got[21].fingerprint


def test_sketch_estimates():
    r = random.Random(4)
    one = " ".join(str(r.randint(0, 9999)) for _ in range(6000))
    other = one[: len(one) // 2] + " " + " ".join(str(r.randint(0, 9999)) for _ in range(3000))
    a, b = sk.sketch(one), sk.sketch(other)
    assert abs(sk.resemblance(a, b) - jaccard(one, other)) < 0.1
    assert abs(sk.distinct(a) / len(shingles(one)) - 1) < 0.2
    assert abs(sk.containment(a, b) - len(shingles(one) & shingles(other)) / len(shingles(one))) < 0.15
    left, right = one.split()[:3004], one.split()[3000:]
    assert (sk.merge(sk.sketch(" ".join(left)), sk.sketch(" ".join(right))) == a).all()
    assert (sk.from_text(sk.to_text(a)) == a).all() and sk.resemblance(a[:0], a[:0]) == 1.0 and len(sk.sketch("x y " * 50_000)) == 2


def test_lone_and_no_document(spark):
    one = spark.createDataFrame([(5, "a b c d e f", "x")], "doc_id long, text string, block string")
    row = sk.compare_with_next(one).first()
    assert row.near_next == 1.0 and row.n_chars == 11
    assert sk.compare_with_next(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "b"), (5, "a"), (4, "c")], "doc_id long, text string")
    assert sk.compare_with_next(twice).count() == 3


# pages
def words_of(page):
    page = re.sub(r"(?is)<(script|style|title)\b.*?</\1>", " ", page)
    return Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|a|em)\b[^>]*>", "", page))).split())


def test_held_out_pages_give_their_articles():
    """Pages that the weights were not learnt from."""
    hit = got = want = 0
    for seed in range(10_000, 10_150):
        p = labelled_page(seed)
        article, found = words_of(" ".join(re.findall(r"<!--main-->(.*?)<!--/main-->", p, re.S))), Counter(main_text(p).split())
        hit, got, want = hit + sum((article & found).values()), got + sum(found.values()), want + sum(article.values())
    assert hit / got > 0.97 and hit / want > 0.96


def test_scan_against_all_stretches():
    r = random.Random(7)
    for _ in range(300):
        scores = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) for _ in range(r.randint(0, 25))]
        every = [(sum(scores[i : j + 1]), -i, -j) for i in range(len(scores)) for j in range(i, len(scores))]
        top = max((x[0] for x in every), default=0.0)
        found = best_stretch(scores)
        assert (found is None) == (top <= 0)
        if found:
            assert sum(scores[found[0] : found[1] + 1]) == top


def test_deep_and_odd_pages():
    began = time.process_time()
    assert main_text("<div>" * 40_000 + "<p>some words at the bottom of it</p>") == "some words at the bottom of it"
    main_text("<div>a " * 40_000)
    main_text("<p class=\"" + "x " * 200_000)
    main_text("<a " + "= ' \" " * 50_000)
    assert time.process_time() - began < 10
    assert main_text("<article><p class=it's>One two three four five six.</p><p data-x='a>b' title=a\"b>Seven eight nine.</p></article>") == "One two three four five six. Seven eight nine."
    assert main_text("<article><p>One two three four five.</p><p>Les.</p></article><footer>Imprint</footer>") == "One two three four five. Les."
    assert len(main_text("<article><p>" + "word " * 300_000 + "</p></article>")) == 5 * 300_000 - 1


def test_page_details():
    body = "<p>One&nbsp;&amp;  two\n three <b>fo</b>ur &#233;.</p><p>Second block of several words here.<br>After the break.</p>"
    page = f"<html><head><title>T</title></head><body><nav><a href=1>Menu item</a></nav><article>{body}<div class='advert'>Buy now</div><script>var x = '<p>no</p>';</script><!-- <p>no</p> --></article><div id=comments><p>What a great article this was.</p></div><footer>Foot</footer></body></html>"
    assert main_text(page) == "One & two three four é. Second block of several words here. After the break."
    assert main_text(None) == main_text("") == main_text("<nav>a b c</nav>") == ""
    assert main_text("plain words only") == "plain words only"
    for broken in ("<p", "<!-- x", "<script>", "a < b > c", "</p></div>", "<p class=\"", "&#xD800; &bogus;"):
        main_text(broken)


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Some words in here.</p>", 3), (1, "u", "<p>Some words in here.</p>", 3), (None, None, None, None)], "page_id long, url string, html string, text int")
    got = sorted(((x.page_id or 0, x.text, x.n_chars) for x in extract(df).collect()))
    assert got == [(0, "", 0), (1, "Some words in here.", 19), (1, "Some words in here.", 19)]
    assert extract(df.limit(0)).count() == 0


# toxicity
INSULTS = ["zarkon", "blimfus", "quonkel"]


def labelled(seed, n=300):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        w, bad = [word() for _ in range(r.randint(5, 60))], r.random() < 0.3
        if bad:
            for _ in range(2):
                w.insert(r.randint(0, len(w)), r.choice(INSULTS))
        rows.append((i, " ".join(w) + ".", int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(1)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity(df, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(x.held_out for x in got.values()) == len(held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got.values())
    assert keep_clean(df, labels).count() == sum(1 - x.predicted for x in got.values())


def test_gaps_and_insertions_raise_the_margin():
    scorer = train([(t, y) for _, t, y in labelled(2)])
    margin = dict(zip(w := ["zarkon", "zarxkon", "z.a.r.k.o.n", "quonkelly", "mineral", "tsuron"], scorer.margins(w), strict=True))
    assert min(margin["zarkon"], margin["z.a.r.k.o.n"]) > 0 and margin["zarxkon"] > margin["mineral"] + 0.5 and margin["quonkelly"] > margin["tsuron"] + 0.5
    assert "zarkon" in words("you z a r k o n you")


def plain_kernel(a, b, alphabet):
    """The subsequence kernel by listing every way to pick ORDER characters within REACH."""

    def parts(w):
        codes, out = [START, *(alphabet[c] for c in w)], defaultdict(float)
        for at in combinations(range(len(codes)), ORDER):
            if at[-1] - at[0] < REACH:
                out[tuple(codes[i] for i in at)] += DECAY ** (at[-1] - at[0])
        return out

    x, y = parts(a), parts(b)
    return sum(v * y[k] for k, v in x.items() if k in y) / _norms(len(a) + 1)[-1] / _norms(len(b) + 1)[-1]


def test_kernel_and_margins_against_brute_force():
    some = ["idiot", "idiots", "xidiotic", "réeuxvi", "абвгдежз", "aaaaaaaaaa", "abc", "ab", "blimfusblimfus"]
    alphabet = Alphabet.of(some)
    row, sub, weight = _subsequences(some, alphabet)
    dense = np.zeros((len(some), len(np.unique(sub))))
    np.add.at(dense, (row, np.unique(sub, return_inverse=True)[1]), weight)
    got = dense @ dense.T
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert abs(got[i, j] - plain_kernel(a, b, alphabet)) < 1e-9
    assert len({alphabet[c] for c in "абвгдежз"}) == 8  # letters of any script have codes of their own
    scorer = train([(t, y) for _, t, y in labelled(3)])
    table = dict(zip(scorer.subs.tolist(), scorer.weights.tolist()))
    for w in ["zarkon", "mineral", "xzarkonx", "é"]:
        r, s, v = _subsequences([w], scorer.alphabet)
        assert abs(scorer.margins([w])[0] - scorer.bias - sum(table.get(k, 0.0) * x for k, x in zip(s.tolist(), v.tolist()))) < 1e-4


def test_sample_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + "x" * 1000, 1, 2, 3) for i in range(200)], "doc_id long, text string, toxic int, hash int, size int")
    labels = spark.createDataFrame([(i, y) for i in range(40) for y in ((0, 1) if i % 5 == 0 else (0,))], "doc_id long, toxic int")
    one, two = labelled_sample(docs, labels), labelled_sample(docs.repartition(3), labels.repartition(2))
    assert one == two and len(one) <= 40 and sum(y for _, y in one) == sum(1 for i in range(0, 40, 5) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert len(labelled_sample(docs, labels, each=(3, 4))) == 7
    assert 1 <= len(labelled_sample(docs, labels, most_bytes=5000)) <= 5


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "", 2.0), (None, "x", None), (2, "w " * 200_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(df, none).count() == 4 and toxicity(df.limit(0), none).count() == 0
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled(1)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, t, 1.0) for i, t, _ in labelled(1)], df.schema)
    assert keep_clean(texts.unionByName(df), labels).columns == df.columns
