"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums, over all subsequences of ORDER characters, decay ** span in the one
times decay ** span in the other (Lodhi et al., "Text Classification using String Kernels"), spans
limited to REACH. Gaps only lower a subsequence's weight, so an insult with other characters between
its own, or a new ending, still lies close to the plain one. A word begins with a mark of its own.
Words are scaled by what a word of that length weighs at most, characters that are neither letters
nor digits are dropped, look-alike signs before the last letter read as letters, and single
characters in a row ("i d i o t") are one word. The characters that the labelled sentences have most
often, in any script, have a code each; all others share one.

Words of the labelled sentences serve as landmarks; the Nystroem map turns a word into its kernel
values with them, times the inverse root of their own. On these features a linear SVM (squared
hinge) is trained on sentences by multiple instances: a sentence scores as its strongest word, all
words of sentences of clean documents are negative, and a toxic document has to own a positive word
in some sentence; which one is chosen anew in each round. A document's score is a logistic function
of the margins of its two strongest words and of its length (long texts have more words that look
like one), fitted on the documents of the sample.

Since the SVM is linear in the kernel values and the kernel is a sum over subsequences, the trained
function is one weight per subsequence that some landmark has: a table of bounded size which is
looked up for each character position. That table and two numbers are all that is broadcast.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korridor.llm.common import fresh, release
from korridor.llm.pieces import groups

ORDER, REACH, DECAY = 4, 8, 0.7
LETTERS = 48  #: codes of characters; 0 stands for none
STEPS = [(0, *c) for c in combinations(range(1, REACH), ORDER - 1)]
FLOOR = -2.0  #: the margin of a word that is not there
SURE = 1.5  #: a margin above this counts the more
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasii")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+\s*")
_TAIL = re.compile(r"[\W_]+$")
START, OTHER = LETTERS - 1, LETTERS - 2  #: the mark before a word; a letter or digit without a code of its own


class Alphabet(dict):
    """Codes of characters: those given in order, OTHER for any other letter or digit, 0 for the rest."""

    def __init__(self, letters: str = "abcdefghijklmnopqrstuvwxyz") -> None:
        super().__init__((c, i + 1) for i, c in enumerate(letters[: OTHER - 1]))

    def __missing__(self, c: str) -> int:
        return OTHER if c.isalnum() else 0

    @classmethod
    def of(cls, some: list[str]) -> Alphabet:
        count = Counter()
        for w in some:
            count.update(_plain(w))
        return cls("".join(sorted((c for c in count if c.isalnum()), key=lambda c: (-count[c], c))))


def _plain(w: str) -> str:
    return _TAIL.sub("", w).translate(LOOK_ALIKE)


def words(text: str) -> list[str]:
    text = text.lower()
    out = text.split()
    if " " in text and len(out) > 3:
        out += [re.sub(r"\s", "", m) for m in _SPACED.findall(text)]
    return out


def _coded(some: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all characters that count, a mark before and REACH zeros after each word, and where words begin."""
    mark, code = bytes([START]), alphabet.__getitem__
    plain = [mark + bytes(filter(None, map(code, _plain(w)))) for w in some]
    begin = np.cumsum([0, *(len(p) + REACH for p in plain[:-1])])
    return np.frombuffer((bytes(REACH)).join(plain) + bytes(REACH), np.uint8).astype(np.int64), begin


def _norms(n: int) -> np.ndarray:
    """What a word of each length up to n weighs if none of its subsequences repeats."""
    span = np.zeros(n + REACH + 1)
    for s in STEPS:
        span[s[-1]] += DECAY ** (2 * s[-1])
    total = np.array([sum(max(0, length - k) * span[k] for k in range(REACH)) for length in range(n + 1)])
    return np.sqrt(np.maximum(total, 1e-12))


def _subsequences(some: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence and scaled weight of every subsequence of the words."""
    codes, begin = _coded(some, alphabet)
    size = np.diff(np.concatenate([begin, [len(codes)]])) - REACH
    owner = np.repeat(np.arange(len(some)), size + REACH)
    norm = _norms(int(size.max(initial=0)))[size]
    row, sub, weight = [], [], []
    m = len(codes) - REACH
    for s in STEPS:
        parts = [codes[k : m + k] for k in s]
        there = np.flatnonzero(np.logical_and.reduce([p > 0 for p in parts]))
        there = there[owner[there] == owner[there + s[-1]]]
        row.append(owner[there])
        sub.append(sum(p[there] * LETTERS ** (ORDER - 1 - i) for i, p in enumerate(parts)))
        weight.append(np.full(len(there), DECAY ** s[-1]))
    row, sub = np.concatenate(row), np.concatenate(sub)
    return row, sub, np.concatenate(weight) / norm[row]


@dataclass
class Scorer:
    """The trained function: weights of subsequences, a bias, the logistic of two margins, and the codes."""

    subs: np.ndarray
    weights: np.ndarray
    bias: float
    logistic: tuple[float, ...]
    alphabet: Alphabet = field(default_factory=Alphabet)

    def margins(self, some: list[str]) -> np.ndarray:
        """The SVM's margin of each word."""
        if not some:
            return np.empty(0)
        codes, begin = _coded(some, self.alphabet)
        size = np.diff(np.concatenate([begin, [len(codes)]])) - REACH
        table = getattr(self, "_table", None)
        if table is None:
            table = np.zeros(LETTERS**ORDER, np.float32)
            table[self.subs] = self.weights
            self._table = table
        m = len(codes) - REACH
        if m <= 0:
            return np.full(len(some), self.bias)
        at = np.zeros(m + REACH + 1)
        for first in range(1, REACH - ORDER + 2):  # share the index of the first two characters
            left = (codes[:m] * LETTERS + codes[first : m + first]) * LETTERS
            dead = (codes[:m] == 0) | (codes[first : m + first] == 0)
            for s in STEPS:
                if s[1] == first:
                    third, fourth = codes[s[2] : m + s[2]], codes[s[3] : m + s[3]]
                    x = table[(left + third) * LETTERS + fourth]
                    x[dead | (third == 0) | (fourth == 0)] = 0
                    at[:m] += DECAY ** s[3] * x
        total = np.add.reduceat(at, begin)
        return total / _norms(int(size.max()))[size] + self.bias

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_described(top) @ np.array(self.logistic), -500, 500)))


def _described(top: np.ndarray) -> np.ndarray:
    """What the logistic sees of a document: both margins, what the first has above SURE, the length, 1."""
    return np.column_stack([top[:, 0], top[:, 1], np.maximum(top[:, 0] - SURE, 0), top[:, 2], np.ones(len(top))])


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a linear SVM by Newton steps on the squared hinge; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (x @ w) < 1
        h = ridge + (x[on].T * cost[on]) @ x[on]
        new = np.linalg.solve(h, x[on].T @ (cost[on] * y[on]))
        if np.allclose(new, w, rtol=1e-6, atol=1e-8):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _strongest(values: dict[str, float], bags: list[list[str]]) -> np.ndarray:
    """The two greatest values among the words of each bag, and how many words it has (a logarithm)."""
    out = np.full((len(bags), 3), FLOOR)
    for i, bag in enumerate(bags):
        v = sorted((values[w] for w in bag), reverse=True)[:2]
        out[i, : len(v)] = np.maximum(v, FLOOR)
        out[i, 2] = np.log1p(len(bag))
    return out


def train(rows: list[tuple[str, int]], landmarks: int = 320, rounds: int = 2, seed: int = 11) -> Scorer:
    """Fit on labelled texts, sentence by sentence."""
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    y = np.array([v for _, v in rows], float)
    if not rows or not 0 < y.sum() < len(y):
        prior = float(y.mean()) if len(y) else 0.0
        return Scorer(np.empty(0, np.int64), np.empty(0), FLOOR, (0.0, 0.0, 0.0, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))))
    ids: dict[str, int] = {}  # each word is held once, sentences as four-byte ids
    sentences = [[array("i", [ids.setdefault(w, len(ids)) for w in words(s)]) for s in _SENTENCE.split(t) if s] for t, _ in rows]
    names = list(ids)
    alphabet = Alphabet.of(names)
    rows = [("", v) for _, v in rows]
    toxic, clean = Counter(), Counter()
    for (_, v), ss in zip(rows, sentences, strict=True):
        (toxic if v else clean).update({names[i] for s in ss for i in s})
    n1, n0 = y.sum(), len(y) - y.sum()
    lift = {w: np.log((c + 0.2) / (n1 + 0.4)) - np.log((clean[w] + 0.2) / (n0 + 0.4)) for w, c in toxic.items()}
    # a toxic document's first witnesses: the words that the fewest clean documents and the most toxic ones have
    gain = {w: v * np.sqrt(toxic[w]) for w, v in lift.items()}
    rng = np.random.default_rng(seed)
    best = sorted((w for w in gain if toxic[w] > 1 and lift[w] > 1), key=lambda w: (-gain[w], w))[: landmarks // 2]
    usual = sorted(clean, key=lambda w: (-clean[w], w))[: landmarks // 8]
    rest = sorted({*clean, *toxic} - {*best, *usual})
    chosen = [*best, *usual, *(rest[i] for i in rng.permutation(len(rest))[: max(0, landmarks - len(best) - len(usual))])]
    chosen = [w for w in dict.fromkeys(chosen) if len(_coded([w], alphabet)[0]) - REACH >= ORDER]
    row, sub, weight = _subsequences(chosen, alphabet)
    subs, place = np.unique(sub, return_inverse=True)
    dense = np.zeros((len(chosen), len(subs)))
    np.add.at(dense, (row, place), weight)
    value, vector = np.linalg.eigh(dense @ dense.T)
    keep = value > 1e-6 * value.max(initial=1e-6)
    root = vector[:, keep] / np.sqrt(value[keep])  # the Nystroem map

    project = dense.T @ root
    del dense, value, vector

    def features(some: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(some), 64):
            part = some[k : k + 64]
            r, s, v = _subsequences(part, alphabet)
            at = np.searchsorted(subs, s)
            at[at == len(subs)] = 0
            ok = subs[at] == s
            out.append(np.bincount(r[ok] * len(subs) + at[ok], v[ok], len(part) * len(subs)).reshape(len(part), -1) @ project)
        return np.vstack(out)

    letters, every = "abcdefghijklmnopqrstuvwxyz", sorted({*clean, *toxic})
    negative = sorted(clean)
    hard: list[str] = [negative[i] for i in rng.permutation(len(negative))[:3000]]
    values = {w: gain.get(w, FLOOR) if lift.get(w, -9) > 1 else FLOOR for w in every}
    scorer = None
    for _ in range(rounds):
        witness = Counter()
        for (_, v), ss in zip(rows, sentences, strict=True):
            if v:
                top = sorted({max((names[i] for i in s), key=lambda w: (values[w], w)) for s in ss if s}, key=lambda w: (-values[w], w))[:2]
                witness.update(top[:1] + [w for w in top[1:] if values[w] > 0.3 * values[top[0]]])
        positive = sorted(w for w in witness if clean[w] <= 0.02 * n0)
        if not positive:
            break
        # the same insults with one more character, so that margins hold up under insertions
        more = {w[:k] + letters[rng.integers(26)] + w[k:]: witness[w] / 3 for w in positive if witness[w] > 2 and len(w) > ORDER for k in rng.integers(1, len(w), 3)}
        more = {w: c for w, c in more.items() if w not in clean and w not in witness}
        x = np.vstack([features([*positive, *more]), features(hard)])
        label = np.concatenate([np.ones(len(positive) + len(more)), -np.ones(len(hard))])
        positive += more
        witness.update(more)
        count = np.concatenate([np.log1p([witness[w] for w in positive]), np.ones(len(hard))])
        cost = np.where(label > 0, count * len(hard) / count[: len(positive)].sum(), 1.0) * 2.0
        w = _squared_hinge(x, label, cost)
        scorer = Scorer(subs, project @ w[:-1], float(w[-1]), (0.0,) * 5, alphabet)
        values = {}
        for k in range(0, len(every), 50_000):
            values |= dict(zip(every[k : k + 50_000], scorer.margins(every[k : k + 50_000]).tolist(), strict=True))
        worst = sorted(negative, key=lambda w: (-values[w], w))[:1500]
        hard = sorted({*hard, *worst})
    if scorer is None:
        return train([], landmarks)
    top = np.vstack([_strongest(values, [[names[i] for s in ss for i in s]]) for ss in sentences])
    scorer.logistic = tuple(_logistic(_described(top), y).tolist())
    return scorer


def held_out(name: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, each: tuple[int, int] = (1000, 2000), most_bytes: int = 24 << 20) -> list[tuple[str, int]]:
    """At most ``each`` (toxic, clean) labelled texts that are not held out, ``most_bytes`` of them, the least by a hash of the id.

    An id that is labelled both ways is toxic. Of rows that repeat an id the one whose text has the least hash is taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(each[0]).unionByName(known.filter("toxic = 0").orderBy(*order).limit(each[1]))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("hash", F.xxhash64("text"))
    sizes = found.groupBy("doc_id").agg(F.min(F.struct("hash", F.octet_length("text").alias("size"), "toxic")).alias("x")).select("doc_id", "x.*", order[0].alias("place")).collect()  # at most a row an id
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        total += r.size or 0
        if total > most_bytes:
            break
        chosen.append((r.doc_id, r.hash))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("hash", T.LongType())]))
    texts = found.join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(texts, key=lambda r: r.doc_id)]


def with_score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text; each distinct word of a task once."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in parts:
            scores, column = [], batch.column("text")
            for a, b in groups(column.fill_null("").cast(pa.large_binary()), 1 << 20):
                bags = [words(t or "") for t in column.slice(a, b - a).to_pylist()]
                new = list(set().union(*bags) - known.keys())
                for k in range(0, len(new), 20_000):
                    known.update(zip(new[k : k + 20_000], np.maximum(shared.value.margins(new[k : k + 20_000]), FLOOR).tolist(), strict=True))
                top = np.full((len(bags), 3), FLOOR)
                for i, bag in enumerate(bags):
                    top[i, 2] = np.log1p(len(bag))
                    if bag:
                        v = np.fromiter(map(known.__getitem__, bag), float, len(bag))
                        j = int(v.argmax())
                        top[i, 0], v[j] = v[j], FLOOR
                        top[i, 1] = max(v.max(), FLOOR)
                scores.append(shared.value.score(top))
                if len(known) > 200_000:
                    known.clear()
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])
        known.clear()
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) of each row of ``docs``.

    A null text is empty; a text without words gets the score of no insult. Rows that repeat a doc_id
    are scored each; other columns are not looked at. Without labels of both kinds every row gets
    the share of toxic labels as its score.
    """
    scorer = train(labelled_sample(docs, labels))
    return with_score(docs.select("doc_id", "text"), scorer).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic; every column is kept, whatever its name."""
    (name,) = fresh(docs, "toxicity")
    scorer = train(labelled_sample(docs, labels))
    return with_score(docs, scorer, name).filter(F.col(name) < threshold).select(*docs.columns)
