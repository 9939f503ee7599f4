"""The main text of a page as its maximum-scoring subsequence.

A page is read once as a sequence of tags and runs of words. A word scores by where it stands: the
elements, class names, ids and roles that it is under, the block it is in, whether it is a link. A tag
scores by its name, always negative. The weights of places are a logistic regression on the runs of
``labelled_pages``, those of tags log odds counted there; a name that the labelled pages do not have
weighs nothing. A linear scan finds the contiguous stretch with the greatest sum, which is widened to
whole blocks; what stands inside it and scores negative by itself (an advert amid the article, a
comment) is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import batches
from korridor.llm.labelled_pages import page as labelled_page

PAGES, TAG = 400, 0.25  #: labelled pages that are learnt from; what a tag weighs against a word, so that a last block of one word is not lost
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
#: a comment, a declaration or a tag; a quote begins a value only after an equals sign
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[=\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|\Z)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_ENDS = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


def _names(tag: str, attributes: str) -> list[str]:
    """What an element says of itself: its name, the words of its class, id and role, whether it is hidden."""
    out = [tag]
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                out.append("!hidden")
            elif name in ("class", "id", "role"):
                out += [f".{w}" for w in re.split(r"[^a-z0-9]+", value) if w]
    return out


class _Path:
    """The open elements of a page. Every step costs the same however deep the page is."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.open, self.names, self.tags, self.total = weights, [], Counter(), Counter(), 0.0

    def push(self, tag: str, attributes: str) -> None:
        names = _names(tag, attributes)
        for n in names:
            self.names[n] += 1
            if self.names[n] == 1:
                self.total += self.weights.get(n, 0.0)
        block = tag if tag in _BLOCK else self.open[-1][2] if self.open else "body"
        self.open.append((tag, names, block))
        self.tags[tag] += 1

    def pop(self) -> str:
        tag, names, _ = self.open.pop()
        self.tags[tag] -= 1
        for n in names:
            self.names[n] -= 1
            if not self.names[n]:
                del self.names[n]
                self.total -= self.weights.get(n, 0.0)
        return tag

    def place(self) -> list[str]:
        """All that a word here is known by."""
        return [*self.names, "in " + (self.open[-1][2] if self.open else "body"), "any"]

    def score(self) -> float:
        return self.total + self.weights.get("in " + (self.open[-1][2] if self.open else "body"), 0.0) + self.weights.get("any", 0.0)


def read_page(page: str, path: _Path) -> Iterator[tuple[str, str]]:
    """("tag", name), ("mark", comment) or ("text", run) in page order; ``path`` is where each run stands."""
    at = 0
    while at <= len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            yield "text", page[at:end]
        if not m:
            return
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            yield "mark", m[0]
        elif m[1]:
            if path.tags[tag] > 0:
                while path.pop() != tag:
                    pass
            yield "tag", tag
        else:
            while path.open:
                top = path.open[-1][0]
                loose = tag in _BLOCK and tag != "br" and top not in _BLOCK and any(t == "p" for t, _, _ in path.open[-4:])
                if tag not in _ENDS.get(top, ()) and not loose:
                    break
                path.pop()
            yield "tag", tag
            if tag in _RAW:
                raw = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = raw.end() if raw else len(page)
            elif tag not in _VOID and not m[3].endswith("/"):
                path.push(tag, m[3])


def learn(pages: Iterable[str], cost: float = 0.5) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of places and of tags from labelled pages."""
    runs, tags, main = Counter(), {True: Counter(), False: Counter()}, False
    for page in pages:
        path, main = _Path({}), False
        for kind, value in read_page(page, path):
            if kind == "mark":
                main = value == "<!--main-->" if "main" in value else main
            elif kind == "tag":
                tags[main][value] += 1
            elif n := len(value.split()):
                runs[tuple(sorted(path.place())), main] += n
    names = {n: i for i, n in enumerate(sorted({n for place, _ in runs for n in place}))}
    x, y, w = np.zeros((len(runs), len(names))), np.zeros(len(runs)), np.zeros(len(runs))
    for i, ((place, label), n) in enumerate(runs.items()):
        x[i, [names[p] for p in place]], y[i], w[i] = 1.0, label, log(1 + n)
    weight = np.zeros(len(names))
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        h = (x.T * (w * p * (1 - p) + 1e-9)) @ x + cost * np.eye(len(names))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - cost * weight)
        weight += step
        if np.abs(step).max() < 1e-6:
            break
    tag = {t: -TAG * max(0.2, min(4.0, 0.5 + log((tags[False][t] + 1) / (tags[True][t] + 1)))) for t in {*tags[True], *tags[False]}}
    return {n: float(weight[i]) for n, i in names.items()}, tag


@cache
def weights() -> tuple[dict[str, float], dict[str, float]]:
    return learn(labelled_page(seed) for seed in range(PAGES))


def best_stretch(scores: list[float]) -> tuple[int, int] | None:
    """The first and last place of the contiguous stretch with the greatest sum above zero; the first of equal ones, as short as possible."""
    best, total, begin, region = 0.0, 0.0, 0, None
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, region = total, (begin, i)
    return region


def main_text(page: str | None) -> str:
    """The article of a page; blocks joined by one space."""
    place, tag = weights()
    path = _Path(place)
    blocks: list[list] = [[]]  # runs of words: (their place's score, text)
    scores, owner = [], []
    for kind, value in read_page(page or "", path):
        if kind == "tag":
            scores.append(tag.get(value, -TAG))
            if value in _BLOCK and blocks[-1]:
                blocks.append([])
            owner.append(None)
        elif kind == "text":
            score, n = max(-4.0, min(4.0, path.score())), len(value.split())
            scores.append(score * n)
            owner.append(len(blocks) - 1 if n else None)
            blocks[-1].append((score, value))
    region = best_stretch(scores)
    if region is None:
        return ""
    out = []
    for b in sorted({b for b in owner[region[0] : region[1] + 1] if b is not None}):
        text = " ".join(entities.unescape("".join(t for w, t in blocks[b] if w > 0)).split())
        if text:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of ``pages``.

    A null or empty page, or one without any word that scores, has an empty text. Every row gives
    one row, repeated ones too; page_id and url are handed through, nulls included. Of equal stretches
    the first is the article. The time grows with the page's length alone, however deeply it is nested
    or however many tags it leaves open. An empty table gives no rows. Other columns are not looked
    at, whatever their names.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield from batches(TEXT, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, 1_000)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
