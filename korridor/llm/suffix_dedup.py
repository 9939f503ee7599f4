"""Removal of repeated byte passages by distributed prefix doubling.

A byte goes if it lies in a string of ``width`` bytes that also starts earlier: in a document with a
smaller doc_id, or earlier in the same one. All strings are judged on the input.

Spark sorts pairs (rank of a shorter string, name of the longer one around it) at growing offsets,
reranks, and drops what is unique, until strings are past ``width`` bytes. Doing so for every position
would sort the whole corpus once per length, a row per byte. So ranks are kept for positions where
they can matter:

1. Each task doubles names from 1 to 32 and 64 bytes (see ``anchors``) and keeps one *anchor* for about
   35 positions, chosen by content, so that two equal strings keep the same one.
2. At 32 bytes: Spark sorts the anchors by the pair (name of 32 bytes, name of the pair extended to all
   bytes its windows cover, 100 to 168). A first name that is unique is dropped, with all windows under
   it. Of equal pairs all but the first are repeats, with all their windows.
3. At 65 and at 89 bytes (for a ``width`` of 100): what is left has first names that go on differently. The windows under an
   anchor are parted into bands of 36, then 12 starts; all windows of a band share 65, then 89 bytes,
   whose name with the rank so far is the new rank. Bands whose rank is unique are dropped.
4. At 100 bytes: each window left is named, sorted and ranked within its band's rank; all but the first
   of equal ones are repeats.

Ranks that more than 1 / SHARE of the rows at hand have (the ends of a passage that many documents
share and go on from in their own ways), at most SHARE of them, are split off by a broadcast: their
rows are dealt out by what follows, in step 2 by the whole pair, in step 4 by the single window; in
step 3 they stay without being counted. Equal anchors, bands and windows that meet in one task are
merged before a shuffle, so a passage that a third of all documents share costs a row per task. Names
have 64 bits, and a decision always needs two of them.

Nulls: a null text is empty; a null doc_id comes before all others. Empty and short texts lose
nothing; a very long text is named in overlapping segments. Rows that repeat a doc_id with the same
text are one document: one of them goes through all steps, and each gets its result. Rows that repeat a
doc_id, or have none, with different texts are documents of their own, in the order of a hash of
their texts. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korridor.llm.anchors import KEY, LONG, anchors, pair, window_names
from korridor.llm.common import batches, byte_parts, cut, drop, fresh, identified, keyed, release, unkeyed

ANCHOR = pa.schema([("name", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("hi", pa.int32()), ("at", pa.int32()), ("repeat", pa.bool_())])
SPAN = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("end", pa.int64())])
TEXT = pa.schema([("name", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])
WINDOW = pa.schema([("name", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("end", pa.int64()), ("repeat", pa.bool_())])
BAND = pa.schema([*TEXT, ("end", pa.int64()), ("repeat", pa.bool_())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("end", pa.int64())])))])
BUFFER, SEGMENT, FLUSH = 1 << 18, 1 << 22, 1 << 26
SHARE = 1024  #: a name is hot with more than this part of all rows
BANDS = (36, 12)  #: window starts of a band, so that its windows share all but so many bytes; the ranks grow from 32 to 65 and 89 bytes of 100


def _mapped(rows: DataFrame, run, schema: pa.Schema) -> DataFrame:
    """``run`` over the tasks' batches; a worker gives freed memory back after each task."""

    def done(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        release()

    return rows.mapInArrow(done, _ddl(schema))


def _ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _segments(raw: np.ndarray, ends: np.ndarray, ids: np.ndarray, width: int) -> Iterator[tuple]:
    """Buffers of whole documents, about BUFFER bytes each; a longer document in overlapping segments."""
    first, begin = 0, 0
    for i, end in enumerate(ends):
        start = ends[i - 1] if i else 0
        if end - start > SEGMENT:
            if i > first:
                yield raw[begin:start], ends[first:i] - begin, ids[first:i], np.zeros(i - first, np.int64)
            for s in range(start, max(start + 1, end - width + 1), SEGMENT):
                e = min(end, s + SEGMENT + width - 1)
                yield raw[s:e], np.array([e - s]), ids[i : i + 1], np.array([s - start])
            first, begin = i + 1, end
        elif end - begin >= BUFFER:
            yield raw[begin:end], ends[first : i + 1] - begin, ids[first : i + 1], np.zeros(i + 1 - first, np.int64)
            first, begin = i + 1, end
    if first < len(ends):
        yield raw[begin:], ends[first:] - begin, ids[first:], np.zeros(len(ends) - first, np.int64)


def _merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, those that touch made one."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # a running maximum per document: documents are lifted apart first
    lift = np.cumsum(new_doc).astype(np.int64) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = new_doc.copy()
    new[1:] |= lo[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], lo[at], reach[np.concatenate([at[1:], [len(doc)]]) - 1] - lift[at]


def _spans(x: dict[str, np.ndarray], some: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """doc_id, tie, lo, end of the rows ``some``, merged."""
    doc_id, tie = x["doc_id"][some], x["tie"][some]
    order = np.lexsort((tie, doc_id))
    new = np.ones(len(order), bool)
    new[1:] = (doc_id[order][1:] != doc_id[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    doc, lo, end = _merged(code, x["lo"][some], end[some])
    first = order[new]
    return {"doc_id": doc_id[first][doc], "tie": tie[first][doc], "lo": lo, "end": end}


def _sorted(x: dict[str, np.ndarray], *key: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """``x`` by key and place; the first row of each key; the rows that come after it elsewhere (a repeated row is no repeat)."""
    order = np.lexsort([x[k] for k in ("lo", "tie", "doc_id", *reversed(key))])
    x = {k: v[order] for k, v in x.items()}
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in key])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.empty(0, np.int64)
    return x, first, ~np.logical_and.reduce([x[k] == x[k][lead] for k in ("doc_id", "tie", "lo")])


def _anchor_rows(found: list[dict], width: int) -> Iterator[pa.RecordBatch]:
    """The first anchor of each pair, and what the others of this task cover."""
    x, _, again = _sorted({k: np.concatenate([f[k] for f in found]) for k in found[0]}, "name", "context")
    span, keep = _spans(x, again, x["hi"] + width), ~again
    n, gap = int(keep.sum()), np.zeros(len(span["lo"]), np.int64)
    yield from batches(ANCHOR, {
        "name": np.concatenate([x["name"][keep], gap]), "context": np.concatenate([x["context"][keep], gap]), "doc_id": np.concatenate([x["doc_id"][keep], span["doc_id"]]),
        "tie": np.concatenate([x["tie"][keep], span["tie"]]), "lo": np.concatenate([x["lo"][keep], span["lo"]]),
        "hi": np.concatenate([(x["hi"] - x["lo"])[keep], span["end"] - span["lo"] - width]).astype(np.int32), "at": np.concatenate([(x["at"] - x["lo"])[keep], gap]).astype(np.int32),
        "repeat": np.arange(n + len(gap)) >= n,
    })


def _find(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in parts:
            raw, ends = byte_parts(batch)
            ids, ties = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy()
            none = np.zeros(len(ids), np.int64)
            yield from batches(ANCHOR, {"name": none, "context": none, "doc_id": ids, "tie": ties, "lo": none, "hi": none, "at": none - 1, "repeat": none > 0})  # that the row is there
            for piece, stops, docs, shift in _segments(raw, ends, np.arange(len(ids)), width):
                x = anchors(piece, stops, width)
                doc = x.pop("doc")
                for k in ("lo", "hi", "at"):
                    x[k] = x[k] + shift[doc] if len(doc) else x[k]
                of = docs[doc] if len(doc) else np.empty(0, np.int64)
                found.append(x | {"doc_id": ids[of], "tie": ties[of]})
                held += len(piece)
                if held >= FLUSH:
                    yield from _anchor_rows(found, width)
                    found, held = [], 0
        if found:
            yield from _anchor_rows(found, width)

    return run


def _fetch(width: int):
    """The bytes under each unresolved anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, ids, ties, lists = batch.column("text").cast(pa.large_binary()), batch.column("doc_id"), batch.column("tie"), batch.column("open")
            out = {k: [] for k in TEXT.names}
            for i in range(len(batch)):
                text = texts[i].as_py()
                for o in lists[i].as_py():
                    out["name"].append(o["name"])
                    out["doc_id"].append(ids[i].as_py())
                    out["tie"].append(ties[i].as_py())
                    out["lo"].append(o["lo"])
                    out["at"].append(o["at"])
                    out["bytes"].append(text[o["lo"] : o["lo"] + o["hi"] + width])
            yield from batches(TEXT, out)

    return run


def _windows(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    """Each window under the anchors of a batch: name, at (place of the anchor in it), window, doc_id, tie, lo."""
    raw, ends = byte_parts(batch, "bytes")
    if len(raw) < width:
        return {k: np.empty(0, np.int64) for k in ("name", "at", "window", "doc_id", "tie", "lo")}
    sizes = np.diff(np.concatenate([[0], ends]))
    count = sizes - width + 1
    row = np.repeat(np.arange(len(sizes)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    named = window_names(raw, width)[(ends - sizes)[row] + step]
    own = {k: batch.column(k).to_numpy()[row] for k in ("name", "at", "doc_id", "tie", "lo")}
    return own | {"at": (own["at"] - step).astype(np.int32), "window": named, "lo": own["lo"] + step}


def _rank(width: int):
    """Windows ranked within the anchors of a task, a bounded number of anchors at a time."""

    def resolve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, _, again = _sorted(_windows(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width), "name", "at", "window")
        yield from batches(SPAN, _spans(x, again, x["lo"] + width))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in parts:  # sorted by name: all but the last name are complete
            held.append(batch)
            rows += len(batch)
            if rows < 20_000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name = whole.column("name").to_numpy()
            stop = int(np.searchsorted(name, name[-1], side="left"))
            if stop:
                yield from resolve([whole.slice(0, stop)])
            held, rows = [whole.slice(stop)], len(whole) - stop
        if rows:
            yield from resolve(held)

    return run


def _explode(width: int):
    """The first of each window of some rows, and what the others cover."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, len(batch), 20_000):
                x, _, again = _sorted(_windows(batch.slice(at, 20_000), width), "name", "at", "window")
                span, keep = _spans(x, again, x["lo"] + width), ~again
                n, gap = int(keep.sum()), np.zeros(len(span["lo"]), np.int64)
                first = {k: np.concatenate([x[k][keep], gap]) for k in ("name", "at", "window")}
                place = {k: np.concatenate([x[k][keep], span[k]]) for k in ("doc_id", "tie", "lo")}
                yield from batches(WINDOW, first | place | {"at": first["at"].astype(np.int32), "end": np.concatenate([x["lo"][keep] + width, span["end"]]), "repeat": np.arange(n + len(gap)) >= n})

    return run


def _refine(width: int, band: int):
    """Each row of unresolved windows as its bands of ``band`` starts, the rank of each made longer by the bytes that its windows share."""
    length = width - band + 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in range(0, len(whole), 20_000):
                batch = whole.slice(part, 20_000)
                raw, ends = byte_parts(batch, "bytes")
                if not len(raw):
                    continue
                size = np.diff(ends, prepend=0)
                count, at = size - width + 1, batch.column("at").to_numpy().astype(np.int64)
                most = at // band  # the band of a window is where the anchor lies in it, divided
                bands = most - (at - count + 1) // band + 1
                row = np.repeat(np.arange(len(size)), bands)
                g = most[row] - (np.arange(len(row)) - np.repeat(np.cumsum(bands) - bands, bands))
                first = np.maximum(0, at[row] - (g + 1) * band + 1)
                last = np.minimum(count[row] - 1, at[row] - g * band)
                begin = (ends - size)[row]
                shared = window_names(raw, length)[begin + at[row] - g * band].view(np.uint64)
                rank = pair(pair(batch.column("name").to_numpy()[row].view(np.uint64), shared, 5), g.astype(np.uint64), 6)
                each = window_names(raw, width).view(np.uint64)
                x = {k: batch.column(k).to_numpy()[row] for k in ("doc_id", "tie")} | {
                    "name": rank.view(np.int64), "lo": batch.column("lo").to_numpy()[row] + first, "at": (at[row] - first).astype(np.int32), "count": last - first + 1,
                    "all": pair(each[begin + first], each[begin + last], 7).view(np.int64), "begin": begin + first,
                }
                x, _, again = _sorted(x, "name", "at", "count", "all")  # equal bands: all but the first are repeats
                span, keep, text = _spans(x, again, x["lo"] + x["count"] - 1 + width), ~again, raw.tobytes()
                none = np.zeros(len(span["lo"]), np.int64)
                row_bytes = [text[a : a + n + width - 1] for a, n in zip(x["begin"][keep].tolist(), x["count"][keep].tolist(), strict=True)]
                yield from batches(BAND, {
                    "name": np.concatenate([x["name"][keep], none]), "at": np.concatenate([x["at"][keep], none]).astype(np.int32), "bytes": row_bytes + [b""] * len(none), **{k: np.concatenate([x[k][keep], span[k]]) for k in ("doc_id", "tie", "lo")},
                    "end": np.concatenate([x["lo"][keep], span["end"]]), "repeat": np.arange(len(row_bytes) + len(none)) >= len(row_bytes),
                })

    return run


def _shared(rows: DataFrame, label: str) -> DataFrame:
    """The rows whose rank another row has, written; one exchange, none for hot ranks."""
    hot = F.broadcast(_hot(rows))
    few = rows.join(hot, "name", "left_anti").repartition("name").withColumn("n", F.count("*").over(Window.partitionBy("name"))).filter("n > 1").drop("n")
    return cut(few.unionByName(rows.join(hot, "name", "left_semi")), label)


def _hot(rows: DataFrame) -> DataFrame:
    """The names that more than 1 / SHARE of ``rows`` have, verified; fewer than SHARE rows, for a broadcast."""
    likely = rows.agg(F.expr(f"approx_top_k(name, {SHARE}, {8 * SHARE})").alias("top"), F.count("*").alias("all")).select(F.explode("top").alias("top"), "all")
    likely = F.broadcast(likely.select(F.col("top.item").alias("name"), "all"))
    found = rows.select("name").join(likely, "name").groupBy("name").agg(F.count("*").alias("n"), F.first("all").alias("all"))
    return cut(found.filter(F.col("n") * SHARE > F.col("all")).select("name"), "hot")


def _finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal removed runs of each document, and the digest of what stays."""
    for batch in parts:
        texts, out = batch.column("text").cast(pa.large_binary()), {k: [] for k in RESULT.names}
        for doc_id, text, lists in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans"), strict=True):
            text, spans = memoryview(text.as_buffer()), []
            found = lists.values if lists.is_valid else None
            if found is not None and len(found):
                _, lo, end = _merged(np.zeros(len(found), np.int64), found.field("lo").to_numpy(), found.field("end").to_numpy())
                spans = [(int(a), min(int(b), len(text))) for a, b in zip(lo, end, strict=True) if a < len(text)]
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(digest.hexdigest())
            out["spans"].append([{"lo": a, "end": b} for a, b in spans])
        for done in batches(RESULT, out, len(batch) or 1):
            yield done.append_column("times", batch.column("times").fill_null(1)) if "times" in batch.schema.names else done


def _unrepeated(docs: DataFrame, texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``texts`` and the anchors ``found`` with one row for those that repeat doc_id and tie; and these keys with the row that stays and how often, if there are any.

    Only keys are grouped. Where nothing repeats, as when ids are unique, no text and no anchor moves.
    """
    key, anchor = ["doc_id", "tie"], found.filter("at >= 0")
    keys = cut(found.filter("at < 0").groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    if keys.isEmpty():
        drop(keys)
        return texts, anchor, None
    (row,) = fresh(docs, "row")
    named = keyed(identified(docs, row), F.col(row).alias("row")).withColumn("tie", F.xxhash64("text"))
    first = named.select(*key, "row").join(keys, key).groupBy(*key).agg(F.min("row").alias("first"), F.first("times").alias("times"))
    repeated = cut(first, "repeated")
    one = named.join(repeated, key, "left").filter("first IS NULL OR row = first").select("doc_id", "text", "tie")
    copies = anchor.join(repeated.select(*key), key, "left_semi").dropDuplicates()
    single = cut(anchor.join(repeated.select(*key), key, "left_anti").unionByName(copies), "single")
    drop(keys)
    return one, single, repeated


def suffix_dedup(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` (lo, end) of each document.

    ``width``: 99 to 128 bytes.
    """
    if not LONG + max(BANDS) - 1 <= width <= 2 * LONG:
        raise ValueError(f"width must be {LONG + max(BANDS) - 1} to {2 * LONG}")
    place, key = ["doc_id", "tie", "lo"], ["name", "at", "window"]
    texts = keyed(docs).withColumn("tie", F.xxhash64("text"))
    written = cut(_mapped(texts, _find(width), ANCHOR), "anchors")
    texts, found, repeated = _unrepeated(docs, texts, written)
    anchor = found.filter(~F.col("repeat"))
    hot = F.broadcast(_hot(anchor))
    same_name, same_pair = Window.partitionBy("name"), Window.partitionBy("name", "context").orderBy(*place)
    few = (
        anchor.join(hot, "name", "left_anti").repartition("name")  # one exchange serves both windows
        .withColumn("rank", F.rank().over(same_pair))
        .withColumn("size", F.sum((F.row_number().over(same_pair) == 1).cast("int")).over(same_name))
        .filter((F.col("rank") > 1) | (F.col("size") > 1)).drop("size")
    )
    many = anchor.join(hot, "name", "left_semi").withColumn("rank", F.rank().over(same_pair))  # a hot name may go on in one way only: its windows then are unique
    repeats = found.filter("repeat").withColumn("rank", F.lit(2))
    ranked = cut(few.unionByName(many).unionByName(repeats).drop("context", "repeat"), "ranked")
    drop(written, *([found] if repeated is not None else []))
    again = ranked.filter("rank > 1").select(*place, (F.col("lo") + F.col("hi") + width).alias("end"))
    opened = ranked.filter("rank = 1").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("name", "lo", "hi", "at")).alias("open"))
    fetched = cut(_mapped(texts.join(opened.hint("shuffle_hash"), ["doc_id", "tie"]), _fetch(width), TEXT), "fetched")
    merged = []
    for band in BANDS:
        longer = cut(_mapped(fetched, _refine(width, band), BAND), "longer")
        drop(fetched)
        merged.append(cut(longer.filter("repeat").select(*place, "end"), "merged"))
        fetched = _shared(longer.filter(~F.col("repeat")).select(*TEXT.names), "shared")
        drop(longer)
    hot = F.broadcast(_hot(fetched))
    few = _mapped(fetched.join(hot, "name", "left_anti").repartition("name").sortWithinPartitions("name"), _rank(width), SPAN)
    windows = cut(_mapped(fetched.join(hot, "name", "left_semi"), _explode(width), WINDOW), "windows")
    order = Window.partitionBy(*key).orderBy(*place)
    later = windows.filter(~F.col("repeat")).withColumn("rank", F.rank().over(order)).filter("rank > 1")
    for part in merged:
        again = again.unionByName(part)
    spans = again.unionByName(few).unionByName(windows.filter("repeat").select(*place, "end")).unionByName(later.select(*place, "end"))
    spans = cut(spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("lo", "end")).alias("spans")), "spans")
    drop(ranked, fetched, windows, *merged)
    whole = texts.join(spans.hint("shuffle_hash"), ["doc_id", "tie"], "left")
    if repeated is None:
        return _mapped(whole, _finish, RESULT).withColumn("doc_id", unkeyed())
    done = _mapped(whole.join(repeated.select("doc_id", "tie", "times"), ["doc_id", "tie"], "left"), _finish, pa.schema([*RESULT, ("times", pa.int64())]))
    return done.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times").withColumn("doc_id", unkeyed())


assert KEY < LONG <= 100 - max(BANDS) + 1
