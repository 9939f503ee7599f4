"""Token counts as rollups that signed changes maintain.

A rollup lives in a folder of any store that Spark writes to:

* ``ledger/<attempt>/bucket=<b>``: what each changed document counted from this batch on (doc_id,
  tokenizer, source, lang, tokens, alive) with the batch's number, by bucket of doc_id;
* ``deltas/<attempt>``: the batch's signed sums by source, lang and tokenizer;
* ``commits/<number>``: one small file per batch, created only if absent, that names the batch and
  its attempt. What no commit names was left by a lost writer and is never read;
* ``snapshots/<number>``: one small file per compaction, likewise, that names an attempt with the last
  word on each living document and the sums, of all batches before that number.

A batch turns inserts into +1 document and +n tokens, deletes into the negative of what the ledger
last said, and a revised text or count into both. Totals are the sums of the deltas. A batch looks
only into the buckets that its documents lie in, and there only at their rows; every ``compact_after``
batches the ledger is compacted, so that no batch reads a file for each batch since the first. A
batch that was committed before is not applied again; if two writers race for a number, one fails
and changes nothing. That needs a store which creates a file only if it is absent (HDFS, local and
network file systems; object stores with conditional writes).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korridor.llm.common import NO_ID, WORD

KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, alive boolean, number long"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def words(rows: DataFrame) -> DataFrame:
    """The ``tokens`` of each text as words between ASCII white space."""
    return rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long")).drop("text")


def byte_bpe(path: str) -> Callable[[DataFrame], DataFrame]:
    """The ``tokens`` of each text by a tokenizer file."""

    def count(rows: DataFrame) -> DataFrame:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from korridor.llm.common import bytes_of
            from korridor.llm.pieces import groups
            from korridor.llm.token_files import byte_bpe as cached

            encoder = cached(path).pieces
            for batch in parts:
                at, text = batch.schema.get_field_index("text"), batch.column("text").cast(pa.large_binary())
                n = [np.diff(encoder.texts(*bytes_of(text.slice(a, b - a)))[1], prepend=0) for a, b in groups(text)]
                n = np.concatenate(n) if n else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(n)], [*(c for i, c in enumerate(batch.schema.names) if i != at), "tokens"])

        kept = [f for f in rows.schema.fields if f.name != "text"]
        return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", tokens long")

    return count


class TokenRollup:
    """The rollup in folder ``path``. ``counters``: what counts tokens, by tokenizer version."""

    def __init__(self, spark: SparkSession, path: str, counters: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = 32, compact_after: int = 16) -> None:
        self.spark, self.path, self.counters, self.buckets, self.compact_after = spark, path, counters, buckets, compact_after

    def _fs(self, name: str = "") -> tuple:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _marks(self, kind: str) -> list[tuple[int, str, str]]:
        """Number and the two lines of each small file, in order. Bounded by the number of batches."""
        fs, path = self._fs(kind)
        if not fs.exists(path):
            return []
        out = []
        for name in sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().isdigit()):
            stream = fs.open(self._fs(f"{kind}/{name}")[1])
            out.append((int(name), *self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[:2]))
            stream.close()
        return out

    def _mark(self, kind: str, number: int, *lines: str) -> None:
        fs, path = self._fs(f"{kind}/{number:012d}")
        stream = fs.create(path, False)  # fails if another writer was faster
        stream.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        stream.close()

    def commits(self) -> list[tuple[str, str]]:
        """Batch and attempt of each commit, in order."""
        return [(batch, attempt) for _, batch, attempt in self._marks("commits")]

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The last snapshot and all that was committed since."""
        taken = self._marks("snapshots")
        since = taken[-1][0] if taken else 0
        paths = [f"{self.path}/{kind}/{attempt}" for _, _, attempt in taken[-1:]] + [f"{self.path}/{kind}/{attempt}" for number, _, attempt in self._marks("commits") if number >= since]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(paths[0])  # paths with folders by bucket are read one by one
        for p in paths[1:]:
            out = out.unionByName(self.spark.read.schema(schema).parquet(p))
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The last word of the ledger on each living document and tokenizer; ``ids``: on these alone."""
        ledger = self._read("ledger", LEDGER + ", bucket int")
        if ids is not None:
            touched = [r.b for r in ids.select(self._bucket().alias("b")).distinct().collect()]  # no more rows than buckets
            ledger = ledger.filter(F.col("bucket").isin(touched)) if touched else ledger.limit(0)
            ledger = ledger.join(ids.hint("merge"), "doc_id", "left_semi")
        last = F.max(F.struct("number", "source", "lang", "tokens", "alive")).alias("last")
        return ledger.groupBy("doc_id", "tokenizer").agg(last).filter("last.alive").select("doc_id", "tokenizer", "last.source", "last.lang", "last.tokens")

    def _write_ledger(self, rows: DataFrame, attempt: str) -> DataFrame:
        rows = rows.select("doc_id", "tokenizer", "source", "lang", "tokens", "alive", "number", self._bucket().alias("bucket"))
        rows.repartitionByRange("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{self.path}/ledger/{attempt}")
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{attempt}")

    def count(self, docs: DataFrame) -> DataFrame:
        """doc_id, tokenizer, source, lang, tokens of each document by each counter.

        A null text has no tokens. A doc_id that repeats is one document with all its rows' tokens,
        under the source and lang of its least row; a null doc_id is a document like any other.
        """
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
        parts = [count(rows).withColumn("tokenizer", F.lit(name)) for name, count in self.counters.items()]
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p)
        new = new.groupBy("doc_id", "tokenizer").agg(F.min(F.struct("source", "lang")).alias("place"), F.sum("tokens").alias("tokens"))
        return new.select("doc_id", "tokenizer", "place.source", "place.lang", "tokens")

    def apply(self, batch: str, changes: DataFrame, delete: bool = False) -> bool:
        """Commit a batch of documents (doc_id, text, source, lang): new, revised, or with ``delete`` gone (doc_id alone).

        False if the batch was committed before. Nulls and repeats as in ``count``; deleting what is
        not there changes nothing; other columns are not looked at, whatever their names.
        """
        if delete:
            return self._commit(batch, lambda: (None, changes.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()))
        return self._commit(batch, lambda: (self.count(changes), None))

    def apply_counts(self, batch: str, counts: DataFrame) -> bool:
        """Commit revised counts (doc_id, tokenizer, source, lang, tokens; a row for each doc_id and tokenizer)."""
        return self._commit(batch, lambda: (counts.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "tokenizer", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("tokens").cast("long")), None))

    def _commit(self, batch: str, work: Callable[[], tuple[DataFrame | None, DataFrame | None]]) -> bool:
        if "\n" in batch:
            raise ValueError("a batch's name is one line")
        done = self.commits()
        if batch in {b for b, _ in done}:
            return False
        number, attempt = len(done), f"{len(done):012d}-{uuid.uuid4().hex}"
        new, gone = work()
        if gone is not None:
            ledger = self.current(gone).withColumns({"tokens": F.lit(0).cast("long"), "alive": F.lit(False)})
        else:
            ledger = new.withColumn("alive", F.lit(True))
        written = self._write_ledger(ledger.withColumn("number", F.lit(number).cast("long")), attempt)
        signed = written.filter("alive").select(*KEYS, F.lit(1).alias("sign"), "tokens")
        if done:
            ids = written.select("doc_id", "tokenizer").distinct()
            old = self.current(ids.select("doc_id").distinct()).join(ids.hint("merge"), ["doc_id", "tokenizer"], "left_semi")
            signed = signed.unionByName(old.select(*KEYS, F.lit(-1).alias("sign"), "tokens"))
        delta = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        delta.write.parquet(f"{self.path}/deltas/{attempt}")
        self._mark("commits", number, batch, attempt)
        taken = self._marks("snapshots")
        if number + 1 - (taken[-1][0] if taken else 0) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the last word on each living document, and the sums, as one snapshot."""
        number, attempt = len(self.commits()), f"snapshot-{uuid.uuid4().hex}"
        self._write_ledger(self.current().withColumns({"alive": F.lit(True), "number": F.lit(number - 1).cast("long")}), attempt)
        self.totals().write.parquet(f"{self.path}/deltas/{attempt}")
        self._mark("snapshots", number, "snapshot", attempt)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; groups that have no document are gone."""
        sums = self._read("deltas", DELTA).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents != 0 or tokens != 0")
