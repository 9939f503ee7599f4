"""Reading, cutting lineage and row identity, shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)  #: stands for a null doc_id while an operator runs; sorts before every other
WORD = r"[^\x20\x09-\x0D]+"  #: a word is a run of anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="korridor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later steps read the written rows whatever executors are lost meanwhile, and the shuffle files
    of the steps before can go: their owners are released here, so that the disk holds one step.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in frames:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (NO_ID for null), text (empty for null) and the columns asked for; other columns never matter."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def unkeyed(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def bytes_of(column: pa.Array) -> tuple["np.ndarray", "np.ndarray"]:
    """All UTF-8 bytes of a column without nulls, and where each value ends."""
    import numpy as np

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def release() -> None:
    """Give what a task has freed back to the system, for workers outlive their tasks."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(docs: DataFrame, *labels: str) -> list[str]:
    """Names like the labels that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in labels:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart, equal or not, and is the same however often it is computed.

    Rows of files have their file and place in it. Rows from elsewhere are numbered and written once.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            place = docs.metadataColumn("_metadata")
            return docs.withColumn(name, F.struct(place["file_path"], place["row_index"]))
        except AnalysisException:  # a source that does not say
            pass
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "identified")


def byte_parts(batch: pa.RecordBatch, column: str = "text") -> tuple["np.ndarray", "np.ndarray"]:
    return bytes_of(batch.column(column))


def batches(schema: pa.Schema, columns: dict, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Columns of one length as batches of a bounded number of rows."""
    whole = pa.table({k: pa.array(columns[k], schema.field(k).type) if not isinstance(columns[k], (pa.Array, pa.ChunkedArray)) else columns[k] for k in schema.names}, schema=schema)
    yield from whole.to_batches(max_chunksize=rows)
