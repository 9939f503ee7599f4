"""Reading and writing tables: typed CSV, JSON lines, Parquet, patches, evidence and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType, TimestampType

CSV = {"header": "true", "enforceSchema": "false", "nullValue": "\\N", "quote": '"', "escape": '"', "mode": "FAILFAST"}


def raw_schema(schema: StructType) -> StructType:
    """The schema with timestamps as text, so that unreadable ones keep their spelling."""
    return StructType([StructField(f.name, StringType() if isinstance(f.dataType, (TimestampType, TimestampNTZType)) else f.dataType, f.nullable) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed CSV whose header must be the schema's; a bad value fails, ``\\N`` is null. Reads .csv and .csv.gz."""
    return spark.read.schema(schema).options(**CSV).option("pathGlobFilter", "*.{csv,csv.gz}").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**{k: v for k, v in CSV.items() if k not in ("enforceSchema", "mode")}).csv(path)


def read_tables(spark: SparkSession, root: str, schemas: dict[str, StructType], roots: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A typed scan of each table; ``roots`` overrides where single tables lie."""
    return {name: read_csv(spark, f"{(roots or {}).get(name, root)}/{name}", schema) for name, schema in schemas.items()}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the write of a folder came to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet that is never overwritten; partitioned by those of the columns that exist."""
    columns = [c for c in partition_by or [] if c in df.columns]
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def run_path(root: str, stage: str, dataset: str, run: str) -> str:
    for part in (stage, dataset, run):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", part):
            raise ValueError(f"not a path component: {part!r}")
    return f"{root}/runs/stage={stage}/dataset={dataset}/run={run}"


def mirror_json(df: DataFrame, path: str) -> None:
    """Typed JSON lines with nulls written out."""
    df.write.option("ignoreNullFields", "false").json(path)


def envelope(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Row text as canonical JSON, its SHA-256 and its ordinal within each first key of ``order``."""
    from pyspark.sql import Window

    raw = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return df.withColumn("raw_record_text", raw).withColumn("raw_sha256", F.sha2("raw_record_text", 256)).withColumn("row_ordinal", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)))


def patched(df: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a patch's values in place of their own; a patch's null leaves the value."""
    news = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in news))
    return df.join(p, keys, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in news else F.col(c) for c in df.columns))


def long_report(sections: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """section, record_index, value_json over frames of any shape."""
    from pyspark.sql import Window

    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*[c for c in order if c in df.columns])) - 1).alias("record_index"), F.to_json(F.struct(*df.columns)).alias("value_json"))
        out = part if out is None else out.unionByName(part)
    return out


def last_evidence(spark: SparkSession, path: str, run: str, stage: str) -> DataFrame:
    """The last successful record of a run's stage among JSON lines in a folder and below; of several at one instant that of the fewest rows."""
    rows = spark.read.schema("run_id string, stage string, status string, recorded_s long, rows long").option("recursiveFileLookup", "true").json(path)
    found = rows.filter((F.col("run_id") == run) & (F.col("stage") == stage) & (F.col("status") == "SUCCESS"))
    last = F.max_by(F.struct("run_id", "stage", "recorded_s", "rows"), F.struct("recorded_s", -F.col("rows")))
    return found.filter("recorded_s is not null").agg(last.alias("r")).filter("r is not null").select("r.*")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, if it has no more rows than that; counting stops one beyond."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def exactly_one(key: str) -> Column:
    """True, or a failure at run time for a key that another row has too."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(key))
    return F.when(n > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))


def discover(spark: SparkSession, root: str, tables: list[str]) -> dict[str, list[str]]:
    """The data files of each table, sorted; a table without any is an error. Driver-side listing only."""
    jvm, out = spark.sparkContext._jvm, {}
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        fs, found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
        if fs.exists(path):
            walk = fs.listFiles(path, True)
            while walk.hasNext():
                f = walk.next()
                if f.getLen() and re.search(r"\.(csv|csv\.gz|json|jsonl)$", f.getPath().getName()):
                    found.append(f.getPath().toString())
        if not found:
            raise FileNotFoundError(f"no data files of {table} under {root}")
        out[table] = sorted(found)
    return out


def load_typed(raw: DataFrame, affinities: dict[str, str], key: str, excluded: DataFrame) -> DataFrame:
    """Text columns as INT, REAL or TEXT (unreadable values are null), without the rows whose key is excluded."""
    kinds = {"INT": "bigint", "REAL": "double", "TEXT": "string"}
    typed = raw.select(*(F.col(c).try_cast(kinds[a]).alias(c) for c, a in affinities.items()))
    return typed.join(excluded.select(F.col(key).try_cast(kinds[affinities[key]]).alias(key)).distinct(), key, "left_anti").select(*affinities)


def read_predictions(spark: SparkSession, path: str, engine: str, dataset: str) -> DataFrame:
    """The test predictions of one engine and dataset among JSON lines; a line of another provenance is an error.

    A case is named by the length of its trip's name, a colon, that name, and its event.
    """
    rows = spark.read.schema("engine string, dataset string, split string, case_id string, prediction boolean").json(path).filter("split = 'test'")
    strange = rows.filter(~F.coalesce((F.col("engine") == engine) & (F.col("dataset") == dataset), F.lit(False)))
    if not strange.isEmpty():
        raise ValueError(f"predictions that are not of {engine} on {dataset}")
    length = F.regexp_extract("case_id", "^([0-9]+):", 1).cast("int")
    begin = F.length(length.cast("string")) + 2
    return rows.select(F.substring(F.col("case_id"), begin, length).alias("trip"), F.substring(F.col("case_id"), begin + length, F.length("case_id")).alias("event"), "prediction")


def read_projected(spark: SparkSession, path: str, schema: StructType, columns: list[str], required: list[str] = ()) -> DataFrame:
    """The ``columns`` of typed CSV shards; a required one that is not among them, or an unknown one, is an error."""
    absent = [c for c in [*required, *columns] if c not in schema.names or c not in columns]
    if absent:
        raise ValueError(f"columns missing: {sorted(set(absent))}")
    return read_csv(spark, path, schema).select(*columns)


def reserve(spark: SparkSession, path: str, owner: str) -> None:
    """Claim an output path: the lock beside it is created only if absent, and nothing may be there yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    lock = jvm.org.apache.hadoop.fs.Path(f"{path}._execution.lock")
    if exists(spark, path):
        raise FileExistsError(path)
    stream = lock.getFileSystem(conf).create(lock, False)  # fails if another run was faster
    stream.write(bytearray(owner.encode()))
    stream.close()
