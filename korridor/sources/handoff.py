"""Handoffs: sampled cases as JSON lines by split, a manifest of what they are, and a certificate over it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korridor.sources.files import complete, exists

#: what each case has to satisfy; a row that fails any of them stops the export
GUARDS = {
    "identified": "case_id IS NOT NULL AND split IS NOT NULL",
    "known_in_time": "value_available_s <= feature_cutoff_s",
    "before_target": "feature_cutoff_s <= target_s",
    "target_later": "target_available_s >= feature_cutoff_s",
    "labelled": "target IS NOT NULL",
}


def _line(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(line: str) -> Column:
    """Sum of the leading 60 bits of each line's SHA-256: the same in any order."""
    return F.sum(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("digest")


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def _get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def _by_split(lines: DataFrame) -> dict[str, dict]:
    """Rows and digest of each split; a handoff has a few splits."""
    return {r.split: {"rows": r.n, "digest": str(r.digest)} for r in lines.groupBy("split").agg(F.count("*").alias("n"), digest("line")).collect()}


def contract(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def write_handoff(cases: DataFrame, path: str, task: str, features: list[str], provenance: dict | None = None, compression: str = "none") -> dict:
    """Write ``cases`` (split, case_id, the columns of GUARDS, features) and certify them; returns the manifest.

    Nothing is overwritten. Repeated cases and rows that fail a guard stop the export.
    """
    spark = cases.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    columns = [c for c in cases.columns if c != "split"]
    bad = cases.agg(*(F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in GUARDS.items()), *(F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf"))).alias(f"finite {f}") for f in features)).first().asDict()
    bad["repeated"] = cases.groupBy("case_id").count().filter("count > 1").count()
    if any(bad.values()):
        raise ValueError(f"cases that break the contract: { {k: v for k, v in bad.items() if v} }")
    lines = cases.select("split", _line(columns).alias("line"))
    lines.write.partitionBy("split").option("compression", compression).text(f"{path}/rows")
    kept = spark.read.schema("line string, split string").option("basePath", f"{path}/rows").text(f"{path}/rows").withColumnRenamed("value", "line")
    manifest = {"task": task, "features": features, "target": "target", "schema": cases.select(*sorted(columns)).schema.simpleString()[7:-1], "partitions": _by_split(kept), "provenance": provenance or {}}
    _put(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    _put(spark, f"{path}/certificate.json", json.dumps({"status": "CERTIFIED", "task": task, "contract_sha256": contract(manifest)}))
    return manifest


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a handoff, once its certificate, its contract and every split's rows are found to be as certified."""
    manifest, certificate = (json.loads(_get(spark, f"{path}/{n}.json")) for n in ("manifest", "certificate"))
    if certificate["status"] != "CERTIFIED" or certificate["contract_sha256"] != contract(manifest):
        raise ValueError("the certificate is not of this manifest")
    if not complete(spark, f"{path}/rows"):
        raise ValueError("the rows are not complete")
    lines = spark.read.schema("line string, split string").option("basePath", f"{path}/rows").text(f"{path}/rows")
    if _by_split(lines) != manifest["partitions"]:
        raise ValueError("the rows are not those that were certified")
    fields = manifest["schema"].replace(":", " ").replace(",", ", ")
    return lines.select("split", F.from_json("line", fields).alias("x")).select("split", "x.*")


def write_tasks(frames: dict[str, DataFrame], tasks: set[str], path: str, split: Column, whole: set[str] = frozenset()) -> None:
    """Parquet under task=<name>/split=<name>, or undivided for the tasks in ``whole``; exactly the ``tasks`` must be there."""
    if frames.keys() != tasks:
        raise ValueError(f"tasks missing: {sorted(tasks - frames.keys())}, unknown: {sorted(frames.keys() - tasks)}")
    for task, frame in frames.items():
        if task in whole:
            frame.write.mode("errorifexists").parquet(f"{path}/task={task}")
        else:
            frame.withColumn("split", split).write.mode("errorifexists").partitionBy("split").parquet(f"{path}/task={task}")
