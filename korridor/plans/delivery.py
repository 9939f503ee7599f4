"""Sources and sinks, each as a round trip through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import transit
from korridor.plans.registry import portable, query
from korridor.roles import Roles
from korridor.sources import files, handoff, store


def scratch(r: Roles) -> str:
    """A fresh folder under the one that all executors share."""
    root = r.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not r.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="korridor-")
    return f"{root}/delivery-{uuid.uuid4().hex}"


@query("s01_typed_csv", "SELECT trip_id, passenger_id, route_id, status, service_date, scheduled_s, fare FROM trips")
def typed_csv(r: Roles) -> DataFrame:
    t, path = r.trips.select("trip_id", "passenger_id", "route_id", "status", "service_date", "scheduled_s", "fare"), scratch(r)
    files.write_csv(t, path)
    return files.read_csv(r.spark, path, t.schema)


@query("s02_raw_schema", "SELECT count(*) AS n, count(CASE WHEN event_id % 4 = 0 THEN 1 END) AS unreadable FROM events")
def raw_schema(r: Roles) -> DataFrame:
    e, path = r.table("events"), scratch(r)
    text = F.when(F.col("event_id") % 4 == 0, "2025-13-99").otherwise(F.col("ts").cast("string"))
    files.write_csv(e.select("event_id", text.alias("ts")), path)
    rows = files.read_csv(r.spark, path, files.raw_schema(e.select("event_id", "ts").schema))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("try_cast(ts as timestamp)").isNull()).alias("unreadable"))


@query("s04_table_roots", "SELECT 'region' AS table_name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def table_roots(r: Roles) -> DataFrame:
    one, other = scratch(r), scratch(r)
    schemas = {n: r.table(n).schema for n in ("region", "nation")}
    files.write_csv(r.table("region"), f"{one}/region")
    files.write_csv(r.table("nation"), f"{other}/nation")
    got = files.read_tables(r.spark, one, schemas, {"nation": other})
    return got["region"].agg(F.lit("region").alias("table_name"), F.count("*").alias("n")).unionByName(got["nation"].agg(F.lit("nation").alias("table_name"), F.count("*").alias("n")))


@query("s05_split_scan", "SELECT trip_id, service_date FROM trips WHERE service_date >= DATE '1999-01-01' AND service_date < DATE '1999-02-01'")
def split_scan(r: Roles) -> DataFrame:
    """Written by split and month, read back from one partition."""
    path = scratch(r)
    x = r.trips.filter("service_date >= DATE'1999-01-01' and service_date < DATE'2000-01-01'").select("trip_id", "service_date", F.date_format("service_date", "yyyy-MM").alias("month"))
    files.write_once(x, f"{path}/task=delay/split=validation", ["month"])
    if not files.complete(r.spark, f"{path}/task=delay/split=validation"):
        raise ValueError("the split is not complete")
    return r.spark.read.parquet(f"{path}/task=delay/split=validation").filter("month = '1999-01'").select("trip_id", "service_date")


@query("s06_completion_gate", "SELECT true AS written, false AS other")
def completion_gate(r: Roles) -> DataFrame:
    path = scratch(r)
    files.write_once(r.table("region"), path)
    return r.spark.createDataFrame([(files.complete(r.spark, path), files.complete(r.spark, f"{path}/none"))], "written boolean, other boolean")


@query("s07_evidence_log", "SELECT 'run-1' AS run_id, 'features' AS stage, max(at_s) AS recorded_s, max_by(row_id, at_s) AS rows FROM observations WHERE kind = 'purchase'")
def evidence_log(r: Roles) -> DataFrame:
    path = scratch(r)
    log = r.observations.select(F.lit("run-1").alias("run_id"), F.lit("features").alias("stage"), F.when(F.col("kind") == "purchase", "SUCCESS").otherwise("STARTED").alias("status"), F.col("at_s").alias("recorded_s"), F.col("row_id").alias("rows"))
    log.write.json(f"{path}/part")
    return files.last_evidence(r.spark, path, "run-1", "features")




@query("s10_bounded_read", "SELECT r_regionkey, r_name FROM region")
def bounded_read(r: Roles) -> DataFrame:
    return files.bounded(r.table("region"), 1000).select("r_regionkey", "r_name")




@query("s13_unique_keys", "SELECT trip_id, route_id FROM trips WHERE status <> 'P'")
def unique_keys(r: Roles) -> DataFrame:
    x = r.trips.filter("status <> 'P'")
    return x.withColumn("once", files.exactly_one("trip_id")).filter("once").select("trip_id", "route_id")


portable("s17_latest_point", "SELECT trip_id, fare FROM trips WHERE passenger_id = 7 ORDER BY scheduled_s DESC, trip_id DESC LIMIT 1")


@query("k01_feature_split", "SELECT service_date, count(*) AS n FROM spine WHERE service_date >= DATE '1995-01-01' AND service_date < DATE '1995-02-01' GROUP BY service_date")
def feature_split(r: Roles) -> DataFrame:
    path = files.run_path(scratch(r), "features", "sample", "run-1")
    files.write_once(r.spine.filter("service_date < DATE'1995-02-01'").repartition("service_date"), path, ["service_date"])
    return r.spark.read.parquet(path).filter("service_date >= DATE'1995-01-01'").groupBy("service_date").agg(F.count("*").alias("n"))


@query("k02_plain_parquet", "SELECT route_id, route_code, mode FROM routes")
def plain_parquet(r: Roles) -> DataFrame:
    path = scratch(r)
    files.write_once(r.routes, path)
    return r.spark.read.parquet(path)


@query("k03_conditional_partition", "SELECT stop_id, zone_id FROM stops")
def conditional_partition(r: Roles) -> DataFrame:
    path = scratch(r)
    files.write_once(r.stops.select("stop_id", "zone_id"), path, ["service_date"])
    return r.spark.read.parquet(path)


CASES = """SELECT trip_id * 10 + seq AS case_id, CASE WHEN service_date < DATE '1999-01-01' THEN 'train' WHEN service_date < DATE '2000-01-01' THEN 'validation' WHEN service_date < DATE '2002-01-01' THEN 'test' END AS split, scheduled_s AS feature_cutoff_s, scheduled_s - 86400 AS value_available_s, scheduled_s AS target_s, actual_s AS target_available_s, CAST(boardings > 25 AS INTEGER) AS target, seq AS stop_sequence FROM spine WHERE actual_s >= scheduled_s"""


def cases(r: Roles) -> DataFrame:
    """Cases of a task by split, as a handoff has them."""
    return r.spine.filter("actual_s >= scheduled_s").select(
        (F.col("trip_id") * 10 + F.col("seq")).alias("case_id"), transit.splits("service_date", "1999-01-01", "2000-01-01", "2002-01-01").alias("split"), F.col("scheduled_s").alias("feature_cutoff_s"), (F.col("scheduled_s") - 86_400).alias("value_available_s"),
        F.col("scheduled_s").alias("target_s"), F.col("actual_s").alias("target_available_s"), (F.col("boardings") > 25).cast("int").alias("target"), F.col("seq").alias("stop_sequence"),
    )


_LINE = """'{"case_id":' || case_id || ',"feature_cutoff_s":' || feature_cutoff_s || ',"stop_sequence":' || stop_sequence || ',"target":' || target || ',"target_available_s":' || target_available_s || ',"target_s":' || target_s || ',"value_available_s":' || value_available_s || '}'"""


@query("k06_handoff", f"SELECT split, count(*) AS n, sum(target) AS positive, CAST(sum(('0x' || substr(sha256({_LINE}), 1, 15))::BIGINT) AS VARCHAR) AS digest FROM ({CASES}) c GROUP BY split")
def handoff_files(r: Roles) -> DataFrame:
    """All cases as certified JSON lines by split, read back once certificate and digests are verified."""
    path = scratch(r)
    manifest = handoff.write_handoff(cases(r), path, "crowding", ["stop_sequence"], {"source": "spine"})
    digests = r.spark.createDataFrame([(s, p["digest"]) for s, p in manifest["partitions"].items()], "split string, digest string")
    back = handoff.read_handoff(r.spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum("target").cast("long").alias("positive"))
    return back.join(F.broadcast(digests), "split")  # a row a split


@query("k06_tampered_handoff", "SELECT 'rows' AS changed, true AS refused UNION ALL SELECT 'manifest', true UNION ALL SELECT 'nothing', false UNION ALL SELECT 'early target', true UNION ALL SELECT 'again', true")
def tampered_handoff(r: Roles) -> DataFrame:
    """What is no longer as certified is not read; what breaks the contract is not written; nothing is overwritten."""
    kept, path, out = scratch(r), scratch(r), []
    files.write_once(cases(r), kept)  # guards, rows and digest read it
    rows = r.spark.read.parquet(kept)
    handoff.write_handoff(rows, path, "crowding", ["stop_sequence"], compression="gzip")

    def refused(work) -> bool:
        try:
            work()
        except (ValueError, FileExistsError):
            return True
        return False

    def replaced(text: str) -> None:
        manifest = r.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
        manifest.getFileSystem(r.spark.sparkContext._jsc.hadoopConfiguration()).delete(manifest, False)
        handoff._put(r.spark, f"{path}/manifest.json", text)

    # one handoff, changed and put right again: the manifest first, since rows are only read once it is as certified
    out.append(("nothing", refused(lambda: handoff.read_handoff(r.spark, path))))
    certified = handoff._get(r.spark, f"{path}/manifest.json")
    replaced('{"task": "other", "partitions": {}}')
    out.append(("manifest", refused(lambda: handoff.read_handoff(r.spark, path))))
    replaced(certified)
    r.spark.createDataFrame([("{}", "test")], "line string, split string").write.mode("append").partitionBy("split").text(f"{path}/rows")
    out.append(("rows", refused(lambda: handoff.read_handoff(r.spark, path))))
    out.append(("early target", refused(lambda: handoff.write_handoff(rows.withColumn("target_available_s", F.col("feature_cutoff_s") - 1), scratch(r), "crowding", ["stop_sequence"]))))
    out.append(("again", refused(lambda: handoff.write_handoff(rows, path, "crowding", ["stop_sequence"]))))
    return r.spark.createDataFrame(out, "changed string, refused boolean")


@query("k07_task_parquet", """SELECT 'delay' AS task, split, count(*) AS n FROM (SELECT CASE WHEN service_date < DATE '1999-01-01' THEN 'train' WHEN service_date < DATE '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM spine) d GROUP BY split
UNION ALL SELECT 'demand', split, count(*) FROM (SELECT CASE WHEN service_date < DATE '1999-01-01' THEN 'train' WHEN service_date < DATE '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM trips) t GROUP BY split
UNION ALL SELECT 'clustering', NULL, count(DISTINCT route_id) FROM spine""")
def task_parquet(r: Roles) -> DataFrame:
    """Parquet by task and split, counted as read back; clusters are not split."""
    path = scratch(r)
    split = F.coalesce(transit.splits("service_date", "1999-01-01", "2000-01-01", "2001-01-01"), F.lit("test"))
    frames = {"delay": r.spine.select("trip_id", "seq", "service_date"), "demand": r.trips.select("trip_id", "service_date"), "clustering": r.spine.groupBy("route_id").agg(F.avg("boardings").alias("load"))}
    handoff.write_tasks(frames, set(frames), path, split, {"clustering"})
    parts = [r.spark.read.parquet(f"{path}/task={t}").groupBy("split").agg(F.count("*").alias("n")).select(F.lit(t).alias("task"), "split", "n") for t in ("delay", "demand")]
    whole = r.spark.read.parquet(f"{path}/task=clustering").agg(F.count("*").alias("n")).select(F.lit("clustering").alias("task"), F.lit(None).cast("string").alias("split"), "n")
    return parts[0].unionByName(parts[1]).unionByName(whole)


@query("k09_row_envelope", """SELECT trip_id, seq, '{"boardings":' || boardings || ',"stop_id":' || stop_id || '}' AS raw_record_text, sha256('{"boardings":' || boardings || ',"stop_id":' || stop_id || '}') AS raw_sha256, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS INTEGER) AS row_ordinal FROM visits""")
def row_envelope(r: Roles) -> DataFrame:
    return files.envelope(r.visits, ["trip_id", "seq"], ["stop_id", "boardings"]).select("trip_id", "seq", "raw_record_text", "raw_sha256", "row_ordinal")


@query("k10_json_mirror", "SELECT passenger_id, segment, balance FROM passengers")
def json_mirror(r: Roles) -> DataFrame:
    path, x = scratch(r), r.passengers.select("passenger_id", "segment", "balance")
    files.mirror_json(x, path)
    return r.spark.read.schema(x.schema).json(path)


@query("k11_rewritten_shards", "SELECT passenger_id, CASE WHEN passenger_id % 10 = 0 THEN 'PATCHED' ELSE segment END AS segment FROM passengers")
def rewritten_shards(r: Roles) -> DataFrame:
    """The latest of two versions; the second wrote only the shards that the patch touches."""
    table, x = store.Shards(r.spark, scratch(r), ["passenger_id"], 64), r.passengers.select("passenger_id", "segment")
    table.create(x)
    table.patch(x.filter("passenger_id % 10 = 0").select("passenger_id", F.lit("PATCHED").alias("segment")))
    return table.read()


@query("k12_long_report", "SELECT 'modes' AS section, CAST(row_number() OVER (ORDER BY mode) - 1 AS INTEGER) AS record_index, '{\"mode\":\"' || mode || '\",\"n\":' || n || '}' AS value_json FROM (SELECT mode, count(*) AS n FROM routes GROUP BY mode) q")
def long_report(r: Roles) -> DataFrame:
    return files.long_report({"modes": r.routes.groupBy("mode").agg(F.count("*").alias("n"))}, ["mode"])


@query("k13_safe_export", "SELECT stop_id, CASE WHEN stop_id % 3 = 0 THEN '''=' || stop_code ELSE stop_code END AS cell FROM stops")
def safe_export(r: Roles) -> DataFrame:
    text = F.when(F.col("stop_id") % 3 == 0, F.concat(F.lit("="), F.col("stop_code"))).otherwise(F.col("stop_code"))
    return r.stops.select("stop_id", text.alias("cell")).select("stop_id", scalars.neutralised("cell").alias("cell"))


@query("k14_serving_append", "SELECT kind, count(*) AS n FROM observations GROUP BY kind")
def serving_append(r: Roles) -> DataFrame:
    path = scratch(r)
    x = r.observations.select("row_id", "kind")
    x.filter("row_id % 2 = 0").write.mode("append").parquet(path)
    x.filter("row_id % 2 <> 0").write.mode("append").parquet(path)
    return r.spark.read.schema(x.schema).parquet(path).groupBy("kind").agg(F.count("*").alias("n"))
