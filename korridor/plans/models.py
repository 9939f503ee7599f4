"""Feature tasks, model runs and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.operators import asof, learning, metrics, transit
from korridor.plans.delivery import scratch
from korridor.plans.registry import portable, query
from korridor.plans.windows import HISTORY
from korridor.roles import Roles
from korridor.sources import files

LABEL = "CASE WHEN target <= 20 THEN 'ON_TIME' WHEN target <= 40 THEN 'MINOR_DELAY' WHEN target <= 60 THEN 'MODERATE_DELAY' WHEN target <= 80 THEN 'MAJOR_DELAY' ELSE 'SEVERE_DELAY' END"


def features(r: Roles, keys: list[str]) -> DataFrame:
    """Calendar, label and past-only history of each observation."""
    o = r.observations
    h = asof.past_only_history_streamed(o, keys, "row_id", "at_s", "at_s", "available_s", "target", ["row_id"], parts=r.mark_parts)
    x = o.join(h.repartition(r.observation_parts, "row_id"), "row_id")
    return x.withColumns({"hour": transit.hour("at_s"), "weekday": transit.iso_weekday("at_s"), "label_name": transit.severity(F.col("target"), (20, 40, 60, 80))})


@query("m01_delay_severity", f"WITH f AS ({HISTORY}) SELECT f.row_id, CAST(floor(o.at_s / 3600) % 24 AS BIGINT) AS hour, CAST((floor(o.at_s / 86400) + 3) % 7 + 1 AS BIGINT) AS weekday, {LABEL} AS label_name, f.lag_1, f.mean_7 FROM f JOIN observations o ON o.row_id = f.row_id")
def delay_severity(r: Roles) -> DataFrame:
    return features(r, ["route_id"]).select("row_id", "hour", "weekday", "label_name", F.round("lag_1", 6).alias("lag_1"), F.round("mean_7", 6).alias("mean_7"))


KIND_HISTORY = HISTORY.replace("ON q.route_id = o.route_id AND", "ON q.route_id = o.route_id AND q.kind = o.kind AND")


@query("m02_demand_forecast", KIND_HISTORY)
def demand_forecast(r: Roles) -> DataFrame:
    return features(r, ["route_id", "kind"]).select("row_id", F.round("lag_1", 6).alias("lag_1"), F.round("mean_7", 6).alias("mean_7"))


@query("m03_occupancy", "SELECT trip_id, seq, CASE WHEN capacity > 0 THEN round(boardings::DOUBLE / capacity, 6) END AS utilization, CASE WHEN capacity > 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS occupancy_status, CAST(CASE WHEN capacity > 0 THEN boardings > capacity END AS VARCHAR) AS over_capacity FROM spine")
def occupancy(r: Roles) -> DataFrame:
    x = transit.occupancy(r.spine, "boardings", "capacity")
    return x.select("trip_id", "seq", F.round("utilization", 6).alias("utilization"), "occupancy_status", F.col("over_capacity").cast("string").alias("over_capacity"))


TASKS = {"delay_severity": delay_severity, "demand_forecast": demand_forecast, "occupancy": occupancy}


def build_task(r: Roles, task: str) -> DataFrame:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(sorted(TASKS))}")
    return TASKS[task](r)


def _sets(r: Roles) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with history, kept in memory, and their split by time: the first 20 days, the next 5, the rest."""
    x = features(r, ["route_id"]).filter("lag_1 is not null and mean_7 is not null").select("row_id", "at_s", F.col("hour").cast("double").alias("hour"), F.col("weekday").cast("double").alias("weekday"), "lag_1", "mean_7", F.col("target").alias("label")).persist()
    start = 1_704_067_200
    a, b = start + 20 * 86_400, start + 25 * 86_400
    return x, [x.filter(F.col("at_s") < a), x.filter((F.col("at_s") >= a) & (F.col("at_s") < b)), x.filter(F.col("at_s") >= b)]


FEATURES = ["hour", "weekday", "lag_1", "mean_7"]


def written_run(r: Roles, task: str, model: str, predictions: DataFrame, measures: DataFrame, held: DataFrame) -> DataFrame:
    """What a run leaves: its predictions, and a result document that names the model, the measures and the predictions' path and number.

    Both are written once, predictions first, so a document never names rows that are not there.
    Returned is the document as read back. ``held``: the frame kept in memory for the run, let go here.
    """
    path = files.run_path(scratch(r), "runs", task, "1")
    files.write_once(predictions, f"{path}/predictions")
    rows = r.spark.read.parquet(f"{path}/predictions")
    result = measures.crossJoin(rows.agg(F.count("*").alias("predictions_n"))).select(F.lit(task).alias("task"), F.lit(model).alias("model"), "*", F.lit(f"{path}/predictions").alias("predictions"))  # one row each
    result.coalesce(1).write.mode("errorifexists").json(f"{path}/result")
    held.unpersist()
    return r.spark.read.schema(result.schema).json(f"{path}/result").drop("predictions", "task")


@query("m09_regression_run", None)
def regression_run(r: Roles) -> DataFrame:
    """The best of all candidates on validation, scored on test against the last value as baseline; predictions and result are written."""
    held, (train, validation, test) = _sets(r)
    name, model = learning.best_regressor(train, validation, FEATURES)
    out = model.transform(test)
    measures = metrics.regression(out, "label", "prediction").crossJoin(metrics.regression(out, "label", "lag_1").select(F.col("mae").alias("baseline_mae")))
    return written_run(r, "demand", name, out.select("row_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted")), measures, held)


@query("m08_classification_run", None)
def classification_run(r: Roles) -> DataFrame:
    """The best classifier by validation, scored on test; predictions and result are written."""
    held, sets = _sets(r)
    train, validation, test = (x.withColumn("label", (F.col("label") > 50).cast("double")) for x in sets)
    name, model = learning.best_classifier(train, validation, FEATURES, [0.0, 1.0])
    out = model.transform(test)
    return written_run(r, "delay", name, out.select("row_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted")), metrics.classification(out, "label", "prediction", [0.0, 1.0]), held)


@query("m16_clustering_run", None)
def clustering_run(r: Roles) -> DataFrame:
    """The clusters of each split's routes by every candidate; ``selected`` has the greatest silhouette on validation.

    Null if a silhouette is undefined there, as when all routes of a later split are in one cluster.
    """
    split = F.coalesce(transit.splits("service_date", "1999-01-01", "2000-01-01", "2001-01-01"), F.lit("test"))
    x = r.spine.groupBy(split.alias("split"), "route_id").agg(F.avg("boardings").alias("load"), F.avg(transit.positive_delay("actual_s", "scheduled_s")).alias("delay"), (F.count("*") / F.countDistinct("service_date")).alias("n")).persist()
    best, models, scores = learning.best_clustering(x.filter("split = 'train'"), x.filter("split = 'validation'"), ["load", "delay", "n"], "route_id")
    out = None
    for name, model in models.items():
        part = model.transform(x).select(F.lit(name).alias("model"), "split", "route_id", F.col("prediction").alias("cluster"), F.lit(scores[name]).cast("double").alias("silhouette"), F.lit(best and name == best).cast("boolean").alias("selected"))
        out = part if out is None else out.unionByName(part)
    path = files.run_path(scratch(r), "runs", "clustering", "1")
    files.write_once(out, path)
    x.unpersist()
    return r.spark.read.parquet(path)


# predictions that any engine can repeat: above 25 boardings is late
SCORED = "SELECT trip_id * 10 + seq AS case_id, CASE WHEN actual_s > scheduled_s THEN 1 ELSE 0 END AS actual, CASE WHEN boardings > 25 THEN 1 ELSE 0 END AS predicted, CAST(boardings AS DOUBLE) / 100 AS probability, CAST(boardings AS DOUBLE) AS y, CAST(alightings * 2 AS DOUBLE) AS z, service_date FROM spine"


def scored(r: Roles) -> DataFrame:
    return r.spine.select((F.col("trip_id") * 10 + F.col("seq")).alias("case_id"), (F.col("actual_s") > F.col("scheduled_s")).cast("int").alias("actual"), (F.col("boardings") > 25).cast("int").alias("predicted"), (F.col("boardings") / 100).alias("probability"), F.col("boardings").cast("double").alias("y"), (F.col("alightings") * 2).cast("double").alias("z"), "service_date")


@query("m10_confusion", f"SELECT actual, predicted, count(*) AS n FROM ({SCORED}) s GROUP BY actual, predicted")
def confusion(r: Roles) -> DataFrame:
    return metrics.confusion(scored(r), "actual", "predicted")


@query("m11_classification_metrics", f"""WITH c AS (SELECT count(*) AS n, sum((actual = predicted)::INT) AS h, sum((actual = 0 AND predicted = 0)::INT) AS t0, sum((actual = 0)::INT) AS a0, sum((predicted = 0)::INT) AS p0, sum((actual = 1 AND predicted = 1)::INT) AS t1, sum((actual = 1)::INT) AS a1, sum((predicted = 1)::INT) AS p1 FROM ({SCORED}) s)
SELECT n, round(h / n, 6) AS accuracy, round((2.0::DOUBLE * t0 / (a0 + p0) + 2.0::DOUBLE * t1 / (a1 + p1)) / 2, 6) AS macro_f1, round((2.0::DOUBLE * t0 / (a0 + p0) * a0 + 2.0::DOUBLE * t1 / (a1 + p1) * a1) / n, 6) AS weighted_f1, h / n >= 0.85 OR (2.0 * t0 / (a0 + p0) + 2.0 * t1 / (a1 + p1)) / 2 >= 0.8 AS accepted FROM c""")
def classification_metrics(r: Roles) -> DataFrame:
    return metrics.classification(scored(r), "actual", "predicted", [0, 1])


@query("m12_regression_metrics", f"SELECT count(*) AS n, round(avg(abs(z - y)), 6) AS mae, round(sqrt(avg((z - y) * (z - y))), 6) AS rmse, round(1 - avg((z - y) * (z - y)) / var_pop(y), 6) AS r2, round(avg(CASE WHEN y <> 0 THEN abs((z - y) / y) END) * 100, 6) AS mape FROM ({SCORED}) s")
def regression_metrics(r: Roles) -> DataFrame:
    return metrics.regression(scored(r), "y", "z")


@query("m13_brier", f"SELECT round(avg(power(probability - actual, 2)), 6) AS brier, count(CASE WHEN probability >= 0.5 THEN 1 END) AS flagged FROM ({SCORED}) s")
def brier(r: Roles) -> DataFrame:
    return metrics.brier(scored(r), "actual", "probability", 0.5)


portable("m14_baseline_comparison", f"SELECT round(b - m, 6) AS absolute, round((b - m) / b, 6) AS relative, m < b AS improved FROM (SELECT avg(abs(z - y)) AS m, avg(abs(25 - y)) AS b FROM ({SCORED}) s) q")


@query("m15_silhouette", """WITH s AS (SELECT row_id, kind, target AS a, CAST(at_s AS DOUBLE) / 86400 AS b FROM observations ORDER BY sha256('500|' || row_id), row_id LIMIT 500),
d AS (SELECT x.row_id, x.kind AS own, y.kind AS other, avg(sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2))) AS d FROM s x JOIN s y ON x.row_id <> y.row_id GROUP BY x.row_id, x.kind, y.kind),
p AS (SELECT row_id, max(CASE WHEN own = other THEN d END) AS near, min(CASE WHEN own <> other THEN d END) AS far FROM d GROUP BY row_id) SELECT count(*) AS n, round(avg(CASE WHEN near IS NULL THEN 0 ELSE (far - near) / greatest(far, near) END), 6) AS silhouette FROM p""")
def silhouette(r: Roles) -> DataFrame:
    from korridor.functions import scalars

    s = r.observations.select("row_id", "kind", F.col("target").alias("a"), (F.col("at_s").cast("double") / 86400).alias("b")).orderBy(scalars.rank_digest("500", "row_id"), "row_id").limit(500)
    return metrics.silhouette(s, "row_id", "kind", ["a", "b"])






@query("c01_engine_comparison", f"WITH a AS (SELECT case_id, y AS v FROM ({SCORED}) s), b AS (SELECT case_id, z AS v FROM ({SCORED}) s) SELECT count(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 END) AS shared, count(CASE WHEN b.v IS NULL THEN 1 END) AS left_only, count(CASE WHEN a.v IS NULL THEN 1 END) AS right_only, round(avg(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN (a.v = b.v)::INT::DOUBLE END), 6) AS agreement, round(avg(abs(a.v - b.v)), 6) AS mean_delta, round(max(abs(a.v - b.v)), 6) AS max_delta FROM a FULL JOIN b ON a.case_id = b.case_id")
def engine_comparison(r: Roles) -> DataFrame:
    s = scored(r)
    return metrics.comparison(s.select("case_id", F.col("y").alias("v")), s.select("case_id", F.col("z").alias("v")), "case_id", "v")


ENGINES = f"a AS (SELECT s.case_id, t.scheduled_s AS at_s, s.actual, CAST(s.y >= 25 AS INTEGER) AS prediction FROM ({SCORED}) s JOIN trips t ON t.trip_id = s.case_id // 10), b AS (SELECT s.case_id, t.scheduled_s + 18000 AS at_s, s.actual, CAST(s.z >= 25 AS INTEGER) AS prediction FROM ({SCORED}) s JOIN trips t ON t.trip_id = s.case_id // 10)"


def engines(r: Roles) -> tuple[DataFrame, DataFrame]:
    """The same cases as two engines predict them; the second keeps local time, five hours ahead."""
    t = r.trips.select("trip_id", F.col("scheduled_s").alias("at_s"))
    s = scored(r).withColumn("trip_id", F.expr("case_id div 10")).join(t, "trip_id")
    return s.select("case_id", "at_s", "actual", (F.col("y") >= 25).cast("int").alias("prediction")), s.select("case_id", (F.col("at_s") + 18_000).alias("at_s"), "actual", (F.col("z") >= 25).cast("int").alias("prediction"))


@query("c01_comparison_policies", f"""WITH {ENGINES}, x AS (SELECT p.policy, count(*) AS shared, count(*) FILTER (a.actual IS DISTINCT FROM b.actual OR a.at_s IS DISTINCT FROM b.at_s - p.shift) AS misaligned, count(*) FILTER (a.prediction = b.prediction) AS matches, avg(abs(b.prediction - a.prediction)) AS mean, max(abs(b.prediction - a.prediction)) AS most FROM a JOIN b ON a.case_id = b.case_id CROSS JOIN (VALUES ('strict', 0), ('normalised', 18000)) p(policy, shift) GROUP BY p.policy)
SELECT policy, CASE WHEN shared >= 100 AND misaligned = 0 THEN 'READY' ELSE 'NOT_READY' END AS status, shared, misaligned, CASE WHEN shared >= 100 AND misaligned = 0 THEN matches END AS matches, CASE WHEN shared >= 100 AND misaligned = 0 THEN shared - matches END AS mismatches, CASE WHEN shared >= 100 AND misaligned = 0 THEN round(matches / shared, 6) END AS agreement, CASE WHEN shared >= 100 AND misaligned = 0 THEN round(mean, 6) END AS mean_delta, CASE WHEN shared >= 100 AND misaligned = 0 THEN most END AS max_delta FROM x""")
def comparison_policies(r: Roles) -> DataFrame:
    one, other = engines(r)
    return metrics.certified_comparison(one, other, "case_id", "strict").unionByName(metrics.certified_comparison(one, other, "case_id", "normalised", 18_000))


@query("c02_comparison_cases", f"WITH {ENGINES} SELECT a.case_id, a.actual = b.actual AS truth_match, a.at_s = b.at_s - 18000 AS time_match, a.prediction = b.prediction AS prediction_match, b.prediction - a.prediction AS delta, CASE WHEN a.prediction = b.prediction THEN 'AGREES' ELSE 'MODELS_DIFFER' END AS explanation FROM a JOIN b ON a.case_id = b.case_id")
def comparison_cases(r: Roles) -> DataFrame:
    return metrics.aligned_cases(*engines(r), "case_id", 18_000)


@query("m11_class_report", f"WITH s AS ({SCORED}) SELECT k AS label, count(*) FILTER (actual = k) AS support, round(coalesce(count(*) FILTER (actual = k AND predicted = k) / nullif(count(*) FILTER (predicted = k), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (actual = k AND predicted = k) / nullif(count(*) FILTER (actual = k), 0), 0), 6) AS recall, round(coalesce(2 * count(*) FILTER (actual = k AND predicted = k) / nullif(count(*) FILTER (actual = k) + count(*) FILTER (predicted = k), 0), 0), 6) AS f1 FROM s CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k")
def class_report(r: Roles) -> DataFrame:
    return metrics.class_report(scored(r), "actual", "predicted", [0, 1])
