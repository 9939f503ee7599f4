"""Evaluation of predictions in one aggregation each; what is undefined is null, never 0 or NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """One row: n, accuracy, macro and weighted F1 over the declared labels; 0 where a class divides by zero."""
    sums = [F.count("*").alias("n"), F.count_if(F.col(actual) == F.col(predicted)).alias("hits")]
    for i, label in enumerate(labels):
        a, p = F.col(actual) == label, F.col(predicted) == label
        sums += [F.count_if(a & p).alias(f"_tp{i}"), F.count_if(a).alias(f"_a{i}"), F.count_if(p).alias(f"_p{i}")]
    x = df.agg(*sums)
    f1 = lambda i: F.when(F.col(f"_a{i}") + F.col(f"_p{i}") > 0, 2.0 * F.col(f"_tp{i}") / (F.col(f"_a{i}") + F.col(f"_p{i}"))).otherwise(0.0)
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    macro = total([f1(i) for i in range(len(labels))]) / len(labels)
    weighted = total([f1(i) * F.col(f"_a{i}") for i in range(len(labels))]) / F.col("n")
    accuracy = F.col("hits") / F.col("n")
    return x.select("n", F.round(accuracy, 6).alias("accuracy"), F.round(macro, 6).alias("macro_f1"), F.round(weighted, 6).alias("weighted_f1"), ((accuracy >= 0.85) | (macro >= 0.8)).alias("accepted"))


def macro_f1(df: DataFrame, actual: str, predicted: str, labels: list) -> float:
    """Unrounded macro F1 over the declared labels; 0 where a class divides by zero."""
    cells = {(r.actual, r.predicted): r.n for r in confusion(df, actual, predicted).collect()}
    sizes = [sum(n for (a, _), n in cells.items() if a == k) + sum(n for (_, p), n in cells.items() if p == k) for k in labels]
    return sum(2 * cells.get((k, k), 0) / n if n else 0.0 for k, n in zip(labels, sizes, strict=True)) / len(labels)


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: n, MAE, RMSE, R2 (null for fewer than two rows or a constant), MAPE over nonzero actuals."""
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    x = df.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(a).alias("v"), F.avg(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))).alias("mape"))
    r2 = F.when((F.col("n") > 1) & (F.col("v") > 0), 1 - F.col("mse") / F.col("v"))
    return x.select("n", F.round("mae", 6).alias("mae"), F.round(F.sqrt("mse"), 6).alias("rmse"), F.round(r2, 6).alias("r2"), F.round(F.col("mape") * 100, 6).alias("mape"))


def brier(df: DataFrame, actual: str, probability: str, threshold: float) -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(probability) - F.col(actual), F.lit(2))), 6).alias("brier"), F.count_if(F.col(probability) >= threshold).alias("flagged"))


def comparison(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: how two engines' predictions of the same cases agree."""
    a, b = left.select(key, F.col(value).alias("_a")), right.select(key, F.col(value).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    delta = F.when(both, F.abs(F.col("_a") - F.col("_b")))
    return a.join(b, key, "full_outer").agg(
        F.count_if(both).alias("shared"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), F.round(F.avg(F.when(both, (delta == 0).cast("double"))), 6).alias("agreement"),
        F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.max(delta), 6).alias("max_delta"),
    )


MINIMUM_CASES = 100  #: shared cases below which engines are not compared


def aligned_cases(left: DataFrame, right: DataFrame, key: str, shift_s: int = 0) -> DataFrame:
    """Each shared case of two engines (key, at_s, actual, prediction): whether truth, time and prediction match, and why not.

    ``shift_s`` is taken off the right engine's instants before they are compared; nothing stored changes.
    """
    a, b = left.select(key, *(F.col(c).alias(f"_a_{c}") for c in ("at_s", "actual", "prediction"))), right.select(key, *(F.col(c).alias(f"_b_{c}") for c in ("at_s", "actual", "prediction")))
    x = a.join(b, key).select(key, F.col("_a_actual").eqNullSafe(F.col("_b_actual")).alias("truth_match"), F.col("_a_at_s").eqNullSafe(F.col("_b_at_s") - shift_s).alias("time_match"), F.col("_a_prediction").eqNullSafe(F.col("_b_prediction")).alias("prediction_match"), (F.col("_b_prediction") - F.col("_a_prediction")).alias("delta"))
    why = F.when(~F.col("truth_match"), "TRUTH_DIFFERS").when(~F.col("time_match"), "TIME_DIFFERS").when(F.col("prediction_match"), "AGREES").otherwise("MODELS_DIFFER")
    return x.withColumn("explanation", why)


def certified_comparison(left: DataFrame, right: DataFrame, key: str, policy: str, shift_s: int = 0, minimum: int = MINIMUM_CASES) -> DataFrame:
    """One row: READY with agreement and deltas, or NOT_READY if truth or time differ anywhere or too few cases are shared."""
    if minimum < MINIMUM_CASES:
        raise ValueError(f"at least {MINIMUM_CASES} cases")
    x = aligned_cases(left, right, key, shift_s).agg(F.count("*").alias("shared"), F.count_if(~(F.col("truth_match") & F.col("time_match"))).alias("misaligned"), F.count_if("prediction_match").alias("matches"), F.avg(F.abs("delta")).alias("mean"), F.max(F.abs("delta")).alias("most"))
    ready = (F.col("shared") >= minimum) & (F.col("misaligned") == 0)
    only = lambda c: F.when(ready, c)
    return x.select(F.lit(policy).alias("policy"), F.when(ready, "READY").otherwise("NOT_READY").alias("status"), "shared", "misaligned", only(F.col("matches")).alias("matches"), only(F.col("shared") - F.col("matches")).alias("mismatches"), only(F.round(F.col("matches") / F.col("shared"), 6)).alias("agreement"), only(F.round("mean", 6)).alias("mean_delta"), only(F.round("most", 6)).alias("max_delta"))


def class_report(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """label, support, precision, recall, f1 of each declared label in one pass; 0 where one divides by zero."""
    cells = [F.struct(F.lit(k).alias("label"), F.count_if((F.col(actual) == k) & (F.col(predicted) == k)).alias("hit"), F.count_if(F.col(actual) == k).alias("support"), F.count_if(F.col(predicted) == k).alias("called")) for k in labels]
    x = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return x.select("label", "support", share(F.col("hit"), F.col("called")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(2.0 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"))


def silhouette(sample: DataFrame, row: str, cluster: str, features: list[str], digits: int | None = 6) -> DataFrame:
    """Mean Euclidean silhouette of a bounded sample (each row against each, so a few hundred rows)."""
    a, b = sample.alias("a"), F.broadcast(sample).alias("b")
    distance = F.sqrt(reduce(lambda x, y: x + y, [F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2)) for c in features]))
    pairs = a.crossJoin(b).filter(F.col(f"a.{row}") != F.col(f"b.{row}"))
    means = pairs.groupBy(F.col(f"a.{row}").alias("r"), F.col(f"a.{cluster}").alias("own"), F.col(f"b.{cluster}").alias("other")).agg(F.avg(distance).alias("d"))
    per = means.groupBy("r").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("near"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("next"))
    s = F.when(F.col("near").isNull(), 0.0).otherwise((F.col("next") - F.col("near")) / F.greatest("next", "near"))
    mean = F.avg(s) if digits is None else F.round(F.avg(s), digits)
    return per.agg(F.count("*").alias("n"), mean.alias("silhouette"))
