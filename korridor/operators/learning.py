"""Model candidates, selection on validation and scoring, on Spark ML."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.functions import scalars
from korridor.operators import metrics

SEED = 20260926


def candidates(task: str) -> dict:
    """Estimators by name; names decide ties."""
    if task == "classification":
        return {"logistic_regression": LogisticRegression(maxIter=300), "decision_tree": DecisionTreeClassifier(maxDepth=6, seed=SEED), "random_forest": RandomForestClassifier(numTrees=80, maxDepth=8, seed=SEED)}
    if task == "regression":
        return {"linear_regression": LinearRegression(regParam=1.0, elasticNetParam=0.0), "decision_tree": DecisionTreeRegressor(maxDepth=6, seed=SEED), "random_forest": RandomForestRegressor(numTrees=80, maxDepth=8, seed=SEED)}
    if task == "clustering":
        return {f"kmeans_k{k}": KMeans(k=k, maxIter=100, seed=SEED) for k in (2, 3, 4)}
    raise ValueError(task)


def fit(train: DataFrame, features: list[str], estimator) -> PipelineModel:
    """Standardised features, then the estimator; the label is ``label``."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"), estimator]).fit(train)


def select(scored: dict[str, float | None], maximize: bool) -> str:
    """The name of the best score; ties by name. Fewer than three measured candidates are refused."""
    known = {n: v for n, v in scored.items() if v is not None and math.isfinite(v)}
    if len(known) < 3:
        raise ValueError("at least three measured candidates are required")
    return min(known, key=lambda n: (-known[n] if maximize else known[n], n))


def best_regressor(train: DataFrame, validation: DataFrame, features: list[str]) -> tuple[str, PipelineModel]:
    """Of all candidates the one with the least mean absolute error on validation."""
    models = {n: fit(train, features, e) for n, e in candidates("regression").items()}
    scores = {n: m.transform(validation).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] for n, m in models.items()}
    name = select(scores, maximize=False)
    return name, models[name]


def best_classifier(train: DataFrame, validation: DataFrame, features: list[str], labels: list) -> tuple[str, PipelineModel]:
    """Of all candidates the one with the greatest macro F1 over the declared labels on validation."""
    models = {n: fit(train, features, e) for n, e in candidates("classification").items()}
    scores = {n: metrics.macro_f1(m.transform(validation), "label", "prediction", labels) for n, m in models.items()}
    name = select(scores, maximize=True)
    return name, models[name]


def scaled_silhouette(model: PipelineModel, df: DataFrame, features: list[str], row: str, limit: int = 500) -> float | None:
    """Silhouette on standardised features of at most ``limit`` seeded rows; None unless 2 to n - 1 clusters occur."""
    x = model.transform(df).withColumn("_v", vector_to_array("features")).select(F.col(row).alias("_row"), "prediction", *(F.col("_v")[i].alias(f"_f{i}") for i in range(len(features))))
    x = x.orderBy(scalars.rank_digest(str(SEED), "_row"), "_row").limit(limit).persist()
    n, clusters = x.agg(F.count("*"), F.countDistinct("prediction")).first()
    out = metrics.silhouette(x, "_row", "prediction", [f"_f{i}" for i in range(len(features))], digits=None).first().silhouette if 2 <= clusters < n else None
    x.unpersist()
    return out


def best_clustering(train: DataFrame, validation: DataFrame, features: list[str], row: str) -> tuple[str | None, dict[str, PipelineModel], dict[str, float | None]]:
    """Of all candidates the one with the greatest silhouette on validation (None if one is undefined); all models and scores."""
    models = {n: fit(train, features, e) for n, e in candidates("clustering").items()}
    scores = {n: scaled_silhouette(m, validation, features, row) for n, m in models.items()}
    return None if None in scores.values() else select(scores, maximize=True), models, scores


def legacy_regressor(categories: list[str], numbers: list[str], label: str) -> Pipeline:
    """Categories indexed and one-hot encoded, numbers beside them, a random forest on top."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    return Pipeline(stages=[
        StringIndexer(inputCols=categories, outputCols=[f"{c}_index" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories]),
        VectorAssembler(inputCols=[*(f"{c}_hot" for c in categories), *numbers], outputCol="features", handleInvalid="skip"), RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=20, maxDepth=5, seed=20260924),
    ])
