"""Adaptive scoring with Spark ML on a bounded training sample."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adaptive_scores(rows: DataFrame, key: str, features: list[str], target: str, sample: int = 20_000, trees: int = 10) -> DataFrame:
    """(key, predicted) for all rows by a forest fitted on at most about ``sample`` rows chosen by hash; null features count as 0."""
    filled = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(target).cast("double").alias("label"))
    part = min(1.0, sample / max(1, filled.count()))
    train = filled.where("label is not null").where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(part * (1 << 20)))
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestRegressor(numTrees=trees, maxDepth=6, seed=42)]
    return Pipeline(stages=stages).fit(train).transform(filled).select(key, F.col("prediction").alias("predicted"))
