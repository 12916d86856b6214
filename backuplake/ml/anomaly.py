"""Anomaly and corruption checks."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import anomaly_advice, normality_score
from backuplake.ml import features as mf
from backuplake.ml.isolation_forest import Forest
from backuplake.operators.sorting import top_metrics

CONFIDENCE = 0.8


def score_health(readings: DataFrame, forest: Forest | None, fitted_on: DataFrame | None = None) -> DataFrame:
    """Flag, score, the two metrics furthest from normal, and advice for a table of readings.

    Without a trained forest nothing is an anomaly and confidence is zero.
    """
    rows = readings.withColumns(mf.health_features(readings))
    empty = F.array().cast("array<string>")
    if forest is None:
        return rows.withColumns(
            {
                "is_anomaly": F.lit(False),
                "anomaly_score": F.lit(0.0),
                "affected_metrics": empty,
                "recommendations": empty,
                "confidence": F.lit(0.0),
            }
        )
    names = list(mf.HEALTH_FEATURES)
    scored = mf.standardise(forest.score(rows), names, fitted_on)
    affected = F.when(F.col("is_anomaly"), top_metrics({n: F.col(f"{n}_scaled") for n in names})).otherwise(empty)
    return (
        scored.withColumn("affected_metrics", affected)
        .withColumns(
            {
                "recommendations": F.when(F.col("is_anomaly"), anomaly_advice(F.col("affected_metrics"))).otherwise(empty),
                "normality_score": normality_score(F.col("anomaly_score")),
                "confidence": F.lit(CONFIDENCE),
            }
        )
        .drop(*[f"{n}_scaled" for n in names])
    )


def train_corruption(df: DataFrame, vector: str, parts: int = 32) -> PipelineModel:
    """Principal components of normal vectors."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    return Pipeline(
        stages=[
            StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False),
            PCA(k=parts, inputCol="centred", outputCol="projected"),
        ]
    ).fit(rows)


def _energy(values: Column) -> Column:
    return F.aggregate(vector_to_array(values), F.lit(0.0), lambda acc, x: acc + x * x)


def detect_corruption(df: DataFrame, vector: str, model: PipelineModel, threshold: float = 0.05) -> DataFrame:
    """Mean squared reconstruction error per vector and whether it is above the threshold.

    Components are orthonormal, so the error is the length lost by the projection.
    """
    rows = model.transform(df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>"))))
    error = (_energy(F.col("centred")) - _energy(F.col("projected"))) / F.size(vector)
    return (
        rows.withColumn("reconstruction_error", F.greatest(error, F.lit(0.0)))
        .withColumn("is_corrupt", F.col("reconstruction_error") > threshold)
        .drop("raw", "centred", "projected")
    )
