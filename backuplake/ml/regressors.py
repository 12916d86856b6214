"""Duration and window-quality models on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions import features as fx
from backuplake.ml import features as mf
from backuplake.ml import forest
from backuplake.operators.sorting import best_by
from backuplake.operators.windows import optimal_windows

# Answers of an untrained or failed model.
UNTRAINED = {"duration": 300.0, "success_rate": 0.95, "confidence": 0.5}
FAILED_CONFIDENCE = 0.3
TRAINED_CONFIDENCE = 0.8


def _stages(names: list[str]) -> list:
    return [
        VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]


def train_duration(training: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Random forest for the duration of a backup; every split sees all features."""
    learner = RandomForestRegressor(
        featuresCol="features",
        labelCol="backup_duration",
        predictionCol="raw_duration",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="all",
        seed=seed,
    )
    rows = training.withColumns(mf.backup_features(training)).select(*mf.BACKUP_FEATURES, "backup_duration")
    scaling = Pipeline(stages=_stages(list(mf.BACKUP_FEATURES))).fit(rows)
    return PipelineModel(stages=[*scaling.stages, forest.fit(learner, scaling.transform(rows))])


def predict_duration(requests: DataFrame, model: PipelineModel | None, key: str) -> DataFrame:
    """Duration, success rate and confidence; without a model, or where it gives no number, the defaults."""
    base = requests.withColumns(mf.backup_features(requests))
    if model is None:
        raw, confidence = F.lit(None).cast("double"), UNTRAINED["confidence"]
        scored = base.withColumn("raw_duration", raw)
    else:
        confidence = FAILED_CONFIDENCE
        *scaling, trees = model.stages
        scored = forest.score(trees, PipelineModel(scaling).transform(base)).drop("raw", "features")
    return with_fallback(scored, confidence)


def with_fallback(scored: DataFrame, missing_confidence: float) -> DataFrame:
    """Replaces missing raw durations; the success rate comes from the raw duration."""
    known = F.col("raw_duration").isNotNull() & ~F.isnan("raw_duration")
    return scored.withColumns(
        {
            "predicted_duration": F.when(known, fx.floor_duration(F.col("raw_duration"))).otherwise(UNTRAINED["duration"]),
            "predicted_success_rate": F.when(known, fx.success_rate(F.col("raw_duration"))).otherwise(
                UNTRAINED["success_rate"]
            ),
            "confidence": F.when(known, TRAINED_CONFIDENCE).otherwise(missing_confidence),
        }
    ).drop("raw_duration")


def score_requests(requests: DataFrame, model: PipelineModel | None, key: str, as_of: Column) -> DataFrame:
    """Predictions, resource needs, advice and a time slot for a table of backup requests."""
    rows = predict_duration(requests, model, key)
    return rows.withColumns(
        fx.resource_needs(F.col("file_count"), F.col("total_size"))
        | {
            "optimal_time_slot": as_of + F.make_interval(hours=F.lit(2)),
            "recommendations": fx.backup_advice(
                F.col("predicted_duration"), F.col("predicted_success_rate"), F.col("total_size")
            ),
        }
    )


class WindowModel:
    """Mean of a random forest and boosted trees for the quality of an hour, in original units."""

    def __init__(self, models: dict[str, PipelineModel], least: float, most: float):
        self.models, self.least, self.most = models, least, most

    def predict(self, hours: DataFrame, threshold: float = 0.7) -> DataFrame:
        rows = hours.withColumns(mf.window_features(hours, defaults=mf.WINDOW_CURRENT))
        for model in self.models.values():
            rows = model.transform(rows).drop("raw", "features")
        mean = sum((F.col(name) for name in self.models), F.lit(0.0)) / len(self.models)
        return (
            rows.withColumn("quality_score", mf.from_unit(mean, F.lit(self.least), F.lit(self.most)))
            .withColumn("recommended", F.col("quality_score") > threshold)
            .drop(*self.models)
        )

    def importances(self, spark) -> DataFrame:
        """Feature importance per model as a long table."""
        rows = [
            (name, feature, float(value))
            for name, model in self.models.items()
            for feature, value in zip(_window_names(), model.stages[-1].featureImportances.toArray())
        ]
        return spark.createDataFrame(rows, "model string, feature string, importance double")


def _window_names() -> list[str]:
    calendar = ["hour", "day_of_week", "day_of_month", "month", "quarter", "is_weekend", "is_business_hours"]
    return [*calendar, "hour_sin", "hour_cos", "day_sin", "day_cos", *mf.WINDOW_TRAINING]


def train_windows(
    history: DataFrame, key: Column, trees: int = 200, depth: int = 8, boost_depth: int = 3, seed: int = 42
) -> tuple[WindowModel, DataFrame]:
    """The ensemble and its MSE and R2 on the held-out fifth.

    `history`: timestamp, window_quality_score and optional state columns.
    """
    rows = history.withColumns(mf.window_features(history))
    least, most = mf.range_of(history, "window_quality_score").first()
    rows = rows.withColumn("label", mf.to_unit(F.col("window_quality_score"), F.lit(least), F.lit(most)))
    train, test = mf.split(rows, key, seed)
    common = {"featuresCol": "features", "labelCol": "label", "featureSubsetStrategy": "all", "seed": seed}
    learners = {
        "random_forest": RandomForestRegressor(
            predictionCol="random_forest", numTrees=trees, maxDepth=depth, **common
        ),
        "gradient_boosting": GBTRegressor(
            predictionCol="gradient_boosting", maxIter=trees, maxDepth=boost_depth, **common
        ),
    }
    models, quality = {}, []
    for name, learner in learners.items():
        models[name] = Pipeline(stages=[*_stages(_window_names()), learner]).fit(train)
        scored = models[name].transform(test).select("label", name)
        evaluator = RegressionEvaluator(labelCol="label", predictionCol=name)
        quality.append(
            (name, evaluator.evaluate(scored, {evaluator.metricName: "mse"}), evaluator.evaluate(scored, {evaluator.metricName: "r2"}))
        )
    report = history.sparkSession.createDataFrame(quality, "model string, mse double, r2 double")
    return WindowModel(models, float(least), float(most)), report


def recommend(scores: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """The best window per key, or the default time two hours on.

    `scores`: keys, hour_ts, quality_score.
    """
    runs = optimal_windows(scores, keys).withColumn("avg_quality", F.round("avg_quality", 9))
    best = best_by(runs, keys, "avg_quality", F.col("start_time"))
    found = F.col("start_time").isNotNull()
    return (
        scores.select(*keys)
        .distinct()
        .join(best, keys, "left")
        .select(
            *keys,
            F.when(found, "schedule_backup").otherwise("schedule_fallback").alias("action"),
            F.coalesce("start_time", as_of + F.make_interval(hours=F.lit(2))).alias("at"),
            F.col("avg_quality").alias("window_quality"),
        )
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
