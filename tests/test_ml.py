"""Feature, regression and anomaly operators on small made-up frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from backuplake.ml import anomaly, isolation_forest, regressors, scoring
from backuplake.ml import features as mf

HEALTH = list(mf.HEALTH_FEATURES)


def health_frame(spark, n=2000, seed=7):
    rng = np.random.default_rng(seed)
    data = {m: rng.normal(v, v * 0.2 + 1, n) for m, v in mf.HEALTH_FEATURES.items()}
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), **data}))


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = [(r.a_scaled, r.b_scaled) for r in mf.standardise(df, ["a", "b"]).orderBy("a").collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]
    new = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    assert mf.standardise(new, ["a", "b"], fitted_on=df).first().a_scaled == 3.0


def test_unit_range(spark):
    row = spark.range(1).select(
        mf.to_unit(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("u"),
        mf.from_unit(F.lit(0.5), F.lit(0.0), F.lit(10.0)).alias("v"),
        mf.to_unit(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("w"),
    ).first()
    assert (row.u, row.v, row.w) == (0.5, 5.0, 0.0)


def test_feature_lists(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 9), 3)], "timestamp timestamp, file_count int")
    meta = mf.metadata_features(df)
    assert len(meta) == 22 and len(mf.window_features(df)) == 15
    row = df.select(*[c.alias(n) for n, c in meta.items()]).first()
    assert (row.file_count, row.hour, row.day_of_week, row.error_count) == (3.0, 9.0, 5.0, 0.0)
    window = df.select(*[c.alias(n) for n, c in mf.window_features(df).items()]).first()
    assert window.is_weekend == 1.0 and window.is_business_hours == 1.0 and window.backup_success_rate == 1.0
    assert df.select(mf.backup_features(df)["device_memory"]).first()[0] == 70.0


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    train, test = mf.split(df, F.col("id"))
    again, _ = mf.split(df.repartition(7), F.col("id"))
    kept = {r.id for r in train.collect()}
    assert kept == {r.id for r in again.collect()} and train.count() + test.count() == 5000
    assert 0.77 < len(kept) / 5000 < 0.83


def test_untrained_answers(spark):
    req = spark.createDataFrame([("d", 10, 5)], "device_id string, file_count int, total_size long")
    got = regressors.score_requests(req, None, "device_id", F.lit(dt.datetime(2024, 1, 1))).first()
    assert (got.predicted_duration, got.predicted_success_rate, got.confidence) == (300.0, 0.95, 0.5)
    assert got.optimal_time_slot == dt.datetime(2024, 1, 1, 2) and got.recommendations == []
    quiet = anomaly.score_health(health_frame(spark, 3), None).first()
    assert quiet.is_anomaly is False and quiet.confidence == 0.0 and quiet.affected_metrics == []


def test_regressor_learns_and_survives_missing_features(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 800
    data = pd.DataFrame({"id": np.arange(n), "file_count": rng.integers(10, 10_000, n), "total_size": rng.integers(1_000, 10**8, n)})
    data["backup_duration"] = np.maximum(30, data.file_count * 0.1 + data.total_size / 1e6 * 60)
    df = spark.createDataFrame(data)
    model = regressors.train_duration(df, trees=10, depth=6)
    scored = regressors.predict_duration(df, model, "id")
    r2 = 1 - scored.select(F.avg(F.pow(F.col("predicted_duration") - F.col("backup_duration"), 2)) / F.var_pop("backup_duration")).first()[0]
    assert r2 > 0.8 and scored.filter("predicted_success_rate < 0.7 OR predicted_success_rate > 0.99").count() == 0
    assert regressors.predict_duration(spark.createDataFrame([(1,)], "id long"), model, "id").first().confidence == 0.8
    regressors.save(model, str(tmp_path / "m"))
    loaded = regressors.predict_duration(df, regressors.load(str(tmp_path / "m")), "id")
    assert loaded.select("predicted_duration").collect() == scored.select("predicted_duration").collect()


def test_window_model_and_recommendation(spark):
    hours = pd.date_range("2023-01-01", periods=600, freq="h")
    frame = pd.DataFrame({"timestamp": hours, "system_load": 0.2, "user_activity": 0.1})
    frame["window_quality_score"] = np.where(hours.hour < 6, 0.9, 0.3)
    model, report = regressors.train_windows(spark.createDataFrame(frame), F.unix_timestamp("timestamp"), trees=10)
    assert all(r.r2 > 0.9 for r in report.collect())
    start = spark.createDataFrame([("t",)], "tenant string")
    ahead = mf.horizon(start, F.lit(dt.datetime(2023, 2, 1, 20)))
    scored = model.predict(ahead)
    assert scored.count() == 24
    assert {r.timestamp.hour for r in scored.filter("recommended").collect()} == set(range(6))
    best = regressors.recommend(scored.withColumnRenamed("timestamp", "hour_ts"), ["tenant"], F.lit(dt.datetime(2023, 2, 1))).first()
    assert best.action == "schedule_backup" and best.at.hour == 0 and best.at.day == 2
    none = regressors.recommend(scored.withColumnRenamed("timestamp", "hour_ts").withColumn("quality_score", F.lit(0.1)), ["tenant"], F.lit(dt.datetime(2023, 2, 1))).first()
    assert none.action == "schedule_fallback" and none.at == dt.datetime(2023, 2, 1, 2)
    parts = model.importances(spark).groupBy("model").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert all(p.n == 15 and p.s == pytest.approx(1.0) for p in parts)


def test_isolation_forest_finds_outliers_and_repeats_itself(spark):
    df = health_frame(spark)
    odd = spark.createDataFrame([(-1, 500.0, 500.0, 900.0, 900.0, 500.0)], ["id", *HEALTH])
    forest = isolation_forest.fit(df, HEALTH, "id", trees=50)
    again = isolation_forest.fit(df.repartition(5), HEALTH, "id", trees=50)
    share = forest.score(df).filter("is_anomaly").count() / 2000
    assert 0.08 < share < 0.12
    assert forest.score(odd).first().is_anomaly is True
    assert forest.score(odd).first().anomaly_score == pytest.approx(again.score(odd).first().anomaly_score)
    worst = forest.score(df.unionByName(odd)).orderBy("anomaly_score").first()
    assert worst.id == -1
    scored = anomaly.score_health(odd, forest, fitted_on=df).first()
    assert len(scored.affected_metrics) == 2 and scored.confidence == 0.8


def test_isolation_forest_draws_from_long_tables(spark):
    df = health_frame(spark, 4000)
    forest = isolation_forest.fit(df, HEALTH, "id", trees=4, sample=64)
    assert forest.sample == 64 and len(forest.trees.value) == 4
    with pytest.raises(ValueError):
        isolation_forest.fit(df.filter("id < 0"), HEALTH, "id")


def test_usual_depth():
    assert isolation_forest.usual_depth(1) == 0 and isolation_forest.usual_depth(2) == 1
    assert isolation_forest.usual_depth(256) == pytest.approx(10.24, abs=0.01)


def test_corruption(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(4, 12))
    good = (rng.normal(size=(200, 4)) @ basis).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good)], "id long, v array<double>")
    model = anomaly.train_corruption(df, "v", parts=4)
    assert anomaly.detect_corruption(df, "v", model).filter("is_corrupt").count() == 0
    bad = spark.createDataFrame([(1, rng.normal(size=12).tolist())], "id long, v array<double>")
    assert anomaly.detect_corruption(bad, "v", model).first().is_corrupt is True


def test_constant_metric_adds_no_distance(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (1, 3.0, 7.0)], "tenant_id long, a double, b double")
    joined = df.join(scoring.tenant_model(df, ["tenant_id"], ["a", "b"]), "tenant_id")
    assert joined.select(scoring.distance(["a", "b"]).alias("d")).first().d == pytest.approx(np.sqrt(0.5))
