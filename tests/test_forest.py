"""Forests grown from histograms: splits against brute force, slices, odd values, and what Spark ML gives on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from backuplake.ml import forest, regressors


def frame(spark, n=6000, parts=4):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=(n, 3))
    x[:, 1] = rng.integers(0, 9, n)
    y = 30 + x[:, 0] * 20 + x[:, 1] ** 2 * 5 + rng.normal(size=n)
    data = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y})).repartition(parts)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(data).cache()


def learner(trees=8, depth=6):
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=42)


def error(model, rows):
    return model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]


def test_duration_is_not_trained_row_by_row(spark, monkeypatch):
    """Spark ML's trainer sees no more than the two rows that give a model its settings."""
    seen, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    rows = spark.range(500).select(F.col("id").cast("double").alias("file_count"), (F.col("id") * 2.0).alias("backup_duration"))
    model = regressors.train_duration(rows, trees=3, depth=4)
    assert max(seen) <= 2 and model.stages[-1].getNumTrees == 3
    found = regressors.predict_duration(rows, model, "file_count").agg(F.corr("predicted_duration", "backup_duration")).first()[0]
    assert found > 0.95


def test_as_good_as_spark_and_in_its_format(spark, tmp_path):
    rows = frame(spark)
    one, other = forest.fit(learner(), rows), learner().fit(rows)
    assert error(one, rows) < 1.1 * error(other, rows)
    assert one.featureImportances.toArray() == pytest.approx(other.featureImportances.toArray(), abs=0.05)
    assert [t.depth for t in one.trees] == [6] * 8 and len({t.numNodes for t in one.trees}) > 1
    one.write().save(str(tmp_path / "m"))
    assert error(type(one).load(str(tmp_path / "m")), rows) == error(one, rows)


def test_slices_and_repeats_give_the_same_forest(spark):
    rows = frame(spark)
    first, again, sliced = (forest.fit(learner(5, 8), rows, slice_rows=n) for n in (1 << 24, 1 << 24, 2000))
    assert first.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]
    # Sums in another order differ in the last digits, which may decide between equal splits.
    both = sliced.setPredictionCol("other").transform(first.transform(rows))
    assert both.agg(F.avg((F.abs(F.col("other") / F.col("prediction") - 1) < 1e-9).cast("double"))).first()[0] > 0.98


def test_splits_are_the_best_of_all(spark):
    rng = np.random.default_rng(5)
    parts, places = np.zeros((3, 2, 3, 7)), np.array([0, 2, 3])
    rows = [(rng.integers(0, 7, (40, 2)), rng.normal(size=40), rng.integers(1, 4, 40)) for _ in places]
    for i, (code, y, w) in enumerate(rows):
        for f in range(2):
            for k in range(3):
                np.add.at(parts[k, f, i], code[:, f], w * y**k)
    found = forest._splits(9, places, parts, np.array([(w * y * y).sum() for _, y, w in rows])).to_pylist()
    for got, (code, y, w) in zip(found, rows):

        def variance(at):
            return w[at].sum() * np.average((y[at] - np.average(y[at], weights=w[at])) ** 2, weights=w[at])

        whole = np.ones(40, bool)
        sides = {(f, c): code[:, f] <= c for f in range(2) for c in range(6)}
        gains = {k: (variance(whole) - variance(at) - variance(~at)) / w.sum() for k, at in sides.items() if at.any() and not at.all()}
        assert got["gain"] == pytest.approx(max(gains.values())) and gains[got["feature"], got["cut"]] == pytest.approx(max(gains.values()))
        left = sides[got["feature"], got["cut"]]
        assert got["left_q"] == pytest.approx((w * y * y)[left].sum()) and got["n"] == w.sum()


def test_odd_values(spark):
    rows = frame(spark, 300, 3)
    same = forest.fit(learner(2, 4), rows.withColumn("label", F.lit(7.1)))
    assert {t.numNodes for t in same.trees} == {1} and same.transform(rows).agg(F.max(F.abs(F.col("prediction") - 7.1))).first()[0] < 1e-9
    assert forest.fit(learner(2, 0), rows).totalNumNodes == 2
    with pytest.raises(Exception, match="no rows"):
        forest.fit(learner(), rows.limit(0))
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="labels must be finite"):
            forest.fit(learner(), rows.withColumn("label", F.when(F.col("a") > 1, F.col("label")).otherwise(F.lit(bad).cast("double"))))


def test_cuts():
    def summary(*columns):
        return np.concatenate([np.concatenate([[len(v) <= 40, len(v)], v, np.ones(len(v))]) for v in columns]).astype("<f8").tobytes()

    few, many, none = np.array([1.0, 5.0]), np.arange(100.0), np.array([])
    cuts = forest._cuts([summary(few, many, none), summary(np.array([5.0, np.inf]), many, none)], 4)
    assert cuts[0].tolist() == [3.0, 5.0] and len(cuts[2]) == 0
    assert cuts[1] == pytest.approx([24.5, 49.5, 74.5, 93.5], abs=1)


@pytest.mark.parametrize("grown", ["here", "by Spark ML"])
def test_scores_are_those_of_the_model_to_the_bit(spark, grown):
    rows = frame(spark, 3000)
    trained = forest.fit(learner(), rows) if grown == "here" else learner().fit(rows)
    odd = spark.createDataFrame([(float("nan"), 1.0, 2.0), (float("inf"), float("-inf"), 0.0)], "a double, b double, c double")
    odd = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep").transform(odd)
    both = rows.select("features").unionByName(odd.select("features"))
    got = forest.score(trained, trained.transform(both).withColumnRenamed("prediction", "expected"))
    assert got.count() == 3002 and got.filter("NOT (expected <=> prediction)").isEmpty()


def test_requests_are_not_scored_row_by_row(spark, monkeypatch):
    """Walking all trees row by row misses the cache at nearly every step."""
    rows = spark.range(400).select(F.col("id").cast("double").alias("file_count"), (F.col("id") * 2.0).alias("backup_duration"))
    model = regressors.train_duration(rows, trees=3, depth=4)
    expected = {r.file_count: r.raw_duration for r in model.transform(rows.withColumns(regressors.mf.backup_features(rows))).collect()}

    def refuse(*_):
        raise AssertionError("scored row by row")

    monkeypatch.setattr(type(model.stages[-1]), "_transform", refuse)
    scored = regressors.predict_duration(rows, model, "file_count").collect()
    assert {r.file_count: r.predicted_duration for r in scored} == {k: max(30.0, v) for k, v in expected.items()}
