"""The model store: first start, races, drift, champions and challengers."""

import json

import pytest
from pyspark.sql import functions as F

from backuplake.ml import regressors
from backuplake.ml.store import ModelStore
from backuplake.session import shared_path

def history(spark, factor=1.0, rows=400):
    base = spark.range(rows).select(
        "id", (F.col("id") % 50 * 100).alias("file_count"), (F.col("id") % 7 * 1_000_000).alias("total_size"),
        *[F.lit(50.0).alias(c) for c in ("device_cpu", "device_memory", "network_speed")],
    )
    return base.withColumn("backup_duration", F.greatest(F.lit(30.0), F.col("file_count") * 0.1 * factor))


def train(rows):
    return regressors.train_duration(rows, trees=5, depth=6)


@pytest.fixture()
def store(spark):
    return ModelStore(spark, shared_path(spark, "store"), "duration")


def args():
    return "backup_duration", "raw_duration", F.col("id") % 4 == 0


def test_load_or_train(spark, store):
    assert store.load_or_train(history(spark).limit(0), train, *args()) is None
    assert store.current() is None
    with pytest.raises(KeyError):
        store.load()
    # Untrained models answer with their defaults.
    assert regressors.predict_duration(history(spark, rows=1), None, "id").first().confidence == 0.5
    model, version = store.load_or_train(history(spark), train, *args())
    assert (version.number, version.rows) == (1, 300)
    assert regressors.predict_duration(history(spark), model, "id").filter("confidence <> 0.8").count() == 0

    def never(_rows):
        raise AssertionError("trained again")

    again, same = ModelStore(spark, store.root.rsplit("/", 1)[0], "duration").load_or_train(history(spark).limit(0), never, *args())
    assert same == version
    both = again.transform(model.transform(history(spark)).withColumnRenamed("raw_duration", "first").drop("raw", "features"))
    assert both.filter("first <> raw_duration").count() == 0


def test_one_of_two_writers_wins(spark, store):
    rival = []

    def slow(rows):
        """Another process is done first."""
        if not rival:
            rival.append(None)
            rival[0] = ModelStore(spark, store.root.rsplit("/", 1)[0], "duration").load_or_train(history(spark), train, *args())
        return train(rows)

    _, version = store.load_or_train(history(spark), slow, *args())
    assert version == rival[0][1] and len(store.versions()) == 1
    assert store.put(store.load(), 1, 5, 0.0) is None
    assert json.loads(open(f"{store.top}/versions/1.json").read())["rows"] == 300


def test_retraining(spark, store):
    assert store.retrain(history(spark), train, *args()) is None
    _, first = store.load_or_train(history(spark), train, *args())
    kept = store.retrain(history(spark), train, *args())
    assert not kept.drifted and not kept.promoted and kept.version == first and kept.challenger_error is None
    slower = history(spark, factor=5)
    # A challenger that is no better is not promoted.
    worse = store.retrain(slower, lambda _rows: store.load(), *args())
    assert worse.drifted and not worse.promoted and store.current() == first
    better = store.retrain(slower, train, *args())
    assert better.drifted and better.promoted and better.version.number == 2 and better.challenger_error < better.champion_error
    assert store.retrain(slower, train, *args()).drifted is False
    # The old version still loads, and still answers as it did.
    old = store.load(1).transform(history(spark)).agg(F.max("raw_duration")).first()[0]
    assert old < 600 < store.load().transform(history(spark)).agg(F.max("raw_duration")).first()[0]
    with pytest.raises(KeyError):
        store.load(9)
