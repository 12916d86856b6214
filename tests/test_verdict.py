"""Rows that told wrong implementations from right ones."""

import datetime as dt

from pyspark.sql import functions as F

from backuplake.operators import sorting, windows
from backuplake.session import shared_path
from backuplake.sources import bindings, sinks
from backuplake.streaming import events
from backuplake.streaming.run import run_to_end


def test_an_hour_without_a_row_ends_a_window(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("t", at(1, 0), 0.9), ("t", at(5, 0), 0.9), ("t", at(5, 1), 0.9), ("t", at(6, 0), 0.1)]
    got = windows.optimal_windows(spark.createDataFrame(rows, "tenant string, hour_ts timestamp_ntz, quality_score double"), ["tenant"])
    assert [(r["start_time"], r["duration_hours"]) for r in got.collect()] == [(at(5, 0), 2)]


def test_a_null_value_wins_only_alone(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 0.9, 2), ("b", None, 3)], "k string, v double, t int")
    assert sorted((r["k"], r["v"]) for r in sorting.best_by(df, ["k"], "v", F.col("t")).collect()) == [("a", 0.9), ("b", None)]


def test_a_replayed_manifest_does_not_double(spark):
    path = shared_path(spark, "manifest")
    first = spark.createDataFrame([(f"/f{i}", "b1") for i in range(10)] + [("/x", "b2")], "path string, backup_id string")
    sinks.write_manifest(first, path)
    sinks.write_manifest(first.filter("backup_id = 'b1'"), path)
    assert spark.read.parquet(path).count() == 11


def test_a_stream_after_compaction_keeps_all_keys(spark):
    path = shared_path(spark, "upserts")
    frame = lambda lo, hi, v: spark.createDataFrame([(i, v) for i in range(lo, hi)], "k long, v long")
    events.upsert_writer(path, ["k"], ["v"])(frame(0, 100, 1), 0)
    target = events.compact_state(spark, path, ["k"], ["v"])
    events.upsert_writer(target, ["k"], ["v"])(frame(0, 1, 2), 0)
    state = events.current_state(spark, target, ["k"], ["v"])
    assert state.count() == 100 and state.filter("v = 2").count() == 1


def test_folder_tables_stream_like_files(spark):
    folder = shared_path(spark, "tables")
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(4).write.parquet(f"{folder}/events.parquet")
    assert run_to_end(bindings.stream(spark, folder, "events"), "folder").count() == source.count()
