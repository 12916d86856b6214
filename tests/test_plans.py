"""Shapes of plans that must not slip: no pair joins, filters and columns at the scan, early cuts."""

import re

import pytest
from pyspark.sql import functions as F

from backuplake.operators import joins
from backuplake.plans import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load()[0]
# Training and streaming run on call and leave only a read behind.
SKIPPED = ("ml_05", "ml_06", "ml_07", "ml_13", "ml_16", "str_")


def plan_of(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ("jn_01_file_chunks", "jn_08_replicas", "job_10_distribution", "job_15_synthetic_full", "win_07_quota_consumption", "agg_13_series_trend", "job_05_codecs")])
def test_no_pair_joins_and_no_row_at_a_time_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("flt_01_point_lookup", "EqualTo(o_orderkey,42)"),
        ("flt_02_live_of_device", "EqualTo(l_suppkey,7)"),
        ("flt_04_time_range", "GreaterThanOrEqual(o_orderdate"),
        ("flt_11_online_devices", "GreaterThan(c_acctbal,0.0)"),
        ("snk_03_expiring_updates", "IsNotNull(ts)"),
        ("win_03_latest_state", "LessThan(l_shipdate"),
        ("win_06_retention", "GreaterThanOrEqual("),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan_of(spark, name)


def test_scans_read_only_what_is_used(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(spark, "flt_01_point_lookup")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_orderstatus"}


@pytest.mark.parametrize("name", ["win_02_lww_register", "win_06_retention", "set_01_merge_states", "srt_04_newest_per_device"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert "WindowGroupLimit" in plan


def test_windows_are_summed_per_step_first(spark):
    plan = plan_of(spark, "agg_01_windowed_stats")
    # The copies into overlapping windows are made above the first aggregation.
    assert plan.index("Expand") < plan.rindex("Exchange")


def test_hot_key_of_a_lookup_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        digest = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        incoming = spark.range(0, 60_000, 1, 16).select(digest.alias("digest"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
        index = spark.range(0, 60_000, 1, 4).select((F.col("id") % 20_000).alias("digest"))
        for found, flagged in (
            (joins.duplicate_flags(incoming, index), 60_000),
            (joins.new_chunks(incoming, index), None),
        ):
            rows = found.collect()
            assert flagged is None or len(rows) == flagged
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
