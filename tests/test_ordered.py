"""Ordered work with a hot key against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from backuplake.jobs.replay import MOVES, replay
from backuplake.operators import aggregates, ordered, windows
from backuplake.operators.ordered import indexed_with_next, running_totals, sorted_blocks


def hot_rows(n=600, seed=1):
    """A third of all rows under one key, many equal times."""
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(50), i, rng.randrange(0, 900)) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "k long, t long, id long, v long").repartition(5)


def grouped():
    out = {}
    for k, t, i, v in sorted(hot_rows(), key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(k, []).append((i, v))
    return out


def test_hot_key_spans_blocks(hot):
    blocks = sorted_blocks(hot, ["k"], ["t", "id"], 8)
    assert blocks.filter("k = 0").select("_block").distinct().count() > 1
    # At most one key of a block started earlier.
    first = blocks.groupBy("k").agg({"_block": "min"}).withColumnRenamed("min(_block)", "f")
    late = blocks.join(first, "k").filter("_block > f").select("k", "_block").distinct().groupBy("_block").count()
    assert late.filter("count > 1").count() == 0


def test_running_totals(hot):
    got = {(r.k, r.id): r.s for r in running_totals(hot, ["k"], ["t", "id"], {"s": F.col("v")}, 8).collect()}
    for k, items in grouped().items():
        total = 0
        for i, v in items:
            total += v
            assert got[(k, i)] == total


def test_index_and_next(hot):
    got = {(r.k, r.id): (r.idx, r.next_value) for r in indexed_with_next(hot, ["k"], ["t", "id"], "v", 8).collect()}
    for k, items in grouped().items():
        for pos, (i, _v) in enumerate(items):
            assert got[(k, i)] == (pos, items[pos + 1][1] if pos + 1 < len(items) else None)


@pytest.mark.parametrize("limit", [0, 1, 700, 12_345, 60_000, 1 << 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_quota_is_the_serial_fold(spark, limit, seed):
    data = hot_rows(seed=seed)
    df = spark.createDataFrame([(i, k, "S", v if i % 17 else 0, t) for k, t, i, v in data],
                               "request_id long, tenant_id long, resource string, amount long, ts long")
    got = {r.request_id: (r.admitted, r.used_after, r.warned) for r in windows.consume_quota(df, default_limit=limit, parts=8).collect()}
    used = {}
    for k, t, i, v in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        amount, before = (v if i % 17 else 0), used.get(k, 0)
        ok = before + amount <= limit
        used[k] = before + amount if ok else before
        assert got[i] == (ok, used[k], ok and used[k] > limit * 0.8)


def test_quota_edges(spark):
    df = spark.createDataFrame(
        [(1, 1, "S", 80, 1), (2, 1, "S", 30, 2), (3, 1, "S", 20, 3), (4, 2, "S", 101, 1), (5, 3, "S", 5, 1)],
        "request_id long, tenant_id long, resource string, amount long, ts long",
    )
    limits = spark.createDataFrame([(1, "S", 100), (2, "S", 100)], "tenant_id long, resource string, quota_limit long")
    got = {r.request_id: (r.admitted, r.used_after, r.warned) for r in windows.consume_quota(df, limits, default_limit=4).collect()}
    # Exactly 0.8 of the limit does not warn; a rejected request leaves room for a smaller one.
    assert got == {1: (True, 80, False), 2: (False, 80, False), 3: (True, 100, True), 4: (False, 0, False), 5: (False, 0, False)}


def test_quota_keeps_null_keys_and_wide_numbers(spark):
    wide = (1 << 53) + 1
    data = [(i, None, "S", 1, i, wide if i % 2 else None) for i in range(400)] + [(1000, None, "S", None, 0, wide)]
    df = spark.createDataFrame(data, "request_id long, tenant_id string, resource string, amount long, ts long, tag long")
    limits = spark.createDataFrame([(None, "S", 100), ("x", "S", 7)], "tenant_id string, resource string, quota_limit long")
    got = {r.request_id: r for r in windows.consume_quota(df, limits, parts=8).collect()}
    assert len(got) == 401 and sum(r.admitted for r in got.values()) == 100
    assert all(got[i].admitted == (i < 100) for i in range(400)) and not got[1000].admitted
    assert got[1].tag == wide and got[2].tag is None and got[1000].amount is None


@pytest.mark.parametrize("limit", [0, 1, 100, (1 << 62) + 3, (1 << 63) - 1])
def test_admission_is_the_serial_fold(limit):
    rng = random.Random(limit)
    amounts = [rng.choice([0, 1, 2, rng.randrange(1, 130), rng.randrange(1, 1 << rng.randrange(1, 63))]) for _ in range(500)]
    rest, taken, left = limit, [], []
    for a in amounts:
        taken.append(a <= rest)
        rest -= a if a <= rest else 0
        left.append(rest)
    got = windows.admit(amounts, limit)
    assert (got[0].tolist(), got[1].tolist(), got[2]) == (taken, left, rest)


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    blocks = sorted_blocks(spark.range(3000).withColumn("k", F.lit(1)), ["k"], ["id"])
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 150


def test_replay_of_a_hot_job(spark):
    rng = random.Random(3)
    names = list(MOVES) + ["unknown"]
    data = [(0 if i % 3 == 0 else rng.randrange(1, 30), i // 4, i, rng.choice(names[:3] + ["unknown"]) if rng.random() < 0.97 else rng.choice(names)) for i in range(600)]
    df = spark.createDataFrame(data, "job long, ts long, id long, command string").repartition(4)
    got = {r.job: (r.status, r.commands) for r in replay(df, "job", ["ts", "id"], parts=8).collect()}
    state, count = {}, {}
    for job, _t, _i, command in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        now = state.get(job, "QUEUED")
        state[job] = MOVES.get(command, {}).get(now, now)
        count[job] = count.get(job, 0) + 1
    assert got == {j: (state[j], count[j]) for j in state}


@pytest.mark.parametrize(
    "commands, status",
    [
        (["pause"], "QUEUED"),
        (["start", "resume"], "RUNNING"),
        (["start", "pause", "cancel"], "CANCELLED"),
        (["start", "cancel", "start"], "CANCELLED"),
        (["start", "pause", "resume", "complete"], "COMPLETED"),
        (["start", "complete", "cancel"], "CANCELLED"),
    ],
)
def test_replay_rules(spark, commands, status):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(commands)], "job long, ts long, command string")
    assert replay(df, "job", ["ts"]).first().status == status


def test_dirty_trigger_fires_every_threshold_plus_one(spark):
    writes = [(1, block, block) for block in range(25)] + [(1, block, 100 + block) for block in range(25)] + [(2, 1, 1)]
    df = spark.createDataFrame(writes, "device_id long, block_number long, ts long")
    got = windows.dirty_triggers(df, threshold=9, parts=4).collect()
    # Rewrites of dirty blocks do not count.
    assert sorted((r.device_id, r.block_number, r.trigger_no) for r in got) == [(1, 9, 1), (1, 19, 2)]


def test_series_shapes(spark, rows):
    data = [(1, 0, 5.0), (2, 0, 1.0), (2, 1, 3.0), (3, 0, 2.0), (3, 1, 2.0), (3, 2, 2.0)]
    data += [(4, i, v) for i, v in enumerate([1.0, 4.0, 2.0, 9.0])]
    df = spark.createDataFrame(data, "k long, t long, v double")
    trend = {r.k: (r.trend_slope, r.lag1_autocorrelation) for r in aggregates.series_trend(df, ["k"], ["t"], "v").collect()}
    assert trend[1] == (0.0, 0.0)
    assert trend[2][0] == pytest.approx(2.0)
    assert trend[3][0] == pytest.approx(0.0) and trend[3][1] is None
    stats = {r.k: r for r in aggregates.series_features(df, ["k"], "v", "v").collect()}
    assert stats[1].size_std is None and stats[2].duration_skew is None and stats[3].duration_kurtosis is None
    assert stats[3].duration_skew == 0.0
    import pandas as pd

    series = pd.Series([1.0, 4.0, 2.0, 9.0])
    assert stats[4].duration_skew == pytest.approx(series.skew())
    assert stats[4].duration_kurtosis == pytest.approx(series.kurt())
