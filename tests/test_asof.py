"""As-of joins against a search through all versions, with a key over many blocks."""

import datetime as dt
import random

import pytest

from backuplake.jobs import restore
from backuplake.operators import asof, ordered


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("block", [1_000_000, 25])
def test_rows_equal_a_search(spark, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    versions = [(rng.choice(keys), rng.choice([*range(0, 60), None]), i if rng.random() < 0.95 else None, rng.choice(["x", "y", None])) for i in range(400)]
    requests = [(i, rng.choice([*keys, "never"]), rng.choice([*range(-3, 70), None])) for i in range(300)]
    v = spark.createDataFrame([(k, day(t), tie, c) for k, t, tie, c in versions], "path string, ts timestamp_ntz, id long, checksum string")
    r = spark.createDataFrame([(i, k, day(t)) for i, k, t in requests] * 2, "request long, path string, at timestamp_ntz")
    got = asof.latest_before(r, v, ["path"], "at", "ts", "id", ["id", "checksum"])
    want = []
    for i, k, t in requests:
        fit = [x for x in versions if None not in (x[0], x[1], x[2], k, t) and x[0] == k and x[1] <= t]
        best = max(fit, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        want += [(i, k, day(t), best[2], best[3])] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if block == 25:
        blocks = ordered.sorted_blocks(v.filter("path = 'hot' AND ts IS NOT NULL AND id IS NOT NULL"), ["path"], ["ts", "id"])
        assert blocks.select(ordered.BLOCK).distinct().count() > 4


def test_no_window_sees_a_whole_key(spark):
    v = spark.createDataFrame([("a", day(1), 1, "x")], "path string, ts timestamp_ntz, id long, checksum string")
    r = spark.createDataFrame([(1, "a", day(2))], "request long, path string, at timestamp_ntz")
    plan = asof.latest_before(r, v, ["path"], "at", "ts", "id", ["checksum"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_restores_at_many_times(spark, rows):
    snapshots = spark.createDataFrame(
        [("d", "/f", day(1), "s1", "x", False), ("d", "/f", day(5), "s2", "y", True), ("d", "/f", day(9), "s3", "z", None)],
        "device string, path string, ts timestamp_ntz, snapshot_id string, checksum string, is_deleted boolean",
    )
    requests = spark.createDataFrame([("d", "/f", day(t)) for t in (0, 1, 4, 5, 9, 99)], "device string, path string, at timestamp_ntz")
    out = restore.versions_at(requests, snapshots, ["device", "path"])
    got = {(r["at"] - day(0)).days: (r["snapshot_id"], r["checksum"], r["status"]) for r in out.collect()}
    live, none = lambda s, c: (s, c, "RESTORABLE"), lambda s: (None, None, s)
    assert got == {0: none("NOT_YET"), 1: live("s1", "x"), 4: live("s1", "x"), 5: none("DELETED"), 9: live("s3", "z"), 99: live("s3", "z")}
