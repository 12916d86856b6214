"""Streams in several batches: lateness, restarts, replays, state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.ml import scoring
from backuplake.operators.windows import latest_by
from backuplake.plans import streams
from backuplake.plans.registry import QUERIES
from backuplake.sources import readers, sinks
from backuplake.streaming import events as se
from backuplake.streaming import run, stateful

START = dt.datetime(2024, 1, 1, 12)


def minute(m, s=0):
    return START + dt.timedelta(minutes=m, seconds=s)


class Feed:
    """A folder read as a stream, one file per batch, restarted on every call of `drain`."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema, self.files = spark, root, schema, 0
        (root / "in").mkdir()

    def put(self, data):
        df = self.spark.createDataFrame(data, self.schema).coalesce(1)
        target = self.root / f"part{self.files}"
        df.write.parquet(str(target))
        source = next(target.glob("*.parquet"))
        source.rename(self.root / "in" / f"{self.files:03d}.parquet")
        self.files += 1

    def drain(self, build, sink=None, mode="append"):
        out = str(self.root / "out")
        stream = readers.stream(self.spark, "parquet", self.schema, str(self.root / "in"), maxFilesPerTrigger="1")
        query = run.start(build(stream), f"feed{random.random()}"[:20], sink or sinks.batch_writer(out), str(self.root / "check"), mode, None)
        query.awaitTermination()
        return self.spark.read.parquet(out) if sink is None else None


def test_late_rows_and_closed_windows(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, "timestamp timestamp, tenant_id long, backup_type string, size long, duration long")
    feed.put([(minute(30), 1, "F", 10, 1)])
    # Rows are held against the watermark of the batch before.
    feed.put([(minute(30), 2, "F", 3, 1)])
    feed.put([(minute(21), 1, "F", 7, 1), (minute(14), 1, "F", 1000, 1), (minute(25), 1, "F", 5, 1)])
    feed.put([(minute(60), 1, "F", 1, 1)])
    got = feed.drain(se.windowed_stats)
    totals = {(r.window_start, r.total_size) for r in got.collect()}
    # Nine minutes late is kept; a row whose windows have all closed is dropped.
    assert (minute(17), 7) in totals and not any(t >= 1000 for _, t in totals)
    # A row on the edge opens its window and is not in the one that ends there.
    assert (minute(20), 7) in totals and (minute(21), 12) in totals and (minute(25), 5) in totals and (minute(30), 10) in totals


@pytest.mark.parametrize("kind", ["long", "string"])
def test_admission_carries_usage_over_restarts(spark, tmp_path, kind):
    tenant = (lambda n: n) if kind == "long" else "tenant-{}".format
    feed = Feed(spark, tmp_path, f"request_id long, tenant_id {kind}, resource string, amount long, ts timestamp")
    limits = spark.createDataFrame([(tenant(2), "S", 30)], f"tenant_id {kind}, resource string, quota_limit long")
    out = str(tmp_path / "admission")
    sink = stateful.admission_writer(out, limits, default_limit=100)
    feed.put([(1, tenant(1), "S", 60, minute(0)), (2, tenant(1), "S", 60, minute(1))])
    feed.drain(lambda s: s, sink)
    feed.put([(4, tenant(1), "S", 1, minute(3)), (3, tenant(1), "S", 40, minute(2)), (5, tenant(2), "S", 31, minute(0))])
    feed.put([(6, tenant(2), "S", 30, minute(0)), (7, None, "S", 5, minute(4))])
    feed.put([(8, None, "S", 96, minute(5))])
    feed.drain(lambda s: s, sink)
    want = {1: (True, 60, False), 2: (False, 60, False), 3: (True, 100, True), 4: (False, 100, False), 5: (False, 0, False),
            6: (True, 30, True), 7: (True, 5, False), 8: (False, 5, False)}
    found = lambda: {r.request_id: (r.admitted, r.used_after, r.warned) for r in spark.read.parquet(f"{out}/admitted").collect()}
    assert found() == want
    # A replayed batch starts from the usage before it.
    again = spark.createDataFrame([(8, None, "S", 96, minute(5))], feed.schema)
    sink(again, 3)
    assert found() == want


def test_liveness_timer(spark, tmp_path):
    feed = Feed(spark, tmp_path, "device_id long, ts timestamp")
    feed.put([(1, minute(0)), (2, minute(0))])
    feed.put([(1, minute(0, 25)), (3, minute(1))])
    feed.put([(3, minute(2))])
    got = {r.device_id: r.last_heartbeat for r in feed.drain(stateful.stale_devices).collect() if r.device_id != 3}
    assert got == {1: minute(0, 25), 2: minute(0)}


def test_dirty_trigger_of_named_devices(spark, tmp_path):
    feed = Feed(spark, tmp_path, "device_id string, block_number long, ts timestamp")
    feed.put([("d", i, minute(i)) for i in range(6)])
    got = feed.drain(lambda s: stateful.dirty_triggers(s, threshold=4)).collect()
    assert [(r.device_id, r.trigger_no) for r in got] == [("d", 1)]


def test_dirty_trigger_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "device_id long, block_number long, ts timestamp")
    feed.put([(1, i, minute(i)) for i in range(6)])
    feed.put([(1, i, minute(10 + i)) for i in range(12)])
    got = feed.drain(lambda s: stateful.dirty_triggers(s, threshold=4)).collect()
    assert sorted((r.device_id, r.trigger_no) for r in got) == [(1, 1), (1, 2)]


def test_upserts_merge_and_replay(spark, tmp_path, rows):
    path = str(tmp_path / "state")
    by = ["version", "node_id"]
    write = se.upsert_writer(path, ["path"], by)
    first = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 5, 1)], "path string, version long, node_id long")
    second = spark.createDataFrame([("b", 4, 9), ("c", 1, 1)], "path string, version long, node_id long")
    write(first, 0)
    write(second, 1)
    write(second, 1)
    want = [("a", 2, 1), ("b", 5, 1), ("c", 1, 1)]
    assert rows(se.current_state(spark, path, ["path"], by)) == want
    folded = se.compact_state(spark, path, ["path"], by)
    assert rows(se.current_state(spark, folded, ["path"], by)) == want


def test_routing_drops_unknown_types(spark, tmp_path):
    messages = spark.createDataFrame([("file_update", 1), ("noise", 2), ("chunk_update", 3)], "type string, id long")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    se.route({"file_update": sinks.batch_writer(a), "chunk_update": sinks.batch_writer(b)})(messages, 0)
    assert [r.id for r in spark.read.parquet(a).collect()] == [1] and [r.id for r in spark.read.parquet(b).collect()] == [3]


def test_debounce_waits_for_quiet(spark, tmp_path):
    feed = Feed(spark, tmp_path, "path string, timestamp timestamp")
    feed.put([("p", minute(0)), ("p", minute(0, 4)), ("p", minute(0, 8)), ("p", minute(0, 20)), ("q", minute(0, 1))])
    feed.put([("p", minute(40))])
    got = {(r.path, r.changes, r.settled_at) for r in feed.drain(se.debounced).collect()}
    assert got == {("p", 3, minute(0, 13)), ("p", 1, minute(0, 25)), ("q", 1, minute(0, 6))}


def test_progress_ends_at_hundred(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job_id long, size long, is_done boolean")
    feed.put([(1, 10, True), (1, 30, False)])
    feed.put([(1, 60, True)])
    path = str(tmp_path / "progress")
    feed.drain(se.job_progress, sinks.batch_writer(path), mode="update")
    reports = spark.read.parquet(path)
    assert sorted(r.progress for r in reports.collect()) == [25, 70]
    assert latest_by(reports, ["job_id"], ["batch_id"]).first().progress == 70


def test_alerts_use_the_tenants_own_model(spark, tmp_path):
    history = spark.createDataFrame([(1, float(v)) for v in (9, 10, 11)] + [(2, float(v)) for v in (0, 100, 200)], "tenant_id long, size double")
    model = scoring.tenant_model(history, ["tenant_id"], ["size"])
    feed = Feed(spark, tmp_path, "tenant_id long, size double")
    feed.put([(1, 20.0), (2, 20.0), (3, 20.0)])
    got = feed.drain(lambda s: se.anomaly_alerts(s, model, features.logistic(scoring.distance(["size"])))).collect()
    assert [r.tenant_id for r in got] == [1]


def test_dedup_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "digest string, timestamp timestamp")
    feed.put([("a", minute(0)), ("a", minute(1)), ("b", minute(1))])
    feed.put([("a", minute(2)), ("c", minute(2))])
    assert sorted(r.digest for r in feed.drain(se.first_seen).collect()) == ["a", "b", "c"]


def test_dedup_against_the_index_in_any_order(spark, tmp_path):
    feed = Feed(spark, tmp_path, "digest string, timestamp timestamp")
    feed.put([("a", minute(600)), ("a", minute(601)), ("b", minute(0))])
    feed.put([("a", minute(0)), ("c", minute(0)), (None, minute(0))])
    feed.put([("a", minute(1200)), ("d", minute(1)), (None, minute(900))])
    feed.put([("e", minute(2)), ("b", minute(1300)), ("a", minute(1300))])
    path = str(tmp_path / "index")
    sink = se.first_seen_writer(path)
    feed.drain(lambda s: s, sink)
    found = lambda: sorted((r.batch_id, str(r.digest)) for r in spark.read.parquet(path).collect())
    want = [(0, "a"), (0, "b"), (1, "None"), (1, "c"), (2, "d"), (3, "e")]
    assert found() == want
    # A replayed batch is held against the batches before it only.
    sink(spark.createDataFrame([("a", minute(0)), ("c", minute(0)), (None, minute(0))], feed.schema), 1)
    assert found() == want


def test_chunk_dedup_query_over_four_triggers(spark, tmp_path, monkeypatch):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(streams, "BATCH_BYTES", "1")
    got = QUERIES["str_12_chunk_dedup"](spark, str(tmp_path))
    assert got.count() == got.distinct().count() == source.select("l_partkey").distinct().count()


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.event_topic(spark, "localhost:1")


def test_expiry(spark):
    log = sinks.with_expiry(spark.createDataFrame([(1, minute(0)), (2, minute(1))], "id long, timestamp timestamp"))
    # Exactly one hour old has expired.
    assert [r.id for r in sinks.live_updates(log, F.lit(minute(60))).collect()] == [2]
