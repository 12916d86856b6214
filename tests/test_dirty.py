"""Dirty-block triggers in blocks: several batches, replays, a hot device."""

import datetime as dt
import random

from pyspark.sql import functions as F

from backuplake.operators import ordered
from backuplake.session import shared_path
from backuplake.streaming.stateful import dirty_trigger_writer

SCHEMA = "device_id long, block_number long, ts timestamp"


def test_batches_go_on_counting(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 30)
    rng, at = random.Random(3), dt.datetime(2024, 1, 1)
    batches = [[(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(120), None]), at + dt.timedelta(seconds=rng.randrange(900))) for _ in range(200)] for _ in range(4)]
    path = shared_path(spark, "dirty")
    step = dirty_trigger_writer(path, threshold=9)
    for i in (0, 1, 1, 2, 3, 3):
        # A replayed batch comes again in another order.
        rng.shuffle(batches[i])
        step(spark.createDataFrame(batches[i], SCHEMA).repartition(3), i)
    seen, counts, want = set(), {}, []
    for batch in batches:
        first = {}
        for device, block, ts in batch:
            if device is not None and block is not None and (device, block) not in seen:
                first[device, block] = min(ts, first.get((device, block), ts))
        for (device, block), ts in sorted(first.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            counts[device] = counts.get(device, 0) + 1
            if counts[device] % 10 == 0:
                want.append((device, block, counts[device] // 10))
        seen |= set(first)
    got = spark.read.parquet(f"{path}/triggers")
    assert rows(got, "device_id", "block_number", "trigger_no") == sorted(want)
    assert len(want) > 12
    last = spark.read.parquet(f"{path}/counts").filter("batch_id = 3")
    assert {r.device_id: r.seen for r in last.collect()} == counts
    assert spark.read.parquet(f"{path}/dirty").agg(F.count_distinct("device_id", "block_number"), F.count(F.lit(1))).first() == (len(seen), len(seen))
