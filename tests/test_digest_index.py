"""The digest index: exactly the new digests of every batch, merged levels, replays, and reads that follow the batch."""

import random

import numpy as np

from backuplake.session import shared_path
from backuplake.streaming import digest_index as di


def put(spark, root, batch_id, digests, **sizes):
    df = spark.createDataFrame([(d,) for d in digests], "digest string")
    di.add(df, batch_id, root, **{"prefixes": 4, "fanout": 3, "group_rows": 64, **sizes})


def found(spark, root, batch_id):
    return sorted((r.digest for r in di.new_digests(spark, root, "string").filter(f"batch_id = {batch_id}").collect()), key=str)


def test_new_digests_of_every_batch_through_merges_and_replays(spark):
    rng, root, seen = random.Random(5), shared_path(spark, "di"), set()
    levels = set()
    for batch in range(10):
        digests = [f"d{rng.randrange(3000)}" for _ in range(400)] + ([None, None] if batch % 3 == 1 else [])
        expected = sorted(set(digests) - seen, key=str)
        put(spark, root, batch, digests)
        if batch in (2, 5):
            put(spark, root, batch, digests)
        assert found(spark, root, batch) == expected
        seen |= set(digests)
        files = di.manifest(spark, root, batch).collect()
        levels |= {f.level for f in files}
        assert all(sum(f.level == x and f.prefix == p for f in files) < 3 for x in range(4) for p in range(4))
        assert sum(f.rows for f in files) == len(seen)
    assert levels >= {0, 1, 2}
    held = [r.digest for r in di.read(spark, root, 9, "string").collect()]
    assert len(held) == len(seen) and set(held) == seen


def test_bytes_read_follow_the_batch(spark):
    root = shared_path(spark, "di")
    put(spark, root, 0, [f"d{i}" for i in range(40_000)], group_rows=256)
    put(spark, root, 1, ["d17"], group_rows=256)
    put(spark, root, 2, [f"other{i}" for i in range(40)], group_rows=256)
    put(spark, root, 3, [f"d{i}" for i in range(40_000)], group_rows=256)
    size = {r.batch_id: r.n for r in di.reads(spark, root).groupBy("batch_id").agg({"bytes_read": "sum"}).withColumnRenamed("sum(bytes_read)", "n").collect()}
    assert size[0] == 0 and 0 < size[1] < size[3] / 50
    # Forty new digests: filters, and a row group now and then for a false yes.
    assert size[2] < size[3] / 4
    assert found(spark, root, 1) == [] and len(found(spark, root, 2)) == 40 and found(spark, root, 3) == []


def test_an_empty_batch_keeps_the_index(spark):
    root = shared_path(spark, "di")
    put(spark, root, 0, ["a", "b"])
    put(spark, root, 1, [])
    put(spark, root, 2, ["a", "c"])
    assert found(spark, root, 2) == ["c"]


def test_filters_never_miss():
    rng = np.random.default_rng(3)
    own, other = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    block = di.bloom(own, 50_000)
    assert di.may_hold(block, own).all() and di.may_hold(block, other).mean() < 0.02
