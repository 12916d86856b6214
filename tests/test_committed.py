"""The committing sink: replays, lost tries, streams that stop and go on."""

import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from backuplake.session import shared_path
from backuplake.sources import committed

SCHEMA = "id bigint, kind string"


def rows_of(spark, root):
    return sorted((r.id, r.log, r.batch) for r in committed.read(spark, root, SCHEMA).collect())


def batch(ids):
    return pa.record_batch({"id": pa.array(ids, pa.int64()), "kind": pa.array(["a"] * len(ids))})


def test_a_batch_counts_once(spark):
    root = shared_path(spark, "committed")
    rows = spark.range(100).select("id", F.lit("a").alias("kind")).repartition(4)
    for _ in range(3):
        committed.append(rows, root, "alerts", 0)
    committed.append(rows.filter("id < 5"), root, "alerts", 1)
    committed.append(rows.filter("id < 5"), root, "other", 1)
    committed.append(rows.limit(0), root, "alerts", 2)
    want = [(i, "alerts", 0) for i in range(100)] + [(i, log, 1) for log in ("alerts", "other") for i in range(5)]
    assert rows_of(spark, root) == sorted(want)
    kept = committed.commits(spark, root)
    assert kept.agg(F.sum("rows")).first()[0] == 110
    # Two of three tries of the first batch left their files behind.
    assert committed.orphans(spark, root).count() == 2 * kept.filter("log = 'alerts' AND batch = 0").count()


def test_tries_that_never_commit_do_not_count(spark):
    root = shared_path(spark, "committed")
    first, second = committed.StreamFiles(root, "s"), committed.StreamFiles(root, "s")
    lost = [first.write(iter([batch([1, 2])])), None]
    first.abort(lost, 0)
    good = [second.write(iter([batch([1, 2]), batch([]), batch([3])])), second.write(iter([]))]
    second.commit(good, 0)
    # The driver died after the commit and tries the batch again.
    again = committed.StreamFiles(root, "s")
    again.commit([again.write(iter([batch([1, 2, 3])]))], 0)
    assert rows_of(spark, root) == [(i, "s", 0) for i in (1, 2, 3)]
    assert committed.orphans(spark, root).count() == 2


def test_a_stream_that_stops_goes_on(spark):
    root, check, source = (shared_path(spark, p) for p in ("committed", "check", "source"))
    spark.range(50).withColumn("kind", F.lit("a")).coalesce(1).write.parquet(source)

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        committed.stream_to_end(stream, root, "alerts", check)

    go()
    spark.range(50, 80).withColumn("kind", F.lit("b")).repartition(3).write.mode("append").parquet(source)
    go()
    assert [i for i, *_ in rows_of(spark, root)] == list(range(80))
    go()
    assert [i for i, *_ in rows_of(spark, root)] == list(range(80))
    # The checkpoint forgets its last commit, as if the driver had died before it was noted.
    local = pathlib.Path(check.removeprefix("file:"))
    last = max((local / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert [i for i, *_ in rows_of(spark, root)] == list(range(80))
    assert committed.orphans(spark, root).count() == 1


def test_wrong_use(spark):
    with pytest.raises(Exception, match="option batch"):
        spark.dataSource.register(committed.CommittedFiles)
        spark.range(1).write.format(committed.NAME).option("path", "/tmp/none").mode("append").save()
    with pytest.raises(ValueError, match="only adds"):
        committed.StreamFiles("/tmp/none", "s", True)
    with pytest.raises(ValueError, match="not a name"):
        committed.StreamFiles("/tmp/none", "a/b")
