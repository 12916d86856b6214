"""Progress until all is done: several triggers out of order, replays, and what is left in the state."""

import random

import pytest
from pyspark.sql import functions as F

from backuplake.session import shared_path
from backuplake.sources.sinks import batch_writer
from backuplake.streaming import stateful
from backuplake.streaming.run import start

SCHEMA = "job_id bigint, file_id string, size bigint"


@pytest.fixture()
def quiet(spark):
    """With a time to live there would be batches without rows for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.mark.parametrize("ttl", [None, "30 days"])
def test_reports_end_and_state_goes(spark, quiet, ttl):
    rng = random.Random(2)
    planned = {job: [(job, f"f{i}", rng.randrange(0, 1000)) for i in range(rng.choice([1, 3, 40]))] for job in range(12)}
    planned[12] = [(12, f"f{i}", 10) for i in range(2000)]
    planned[13] = [(13, None, None), (13, "a", 0)]
    missing = {job: (1 if job % 4 == 0 else 0) for job in planned}
    rows = [r for job, files in planned.items() for r in files[missing[job] :]]
    # Files named again, and a job without a plan.
    rows += rng.sample(rows, 300) + [(99, "x", 5)]
    rng.shuffle(rows)
    source, check, out = (shared_path(spark, p) for p in ("files", "check", "out"))
    for i in range(4):
        spark.createDataFrame(rows[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    # Every finished job is named once more at the very end.
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    plan = spark.createDataFrame([(j, len(f), sum(s or 0 for *_, s in f)) for j, f in planned.items()], "job_id bigint, total_files bigint, total_bytes bigint")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    reports = stateful.progress_until_done(stream, plan, buckets=8, ttl=ttl)
    start(reports, "progress" + out[-8:], batch_writer(out), check, "update", None).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select("job_id", "batch_id", "processed_files", "processed_bytes", "progress").collect()]
    assert max(b for _, b, *_ in got) <= 3
    for job, files in planned.items():
        seen = sorted(r[1:] for r in got if r[0] == job)
        done = files[missing[job] :]
        assert [r[1] for r in seen] == sorted({r[1] for r in seen})
        if not done:
            assert not seen
            continue
        assert seen[-1][1:3] == (len(done), sum(s or 0 for *_, s in done))
        assert (seen[-1][3] == 100) == (not missing[job]) and all(r[3] < 100 for r in seen[:-1])
    assert not [r for r in got if r[0] == 99]
    left = {name: spark.read.format("statestore").option("stateVarName", name).load(check) for name in ("plan", "done", "seen")}
    unfinished = {j for j in planned if missing[j]}
    jobs = {name: {r[0] for r in df.select(F.col("key.job_id")).collect()} for name, df in left.items()}
    assert jobs["plan"] == unfinished
    assert jobs["done"] == jobs["seen"] == {j for j in unfinished if len(planned[j]) > 1}
