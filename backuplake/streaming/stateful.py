"""Stateful streams: liveness with timers, quota admission, dirty-block triggers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from backuplake.operators.ordered import running_totals
from backuplake.operators.windows import consume_quota
from backuplake.sources.sinks import batch_writer

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and state variables need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Liveness(StatefulProcessor):
    """Remembers a device's last heartbeat and reports it when it has been silent too long."""

    def __init__(self, seconds: int):
        self.wait_ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["ts"].max().timestamp() * 1000) for pdf in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.wait_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"device_id": [key[0]], "last_heartbeat": [pd.Timestamp(ms, unit="ms")]})

    def close(self) -> None:
        pass


def stale_devices(heartbeats: DataFrame, seconds: int = 30, delay: str = "10 seconds") -> DataFrame:
    """A row per silence longer than `seconds` of event time. `heartbeats`: device_id, ts."""
    use_rocksdb(heartbeats.sparkSession)
    beats = heartbeats.select("device_id", "ts").withWatermark("ts", delay)
    key = beats.schema["device_id"].dataType.simpleString()
    return beats.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Liveness(seconds),
        outputStructType=f"device_id {key}, last_heartbeat timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )


#: Planned files for which a job keeps a list of its own, and names a task holds before it looks into the lists.
LIST_FILES, HELD_FILES = 512, 1 << 18


class Progress(StatefulProcessor):
    """Counts a job's finished files against its plan, each file once, until all are done.

    The files seen are kept in a map of lists, so a trigger reads and writes only the lists its files fall in. The plan says
    how many lists a job has: one for `LIST_FILES` files, up to `buckets`, so small jobs are not scattered over many
    calls. With the last file all state of the job goes; without it, after `ttl_ms`, if that is given.
    """

    def __init__(self, buckets: int, ttl_ms: int | None):
        self.buckets, self.ttl_ms = buckets, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = "files bigint, bytes bigint"
        self.plan = handle.getValueState("plan", pair, self.ttl_ms)
        self.done = handle.getValueState("done", pair, self.ttl_ms)
        self.seen = handle.getMapState("seen", "bucket int", "files array<string>", self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.plan.update((int(row["total_files"]), int(row["total_bytes"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.plan.exists():
            # Not planned, or finished.
            return
        total_files, total_bytes = self.plan.get()
        known = self.done.exists()
        files, size = self.done.get() if known else (0, 0)
        before, lists, stored = files, max(1, min(self.buckets, -(-total_files // LIST_FILES))), known
        named: dict[str, int] = {}
        for last, pdf in _and_last(rows):
            for name, bytes_ in zip(pdf["file_id"].tolist(), pdf["size"].tolist()):
                named.setdefault(name, bytes_)
            if len(named) < HELD_FILES and not last:
                continue
            fresh, named = self._fresh(named, lists, stored), {}
            files += sum(len(sizes) for _, sizes in fresh.values())
            size += sum(sum(sizes.values()) for _, sizes in fresh.values())
            if last and files >= total_files:
                # All state goes, so nothing is added to it.
                break
            for bucket, (held, sizes) in fresh.items():
                self.seen.updateValue((bucket,), (held + list(sizes),))
            stored = stored or bool(fresh)
        if files == before:
            return
        percent = 100 if files >= total_files else min(99, size * 100 // total_bytes if total_bytes else 0)
        if percent == 100:
            self.plan.clear()
            if known:
                self.done.clear()
            if stored:
                self.seen.clear()
        else:
            self.done.update((files, size))
        yield pd.DataFrame(
            {
                "job_id": [key[0]], "processed_files": [files], "total_files": [total_files],
                "processed_bytes": [size], "total_bytes": [total_bytes], "progress": [percent],
            }
        )

    def _fresh(self, named: dict[str, int], lists: int, stored: bool) -> dict[int, tuple[list[str], dict[str, int]]]:
        """By list: the files it holds, and those it does not hold yet with their sizes."""
        parts: dict[int, dict[str, int]] = {0: named} if lists == 1 else {}
        for name, bytes_ in named.items() if lists > 1 else ():
            parts.setdefault(zlib.crc32(name.encode()) % lists, {})[name] = bytes_
        out = {}
        for bucket, sizes in parts.items():
            held = list(self.seen.getValue((bucket,))[0]) if stored and self.seen.containsKey((bucket,)) else []
            for name in held:
                sizes.pop(name, None)
            if sizes:
                out[bucket] = (held, sizes)
        return out

    def close(self) -> None:
        pass


def _and_last(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Each part, and whether it is the last one."""
    parts = iter(parts)
    now = next(parts, None)
    while now is not None:
        after = next(parts, None)
        yield after is None, now
        now = after


def progress_until_done(files: DataFrame, plan: DataFrame, buckets: int = 64, ttl: str | None = None) -> DataFrame:
    """A report per trigger of each job that came further, the last one at 100; then nothing is kept of the job.

    `files`: job_id, file_id, size of finished files, in any order and any number of times; a null id is a file,
    a null size is 0. `plan`: job_id, total_files, total_bytes, one row per job; it starts the state, and jobs
    without a plan are not reported. Percent is of bytes, rounded down, and 100 only with the last file. Jobs
    that nothing is heard of lose their state after `ttl` (as "30 days") of processing time. With a `ttl` Spark goes on
    making batches without rows, so a stream over available input then needs
    `spark.sql.streaming.noDataMicroBatches.enabled` off to end. A job's files of one trigger are read by one
    task, in batches.
    """
    use_rocksdb(files.sparkSession)
    kind = files.schema["job_id"].dataType.simpleString()
    rows = files.select(
        "job_id",
        # A null id is no file of that name.
        F.coalesce(F.col("file_id").cast("string"), F.lit("\0")).alias("file_id"),
        F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"),
    )
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    start = plan.select("job_id", F.col("total_files").cast("bigint"), F.col("total_bytes").cast("bigint"))
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=Progress(buckets, ms),
        outputStructType=f"job_id {kind}, processed_files bigint, total_files bigint, processed_bytes bigint, total_bytes bigint, progress bigint",
        outputMode="Update",
        timeMode="ProcessingTime" if ttl else "None",
        initialState=start.groupBy("job_id"),
    )


def admission_writer(
    path: str, limits: DataFrame | None = None, default_limit: int = 1 << 30, warn_share: float = 0.8
) -> Callable[[DataFrame, int], None]:
    """Quota admission in arrival order, as a `foreachBatch` target: a hot tenant is cut into blocks.

    Batches of `requests` (request_id, tenant_id, resource, amount, ts) are sorted by time. Each batch
    writes its requests to `path`/admitted and the usage after it to `path`/usage; it starts from the
    usage of the newest batch before it, so a replayed batch gives the same rows. `limits`
    (tenant_id, resource, quota_limit) is read anew for each batch.
    """
    keys = ["tenant_id", "resource"]
    write, keep = batch_writer(f"{path}/admitted"), batch_writer(f"{path}/usage")

    def step(batch: DataFrame, batch_id: int) -> None:
        used = _before(batch.sparkSession, f"{path}/usage", batch_id)
        out = consume_quota(batch, limits, keys=keys, default_limit=default_limit, warn_share=warn_share, used=used)
        write(out, batch_id)
        done = batch.sparkSession.read.schema(out.schema).parquet(f"{path}/admitted/batch_id={batch_id}")
        now = done.filter("admitted").groupBy(*keys).agg(F.sum("amount").alias("used"))
        keep((now if used is None else now.unionByName(used)).groupBy(*keys).agg(F.sum("used").alias("used")), batch_id)

    return step


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the newest batch before this one wrote to `path`."""
    for earlier in range(batch_id - 1, -1, -1):
        try:
            return spark.read.parquet(f"{path}/batch_id={earlier}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def dirty_trigger_writer(path: str, threshold: int = 1000) -> Callable[[DataFrame, int], None]:
    """Triggers on the write stream, as a `foreachBatch` target: a hot device is cut into blocks.

    Batches of `writes` (device_id, block_number, ts). Blocks that no earlier batch saw are numbered per device, in order
    of time within the batch, on from the count of the batches before; every `threshold + 1`-th one fires. Each batch
    writes its new blocks to `path`/dirty, the counts after it to `path`/counts and what fired to `path`/triggers, and reads
    only what earlier batches wrote, so a replayed batch gives the same rows. Rows without a device or block are no writes.
    """
    keys = ["device_id", "block_number"]
    dirty, counts, fired = (batch_writer(f"{path}/{name}") for name in ("dirty", "counts", "triggers"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter("device_id IS NOT NULL AND block_number IS NOT NULL").groupBy(*keys).agg(F.min("ts").alias("ts"))
        if batch_id:
            kinds = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in keys)
            # Both sides are unique, so there is no hot key.
            stored = spark.read.schema(f"{kinds}, batch_id int").parquet(f"{path}/dirty").filter(F.col("batch_id") < batch_id)
            fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        dirty(fresh, batch_id)
        fresh = spark.read.parquet(f"{path}/dirty/batch_id={batch_id}")
        numbered = running_totals(fresh, ["device_id"], ["ts", "block_number"], {"number": F.lit(1).cast("bigint")})
        before = _before(spark, f"{path}/counts", batch_id)
        now = fresh.groupBy("device_id").agg(F.count(F.lit(1)).alias("seen"))
        if before is not None:
            # One written row per device, so a hot device of the batch can be split.
            numbered = numbered.join(before, "device_id", "left").withColumn("number", F.col("number") + F.coalesce("seen", F.lit(0))).drop("seen")
            now = now.unionByName(before).groupBy("device_id").agg(F.sum("seen").alias("seen"))
        hits = numbered.filter(F.col("number") % (threshold + 1) == 0)
        fired(hits.select(*keys, "ts", F.floor(F.col("number") / (threshold + 1)).alias("trigger_no")), batch_id)
        counts(now, batch_id)

    return step


def dirty_triggers(writes: DataFrame, threshold: int = 1000) -> DataFrame:
    """Incremental triggers on the write stream.

    Which blocks are dirty is kept per (device, block) by the de-duplication, spread over all
    tasks; a device's own state is one counter. `writes`: device_id, block_number, ts.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "block_number"], kind="stable")
        seen = state.get[0] if state.exists else 0
        number = seen + pd.Series(range(1, len(rows) + 1))
        state.update((seen + len(rows),))
        fires = (number % (threshold + 1) == 0).tolist()
        hits = rows[fires]
        yield pd.DataFrame(
            {
                "device_id": hits["device_id"].tolist(),
                "block_number": hits["block_number"].tolist(),
                "trigger_no": (number[fires] // (threshold + 1)).tolist(),
            }
        )

    kind = {f.name: f.dataType.simpleString() for f in writes.schema.fields}
    first = writes.select("device_id", "block_number", "ts").dropDuplicates(["device_id", "block_number"])
    return first.groupBy("device_id").applyInPandasWithState(
        step,
        f"device_id {kind['device_id']}, block_number {kind['block_number']}, trigger_no bigint",
        "seen bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
