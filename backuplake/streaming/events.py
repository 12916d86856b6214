"""Streaming operators made of built-in ones. Column logic is shared with the batch twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.operators import aggregates
from backuplake.operators.windows import latest_by
from backuplake.session import shared_path
from backuplake.sources.sinks import batch_writer


def with_lateness(events: DataFrame, ts: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """Rows older than the newest event less `delay` may be dropped by what follows."""
    return events.withWatermark(ts, delay)


def windowed_stats(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding statistics per tenant and type; late rows are dropped."""
    return aggregates.windowed_stats(with_lateness(events, "timestamp", delay), width, slide)


def anomaly_alerts(events: DataFrame, model: DataFrame, score: Column, threshold: float = 0.95) -> DataFrame:
    """Events scored against their tenant's model, kept above the threshold.

    `model` has one row per tenant and is a plain table, so the join is stream to static.
    """
    return events.join(model, "tenant_id", "inner").withColumn("anomaly_score", score).filter(
        F.col("anomaly_score") > threshold
    )


def upsert_writer(path: str, keys: Sequence[str], by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Upserts as one delta per batch: its newest row per key. Readers merge the deltas, so a
    batch costs what it holds, not what the table holds, and a replayed batch changes nothing."""
    write = batch_writer(path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write(latest_by(batch, keys, by), batch_id)

    return upsert


def current_state(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The newest row per key over all deltas."""
    return latest_by(spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id"), keys, by)


def compact_state(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str]) -> str:
    """Folds all deltas into one under a new path, which is returned.

    Its number is below that of any batch, so a new stream on that path replaces nothing.
    """
    target = shared_path(spark, "state")
    current_state(spark, path, keys, by).write.mode("errorifexists").parquet(f"{target}/batch_id=-1")
    return target


def route(paths: dict[str, Callable[[DataFrame, int], None]], kind: str = "type") -> Callable[[DataFrame, int], None]:
    """Sends each message type to its own writer; unknown types are dropped."""

    def send(batch: DataFrame, batch_id: int) -> None:
        for name, write in paths.items():
            write(batch.filter(F.col(kind) == name), batch_id)

    return send


def change_log(messages: DataFrame, key: Column, change: Column) -> DataFrame:
    """One log entry per change of any map: type, key, time and the change as JSON."""
    return messages.select("id", "type", key.alias("key"), "timestamp", F.to_json(change).alias("changes"))


def debounced(changes: DataFrame, ts: str = "timestamp", quiet: str = "5 seconds", delay: str = "10 minutes") -> DataFrame:
    """One row per burst of changes to a path, closed after the quiet period."""
    return (
        with_lateness(changes, ts, delay)
        .groupBy(F.session_window(ts, quiet).alias("w"), "path")
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("path", F.col("w.start").alias("first_change"), F.col("w.end").alias("settled_at"), "changes")
    )


def job_progress(files: DataFrame) -> DataFrame:
    """Progress per job, for update mode: each batch reports the jobs it touched."""
    done = F.col("is_done")
    sums = files.groupBy("job_id").agg(
        F.count_if(done).alias("processed_files"),
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("processed_bytes"),
        F.sum("size").alias("total_bytes"),
    )
    percent = F.floor(F.try_divide(F.col("processed_bytes") * 100.0, F.col("total_bytes")))
    return sums.withColumn("progress", F.coalesce(percent, F.lit(0)).cast("bigint"))


def first_seen(chunks: DataFrame, ts: str = "timestamp", delay: str = "10 minutes", key: str = "digest") -> DataFrame:
    """Chunks whose digest has not come within the watermark, for streams in order of time: late rows are
    dropped, and a digest that returns later comes again. `first_seen_writer` is exact in any order."""
    return with_lateness(chunks, ts, delay).dropDuplicatesWithinWatermark([key])


def first_seen_writer(path: str, key: str = "digest") -> Callable[[DataFrame, int], None]:
    """Chunk dedup in any order, as a `foreachBatch` target: the digests of a batch that the index lacks.

    The index is what earlier batches wrote to `path`, one folder per batch, so a replayed batch gives
    the same rows. A null digest counts as one.
    """
    write = batch_writer(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(key).distinct()
        if batch_id:
            kind = batch.schema[key].dataType.simpleString()
            stored = batch.sparkSession.read.schema(f"`{key}` {kind}, batch_id bigint").parquet(path)
            index = stored.filter(F.col("batch_id") < batch_id).select(F.col(key).alias("_stored"))
            # Both sides are unique, so there is no hot key.
            fresh = fresh.join(index, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
        write(fresh, batch_id)

    return step
