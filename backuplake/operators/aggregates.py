"""Aggregations. All use partial aggregation; none gathers a group's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions import text
from backuplake.operators.ordered import indexed_with_next


def count_if(test: Column) -> Column:
    return F.count_if(test)


def windowed_stats(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Backup counts, sizes and durations per tenant and type in sliding windows.

    The same expression serves batch and streaming input. Streaming needs one sliding
    `window` node; batch rows are first summed per slide step, so only the sums, not the
    rows, are copied into the windows that overlap.
    """
    keys = ["tenant_id", "backup_type"]
    aggs = [
        F.count(F.lit(1)).alias("backup_count"),
        F.avg("size").alias("avg_size"),
        F.sum("size").alias("total_size"),
        F.avg("duration").alias("avg_duration"),
    ]
    if events.isStreaming:
        grouped = events.groupBy(F.window("timestamp", width, slide).alias("w"), *keys).agg(*aggs)
    else:
        steps = events.groupBy(F.window("timestamp", slide).alias("s"), *keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("size"),
            F.count("size").alias("n_size"),
            F.sum("duration").alias("duration"),
            F.count("duration").alias("n_duration"),
        )
        grouped = (
            steps.withColumn("at", F.col("s.start"))
            .groupBy(F.window("at", width, slide).alias("w"), *keys)
            .agg(
                F.sum("n").alias("backup_count"),
                F.try_divide(F.sum("size").cast("double"), F.sum("n_size")).alias("avg_size"),
                F.sum("size").alias("total_size"),
                F.try_divide(F.sum("duration").cast("double"), F.sum("n_duration")).alias("avg_duration"),
            )
        )
    return grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *keys,
        "backup_count",
        "avg_size",
        "total_size",
        "avg_duration",
    )


def bytes_per_device(snapshots: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Total bytes per device; given a device list, devices without snapshots show null."""
    sums = snapshots.groupBy("device_id").agg(F.sum("size").alias("total_size"))
    return devices.select("device_id").join(sums, "device_id", "left") if devices is not None else sums


def count_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status", "device_id").agg(F.count(F.lit(1)).alias("job_count"))


def fleet_stats(devices: DataFrame, files: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of fleet totals; last activity is null when there is none."""
    live = files.filter(~F.col("is_deleted"))
    parts = [
        devices.agg(
            F.count(F.lit(1)).alias("total_devices"),
            count_if(F.col("is_online")).alias("online_devices"),
            F.max("last_sync").alias("_sync"),
        ),
        live.agg(
            F.count(F.lit(1)).alias("total_files"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
            F.max("backup_time").alias("_backup"),
        ),
        chunks.agg(F.count(F.lit(1)).alias("total_chunks")),
        jobs.agg(
            *[
                count_if(F.col("status") == status).alias(name)
                for status, name in [
                    ("RUNNING", "active_jobs"),
                    ("COMPLETED", "completed_jobs"),
                    ("FAILED", "failed_jobs"),
                ]
            ]
        ),
    ]
    row = parts[0]
    for part in parts[1:]:
        # One row each.
        row = row.join(F.broadcast(part), F.lit(True), "left")
    return row.withColumn("last_activity", F.greatest("_sync", "_backup")).drop("_sync", "_backup")


def backup_metrics(jobs: DataFrame) -> DataFrame:
    """Job totals over all devices. `jobs`: status, size, stored_size, duration, device_id."""
    done = F.col("status") == "COMPLETED"
    return jobs.agg(
        count_if(done).alias("completed"),
        count_if(F.col("status") == "FAILED").alias("failed"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("bytes_backed_up"),
        F.try_divide(F.sum(F.when(done, F.col("size"))).cast("double"), F.sum(F.when(done, F.col("stored_size")))).alias(
            "compression_ratio"
        ),
        F.avg(F.when(done, F.col("duration"))).alias("average_duration"),
        count_if(F.col("status") == "RUNNING").alias("active"),
        count_if(F.col("status") == "QUEUED").alias("queued"),
        F.count_distinct("device_id").alias("devices"),
    )


def success_rate(completed: Column, failed: Column) -> Column:
    """Completed share in percent; zero when nothing finished."""
    total = completed + failed
    return F.when(total > 0, completed.cast("double") / total * 100).otherwise(F.lit(0.0))


def storage_use(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Capacity, used and free bytes and the used percentage."""
    return df.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("used").alias("used")).withColumns(
        {
            "free": F.col("capacity") - F.col("used"),
            "used_percent": F.try_divide(F.col("used").cast("double"), F.col("capacity")) * 100,
        }
    )


def key_metrics(keys: DataFrame) -> DataFrame:
    return keys.agg(
        F.count_distinct("device_id").alias("devices"),
        F.count(F.lit(1)).alias("keys"),
        count_if(F.col("is_active")).alias("active_keys"),
    )


def reference_counts(changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Net references per chunk from +1 and -1 changes, and how many files hold it.

    The list of files stays a relation: a chunk of zeros may sit in a third of all files.
    """
    return changes.groupBy(key).agg(
        F.sum("delta").alias("ref_count"), F.count_distinct("file").alias("file_count")
    )


def dedup_stats(refs: DataFrame, digest: str = "digest", size: str = "size") -> DataFrame:
    """Logical against unique bytes. First level: one row per digest, summed map-side."""
    unique = refs.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("one"), F.sum(size).alias("all"))
    totals = unique.agg(
        F.sum("n").alias("total_chunks"),
        F.count(F.lit(1)).alias("unique_chunks"),
        F.sum("all").alias("logical_bytes"),
        F.sum("one").alias("unique_bytes"),
    )
    return totals.withColumns(
        {
            "dedup_ratio": F.try_divide(F.col("logical_bytes").cast("double"), F.col("unique_bytes")),
            "saved_bytes": F.col("logical_bytes") - F.col("unique_bytes"),
            "saved_share": F.try_divide(
                (F.col("logical_bytes") - F.col("unique_bytes")).cast("double"), F.col("logical_bytes")
            ),
        }
    )


def synthetic_ratios(stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """Ratios of a synthetic backup: `stored` has size, packed_size, digest per chunk of the
    result, `inputs` has size per file of base and incrementals."""
    unique = stored.groupBy("digest").agg(
        F.max("size").alias("one"), F.sum("size").alias("all"), F.sum("packed_size").alias("packed")
    )
    totals = unique.agg(
        F.sum("all").alias("logical_bytes"), F.sum("one").alias("unique_bytes"), F.sum("packed").alias("_packed")
    )
    source = inputs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("input_bytes"))
    logical = F.col("logical_bytes").cast("double")
    # One row each.
    row = totals.join(F.broadcast(source), F.lit(True), "left")
    return row.select(
        "logical_bytes",
        "unique_bytes",
        F.try_divide(logical, F.col("unique_bytes")).alias("dedup_ratio"),
        F.try_divide(logical, F.col("_packed")).alias("compression_ratio"),
        "input_bytes",
        (F.col("input_bytes") - F.col("unique_bytes")).alias("space_saved"),
    )


def series_features(df: DataFrame, keys: Sequence[str], size: str, duration: str) -> DataFrame:
    """Size and duration statistics per series, with sample-corrected shape measures.

    Shape is null below three (four) values and zero for a constant series.
    """
    n = F.count(duration).cast("double")
    flat = F.min(duration) == F.max(duration)
    skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness(duration) * F.sqrt(n * (n - 1)) / (n - 2)))
    kurt = F.when(
        n >= 4,
        F.when(flat, 0.0).otherwise(((n + 1) * F.kurtosis(duration) + 6) * (n - 1) / ((n - 2) * (n - 3))),
    )
    return df.groupBy(*keys).agg(
        F.avg(size).alias("size_mean"),
        F.stddev(size).alias("size_std"),
        F.min(size).alias("size_min"),
        F.max(size).alias("size_max"),
        F.avg(duration).alias("duration_mean"),
        F.stddev(duration).alias("duration_std"),
        skew.alias("duration_skew"),
        kurt.alias("duration_kurtosis"),
    )


def series_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Slope against the row index and lag-1 autocorrelation; both zero for one row.

    The autocorrelation of a constant series is null.
    """
    rows = indexed_with_next(df.select(*keys, *order, value), keys, order, value)
    many = F.count(F.lit(1)) > 1
    now, nxt = F.col(value).cast("double"), F.col("next_value").cast("double")
    # `corr` divides by the deviations and fails on a constant series.
    paired = F.when(nxt.isNotNull(), now)
    spread = F.sqrt(F.var_pop(paired)) * F.sqrt(F.var_pop(nxt))
    return rows.groupBy(*keys).agg(
        F.when(many, F.regr_slope(now, F.col("idx").cast("double"))).otherwise(F.lit(0.0)).alias("trend_slope"),
        F.when(many, F.try_divide(F.covar_pop(paired, nxt), spread)).otherwise(F.lit(0.0)).alias("lag1_autocorrelation"),
    )


def evaluate(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and R2 in one pass."""
    err = F.col(label) - F.col(prediction)
    return df.groupBy(*keys).agg(
        F.avg(err * err).alias("mse"),
        F.when(F.var_pop(label) > 0, 1 - F.avg(err * err) / F.var_pop(label)).alias("r2"),
    )


def schedule_totals(jobs: DataFrame) -> DataFrame:
    """Expected gain of the optimised schedule; a zero total gives a null reduction."""
    before = F.sum(F.coalesce("estimated_duration", F.lit(300)))
    after = before * 0.85
    return jobs.agg(
        before.alias("time_before"), after.alias("time_after"), F.try_divide(before - after, before).alias("time_reduction")
    )


def health(services: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Healthy when up and every service is true."""
    return services.groupBy(*keys).agg(
        (F.bool_and("is_up") & F.bool_and("service_ok")).alias("healthy"),
        F.count(F.lit(1)).alias("services"),
        count_if(~F.col("service_ok")).alias("failing"),
    )


def model_usage(log: DataFrame) -> DataFrame:
    """Usage counters over the prediction log."""
    return log.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        count_if(F.col("is_anomaly")).alias("total_anomalies"),
        F.count_distinct("model").alias("active_models"),
    )


def dashboard(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count_distinct("job_id").alias("total_backups"),
        F.sum("size").alias("total_bytes"),
        F.count_distinct("path").alias("files_protected"),
        F.max("created_at").alias("last_backup"),
    )


def job_progress(files: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Progress per job. `files`: size, is_done, done_at."""
    done = F.col("is_done")
    sums = files.groupBy(*keys).agg(
        count_if(done).alias("processed_files"),
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("processed_bytes"),
        F.sum("size").alias("total_bytes"),
        (F.unix_timestamp(F.max(F.when(done, F.col("done_at")))) - F.unix_timestamp(F.min(F.when(done, F.col("done_at")))))
        .alias("_seconds"),
    )
    rate = F.try_divide(F.col("processed_bytes").cast("double"), F.col("_seconds"))
    percent = F.coalesce(F.floor(F.try_divide(F.col("processed_bytes") * 100.0, F.col("total_bytes"))), F.lit(0))
    return sums.withColumns(
        {
            "progress": percent.cast("bigint"),
            "bytes_per_second": rate,
            "eta_seconds": F.try_divide((F.col("total_bytes") - F.col("processed_bytes")).cast("double"), rate),
        }
    ).drop("_seconds")


def job_statistics(files: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Outcome counts, sizes and ratio per job. `files`: outcome, size, stored_size, at."""
    ok = F.col("outcome") == "processed"
    return files.groupBy(*keys).agg(
        count_if(ok).alias("files_processed"),
        count_if(F.col("outcome") == "skipped").alias("files_skipped"),
        count_if(F.col("outcome") == "error").alias("files_errored"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("original_size"),
        F.coalesce(F.sum(F.when(ok, F.col("stored_size"))), F.lit(0)).alias("stored_size"),
        F.try_divide(F.sum(F.when(ok, F.col("size"))).cast("double"), F.sum(F.when(ok, F.col("stored_size")))).alias(
            "compression_ratio"
        ),
        (F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))).alias("duration_seconds"),
    )


def directory_tree(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Direct files and child directories per directory down to a depth; the root is `/`.

    Directories at the last level are listed with no content, as the tree stops there.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    folder = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    # Files of one folder shrink to one row before prefixes are made.
    folders = files.select(folder.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    levels = F.sequence(F.lit(0), F.least(F.size("f"), F.lit(max_depth)))
    chain = folders.select("f", "n", F.explode(levels).alias("depth"))
    nodes = chain.select(
        "depth",
        F.slice("f", F.lit(1), F.col("depth")).alias("dir"),
        F.when(F.col("depth") == F.size("f"), F.col("n")).otherwise(0).alias("direct"),
        F.when(F.col("depth") < F.size("f"), F.get("f", F.col("depth"))).alias("child"),
    )
    inside = F.col("depth") < max_depth
    return nodes.groupBy("depth", "dir").agg(
        F.sum(F.when(inside, F.col("direct")).otherwise(0)).alias("file_count"),
        F.count_distinct(F.when(inside, F.col("child"))).alias("dir_count"),
    ).select(
        F.concat(F.lit("/"), F.array_join("dir", "/")).alias("directory"),
        F.col("depth").cast("bigint").alias("depth"),
        "file_count",
        "dir_count",
    )


def file_set_features(files: DataFrame, diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Type diversity, average size, and modified and new ratios of a file set."""
    sizes = files.groupBy(*keys).agg(
        F.try_divide(F.count_distinct(text.extension(F.col("path"))).cast("double"), F.count(F.lit(1))).alias(
            "file_type_diversity"
        ),
        F.avg("size").alias("average_file_size"),
    )
    present = F.col("change") != "deleted"
    ratios = diff.groupBy(*keys).agg(
        *[
            F.try_divide(count_if(F.col("change") == kind).cast("double"), count_if(present)).alias(f"{name}_files_ratio")
            for kind, name in [("modified", "modified"), ("new", "new")]
        ]
    )
    return sizes.join(ratios, list(keys), "left")


def placement_outcome(locations: DataFrame, factor: int = 3, key: str = "chunk_id") -> DataFrame:
    """SUCCESS, PARTIAL or FAILED per chunk from its upload results."""
    uploaded = count_if(F.col("status") == "UPLOADED")
    return locations.groupBy(key).agg(
        uploaded.alias("uploaded"),
        F.when(uploaded >= factor, "SUCCESS").when(uploaded > 0, "PARTIAL").otherwise("FAILED").alias("outcome"),
    )
