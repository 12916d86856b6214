"""The given tables seen as backup concepts. Mappings only: no rows are left out.

Times keep the tables' own type (UTC without zone), so that time filters reach the scan; only
streams, whose watermarks need it, cast to a timestamp with zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.sources import readers

CHUNK_BYTES = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table as a stream: of the files in its folder, or of the one file it is."""
    schema, path = read(spark, sf_dir, name).schema, spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return readers.stream(spark, "parquet", schema, f"{sf_dir}/{name}.parquet", **options)
    return readers.stream(spark, "parquet", schema, sf_dir, pathGlobFilter=f"{name}.parquet", **options)


def cents(name: str) -> Column:
    """Money and measures as whole numbers, so that sums do not depend on their order."""
    return F.round(F.col(name) * 100).cast("bigint")


def event_columns(df: DataFrame) -> DataFrame:
    """Backup events; works on batch and streaming reads of the events table."""
    ts = F.col("ts").cast("timestamp") if df.isStreaming else F.col("ts")
    return df.select(
        "event_id",
        ts.alias("timestamp"),
        F.col("user_id").alias("device_id"),
        (F.col("user_id") % 10).alias("tenant_id"),
        F.col("event_type").alias("backup_type"),
        cents("value").alias("size"),
        F.get_json_object("props", "$.k").cast("bigint").alias("duration"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(read(spark, sf_dir, "events"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages as JSON text."""
    return events(spark, sf_dir).select(
        "event_id",
        F.to_json(
            F.struct(
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"),
                F.col("tenant_id").cast("string").alias("tenantId"),
                F.col("backup_type").alias("backupType"),
                F.col("size").cast("string").alias("size"),
                # Errors carry text where a number belongs.
                F.when(F.col("backup_type") == "error", "n/a").otherwise(F.col("duration").cast("string")).alias("duration"),
                (F.col("duration") * 2).cast("string").alias("file_count"),
            )
        ).alias("value"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backup jobs. Every twentieth order stands for a failed job."""
    price = F.col("o_totalprice")
    status = (
        F.when(F.col("o_orderkey") % 20 == 0, "FAILED")
        .when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("PAUSED")
    )
    base = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("device_id"),
        status.alias("status"),
        cents("o_totalprice").alias("size"),
        (F.floor(price).cast("bigint") % 7200).alias("duration"),
        F.col("o_orderdate").alias("created_at"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).cast("bigint").alias("priority"),
    )
    ended = F.col("status").isin("COMPLETED", "FAILED")
    return base.withColumns(
        {
            "stored_size": F.floor(F.col("size") / 3).cast("bigint"),
            "progress": F.when(F.col("status") == "COMPLETED", 100).otherwise(F.col("job_id") % 100).cast("bigint"),
            "estimated_duration": F.when(F.col("priority") > 1, F.col("duration")),
            "end_time": F.when(ended, F.col("created_at") + F.make_interval(secs=F.col("duration"))),
        }
    )


# Extension per line number.
EXTENSIONS = {1: "jpg", 2: "mp4", 3: "mp3", 4: "pdf", 5: "txt", 6: "tmp", 7: "log"}


def _extension() -> Column:
    out = None
    for line, name in EXTENSIONS.items():
        test = F.col("l_linenumber") == line
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("dat")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File snapshots per device; a device's path recurs over time."""
    dash = F.lit("-")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(
            F.col("l_orderkey").cast("string"), dash, F.col("l_linenumber").cast("string"), dash,
            F.col("l_partkey").cast("string"), dash, F.col("l_suppkey").cast("string"),
        ).alias("snapshot_id"),
        F.col("l_orderkey").alias("job_id"),
        F.col("l_suppkey").alias("device_id"),
        F.concat(
            F.lit("/set"), (F.col("l_partkey") % 20).cast("string"), F.lit("/Box"), (F.col("l_partkey") % 7).cast("string"),
            F.lit("/f"), F.col("l_partkey").cast("string"), F.lit("."), _extension(),
        ).alias("path"),
        cents("l_extendedprice").alias("size"),
        F.col("l_quantity").cast("bigint").cast("string").alias("checksum"),
        F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "O", "INCREMENTAL").otherwise("FULL").alias("backup_type"),
        (F.col("l_returnflag") == "R").alias("is_deleted"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the same path written by several devices."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(
            F.lit("/o"), F.col("l_orderkey").cast("string"), F.lit("/l"), F.col("l_linenumber").cast("string"),
            F.lit("."), _extension(),
        ).alias("path"),
        F.col("l_suppkey").alias("device_id"),
        F.col("l_suppkey").alias("node_id"),
        F.col("l_quantity").cast("bigint").alias("version"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_shipdate").alias("backup_time"),
        F.col("l_partkey").alias("chunk_id"),
        cents("l_extendedprice").alias("size"),
        (F.col("l_returnflag") == "R").alias("is_deleted"),
    )


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("chunk_id"),
        F.col("p_size").cast("bigint").alias("size"),
        (F.lit("1995-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("p_partkey") % 3000).cast("int"))).alias("created_at"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("node_id"),
        (cents("s_acctbal") + 1_000_000).alias("capacity"),
        F.floor((cents("s_acctbal") + 1_000_000) / 4).cast("bigint").alias("used"),
        F.col("s_nationkey").cast("bigint").alias("site"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device_id"),
        F.col("c_nationkey").cast("bigint").alias("tenant_id"),
        (F.col("c_acctbal") > 0).alias("is_online"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=F.col("c_custkey").cast("int"))).alias("last_sync"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key registry rows of a device."""
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key_id"),
        F.col("o_custkey").alias("device_id"),
        F.lit("AES_256_GCM").alias("algorithm"),
        F.lit("SCRYPT").alias("key_derivation"),
        F.col("o_orderdate").alias("created_at"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"),
        (F.col("o_orderstatus") == "O").alias("is_active"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with their bytes."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "lang",
        F.encode("text", "UTF-8").alias("data"),
    )


def chunked_files(spark: SparkSession, sf_dir: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files with the list of their chunk digests."""
    count = F.ceil(F.octet_length("data") / chunk_bytes).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    ids = F.transform(starts, lambda i: features.digest(F.substring(F.col("data"), i * chunk_bytes + 1, F.lit(chunk_bytes))))
    size = F.octet_length("data").cast("bigint")
    return files(spark, sf_dir).select("file_id", "path", "lang", size.alias("size"), ids.alias("chunks"))


def quota_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        "tenant_id",
        F.when(F.col("backup_type").isin("view", "click"), "BANDWIDTH").otherwise("STORAGE").alias("resource"),
        F.col("size").alias("amount"),
        F.col("timestamp").alias("ts"),
    )


def block_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("device_id"),
        F.col("l_partkey").alias("block_number"),
        F.col("l_shipdate").alias("ts"),
    )


# Event type to job command.
COMMANDS = {"view": "start", "click": "pause", "signup": "resume", "purchase": "complete", "error": "cancel"}


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])
    return events(spark, sf_dir).select(
        F.col("device_id").alias("job_id"), F.col("timestamp").alias("ts"), "event_id", word[F.col("backup_type")].alias("command")
    )


def hourly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each hour per tenant: the share of events that are not errors."""
    return (
        events(spark, sf_dir)
        .groupBy("tenant_id", F.date_trunc("hour", "timestamp").alias("hour_ts"))
        .agg(
            (F.count_if(F.col("backup_type") != "error").cast("double") / F.count(F.lit(1))).alias("quality_score"),
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("size"),
            F.sum("duration").alias("duration"),
        )
    )


def backup_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backup runs with their load and duration, one per line item."""
    count, size = F.col("l_quantity") * 20, F.col("l_extendedprice") * 100
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_suppkey").alias("device_id"),
        count.alias("file_count"),
        size.alias("total_size"),
        (F.col("l_discount") * 600 + 20).alias("device_cpu"),
        (F.col("l_tax") * 600 + 30).alias("device_memory"),
        (F.col("l_linenumber") * 100).cast("double").alias("network_speed"),
        F.greatest(F.lit(30.0), count * 0.1 + size / 1_000_000 * 60).alias("backup_duration"),
    )


def health_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System readings, one per event."""
    return events(spark, sf_dir).select(
        F.col("event_id"),
        "device_id",
        "tenant_id",
        "timestamp",
        F.least(F.lit(100.0), F.col("duration").cast("double")).alias("cpu_usage"),
        F.least(F.lit(100.0), F.col("size") / 100.0).alias("memory_usage"),
        (F.col("size") / 50.0).alias("disk_io"),
        (F.col("duration") * F.col("size") / 10_000.0).alias("network_io"),
        (F.lit(5000.0) / (F.col("size") + 100)).alias("backup_speed"),
    )
