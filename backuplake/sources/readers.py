"""Readers. Every reader takes an explicit schema; the format is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from backuplake import schemas
from backuplake.functions import text


def stream(spark: SparkSession, fmt: str, schema: StructType | str | None, path: str | None = None, **options: str) -> DataFrame:
    """Streaming source. `kafka` needs its connector on the cluster and takes no schema."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None and fmt != "kafka":
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def event_topic(spark: SparkSession, servers: str, topic: str = "backup-events", starting: str = "latest") -> DataFrame:
    """The event topic with its value as text."""
    raw = stream(
        spark,
        "kafka",
        None,
        **{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting},
    )
    return raw.select(F.col("value").cast("string").alias("value"))


def typed_events(df: DataFrame, value: str = "value") -> DataFrame:
    """Nested event records out of a JSON text column; unreadable rows become null fields."""
    return df.select(F.from_json(value, schemas.BACKUP_EVENT).alias("e")).select("e.*")


def documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON documents: a file is an array of records, over any number of lines, or one record.

    A document is read by one task; a table of them should have many files (`sinks.write_documents`). Further records after
    the first array or record of a file are not read: files of one record per line are for `spark.read.json`.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def training_set(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON training documents."""
    return documents(spark, path, schema)


def table(spark: SparkSession, name_or_path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A job, restore or snapshot table: catalog name, file path, or any connector format."""
    if fmt == "table":
        return spark.table(name_or_path)
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(name_or_path) if name_or_path else reader.load()


def directory_listing(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all files below `root`; contents are never read.

    Spark's file index leaves out files of zero bytes.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(
            F.regexp_replace("path", "^file:/+", "/").alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified_time"),
        )
    )
    return files.withColumns(
        {
            "name": text.base_name(F.col("path")),
            "parent_path": text.parent_path(F.col("path")),
            "is_directory": F.lit(False),
            "permissions": F.lit(None).cast("string"),
        }
    )


def with_directories(files: DataFrame) -> DataFrame:
    """Adds one row per directory that holds a file, derived from the paths."""
    parts = F.split(F.col("parent_path"), "/")
    depths = F.sequence(F.lit(2), F.size(parts))
    prefixes = F.transform(depths, lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    # Files of one folder shrink to one row before its prefixes are made.
    parents = files.select("parent_path").filter("parent_path <> '/'").distinct()
    folders = parents.select(F.explode(prefixes).alias("path")).distinct()
    rows = folders.select(
        "path",
        F.lit(0).cast("bigint").alias("size"),
        F.lit(None).cast("timestamp").alias("modified_time"),
        text.base_name(F.col("path")).alias("name"),
        text.parent_path(F.col("path")).alias("parent_path"),
        F.lit(True).alias("is_directory"),
        F.lit(None).cast("string").alias("permissions"),
    )
    return files.unionByName(rows)


def key_registry(spark: SparkSession, path: str) -> DataFrame:
    """Key metadata from JSON arrays; key material is never part of the schema."""
    return documents(spark, path, schemas.DEVICE_KEYS)


def to_utc(value: Column, encoding: str) -> Column:
    """One timestamp type for the five encodings in use."""
    if encoding == "epoch_ms":
        return F.timestamp_millis(value.cast("bigint"))
    if encoding == "epoch_s":
        return F.timestamp_seconds(value.cast("bigint"))
    if encoding in ("iso", "instant"):
        return F.try_to_timestamp(value)
    if encoding == "local":
        return value.cast("timestamp")
    raise ValueError(f"unknown time encoding: {encoding}")
