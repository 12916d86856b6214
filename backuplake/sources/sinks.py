"""Sinks. Each write can be replayed without doubling rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backuplake import schemas

#: Records of a JSON document; one task reads a document.
DOCUMENT_ROWS = 250_000


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` target: each batch owns one partition folder and overwrites only that one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def alert_writer(path: str, kind: str) -> Callable[[DataFrame, int], None]:
    """Alert rows with their kind, written like any other batch."""
    write = batch_writer(path)

    def send(batch: DataFrame, batch_id: int) -> None:
        write(batch.withColumn("alert_kind", F.lit(kind)), batch_id)

    return send


def append_predictions(predictions: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch to the log; writing the same batch again replaces it."""
    batch_writer(path)(predictions, batch_id)


def newest(log: DataFrame, by: list[str], keep: int = 10_000) -> DataFrame:
    """The newest `keep` rows of a log; `by` starts with its time and ends in a unique column.

    Rows without a time come last. Hourly counts first tell how far back the rows reach. Without
    that every task of a long log would hand its own newest `keep` rows to the one task that picks
    among them.
    """
    ts = by[0]
    hours = log.groupBy(F.date_trunc("hour", ts).alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per hour of the log.
    later = Window.orderBy(F.col("_hour").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    reach = hours.withColumn("_newer", F.coalesce(F.sum("_n").over(later), F.lit(0))).filter(F.col("_newer") < keep)
    # Scalar subqueries are known before the scan starts, so its filter can use them.
    since = reach.agg(F.min("_hour")).scalar()
    untimed = reach.agg(F.coalesce(F.bool_or(F.col("_hour").isNull()), F.lit(False))).scalar()
    timed = log.filter(F.col(ts) >= since)
    recent = timed.unionByName(log.filter(F.col(ts).isNull() & untimed))
    return recent.orderBy(*[F.col(c).desc_nulls_last() for c in by]).limit(keep)


def compact_predictions(spark: SparkSession, path: str, target: str, by: list[str], keep: int = 10_000) -> None:
    """Writes the kept part of the log to a new folder, so a failed run loses nothing."""
    newest(spark.read.parquet(path).drop("batch_id"), by, keep).write.mode("errorifexists").parquet(target)


def with_expiry(updates: DataFrame, ts: str = "timestamp", seconds: int = 3600) -> DataFrame:
    """Stamps each update with the moment it stops being replayed."""
    return updates.withColumn("expires_at", F.col(ts) + F.make_interval(secs=F.lit(seconds)))


def live_updates(log: DataFrame, as_of) -> DataFrame:
    """Updates that have not expired at `as_of`."""
    return log.filter(F.col("expires_at") > as_of)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest rows, one folder per backup; a replay replaces the folders of its backups.

    Rebalanced by backup: few files for small backups, and large ones are split by size.
    """
    rows = manifest.hint("rebalance", "backup_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backup_id").parquet(path)


def write_documents(df: DataFrame, path: str, rows: int = DOCUMENT_ROWS) -> None:
    """JSON documents: each file is one array of about `rows` records, written as a stream of lines. Null fields are left out."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).repartition(max(1, -(-df.count() // rows)))

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = "[", False
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append(before + value)
                before, seen = ",", True
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if seen else "[]"], pa.string())], names=["value"])

    lines.mapInArrow(array, "value string").write.mode("errorifexists").text(path)


def write_keys(keys: DataFrame, path: str) -> None:
    """Key metadata as JSON arrays; columns outside the registry schema, such as secrets, are dropped."""
    write_documents(keys.select(*schemas.column_names(schemas.DEVICE_KEYS)), path)
