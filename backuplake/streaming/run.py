"""Running a stream to the end of its input, with a checkpoint that is always set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from backuplake.session import shared_path
from backuplake.sources.sinks import batch_writer


def start(
    df: DataFrame,
    name: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = "30 seconds",
):
    """Starts a query on a fixed trigger, or on all available input when `every` is None."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_to_end(df: DataFrame, name: str, mode: str = "append", sink=None) -> DataFrame | None:
    """Reads all available input, writes every batch to a fresh folder and reads it back."""
    spark = df.sparkSession
    out = shared_path(spark, f"{name}-out")
    query = start(df, f"{name}_{out[-8:]}", sink or batch_writer(out), shared_path(spark, f"{name}-check"), mode, None)
    query.awaitTermination()
    if sink:
        return None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return spark.read.schema(fields).parquet(f"{out}/batch_id=*")
