"""Splitting files into chunks and putting them together again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import digest

MIB = 1 << 20


def split_fixed(files: DataFrame, chunk_bytes: int = MIB, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Fixed-size chunks of a `data` column; the last one may be short, empty files have none."""
    count = F.ceil(F.octet_length("data") / chunk_bytes).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    piece = F.substring(F.col("data"), F.col("pos") * chunk_bytes + 1, F.lit(chunk_bytes))
    cut = files.select(*keys, "data", F.explode(starts).alias("pos")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), piece.alias("data")
    )
    return cut.select("*", F.octet_length("data").cast("bigint").alias("length"), digest(F.col("data")).alias("digest"))


def reassemble(chunks: DataFrame, keys: Sequence[str] = ("path",), **measures: Column) -> DataFrame:
    """Chunk data joined in position order, one row per file, with any further aggregates. A file that
    lacks the data of a chunk has none.

    The result is one value per file, so a file is limited by the size of a binary value;
    larger restores keep chunk rows and write them in order.
    """
    merged = F.when(F.count_if(F.col("data").isNull()) == 0, F.expr("listagg(data, x'') WITHIN GROUP (ORDER BY pos)"))
    more = [expr.alias(name) for name, expr in measures.items()]
    return chunks.groupBy(*keys).agg(merged.alias("data"), *more)


def gear_table() -> np.ndarray:
    """One 64-bit weight per byte value, from a fixed multiplicative rule."""
    x = np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def cut_points(data: bytes, low: int, bits: int, high: int) -> list[int]:
    """Ends of content-defined chunks: the first place at or after `low` bytes whose rolling
    hash has `bits` zero bits, else `high` bytes."""
    size = len(data)
    weights = gear_table()[np.frombuffer(data, dtype="uint8")]
    rolling = np.zeros(size, dtype="uint64")
    # The lowest `bits` bits of the hash depend on the last `bits` bytes only.
    for back in range(min(bits, size)):
        rolling[back:] += weights[: size - back] << np.uint64(back)
    marks = np.flatnonzero((rolling & np.uint64((1 << bits) - 1)) == 0) + 1
    ends, start = [], 0
    while size - start > high or (size - start > low):
        i = np.searchsorted(marks, start + low)
        end = min(int(marks[i]) if i < len(marks) else size, start + high, size)
        ends.append(end)
        start = end
    if start < size:
        ends.append(size)
    return ends


def split_by_content(
    files: DataFrame, low: int = 2048, bits: int = 13, high: int = 65536, keys: Sequence[str] = ("path",)
) -> DataFrame:
    """Content-defined chunks: an edit moves only the cuts near it.

    Cut points are found per file in Arrow batches; the chunks themselves are cut and hashed
    by native expressions.
    """

    @F.pandas_udf("array<int>")
    def ends(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in data:
            yield batch.map(lambda value: cut_points(value, low, bits, high))

    cuts = files.select(*keys, "data", ends("data").alias("_ends"))
    spans = F.transform(
        "_ends",
        lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1)).alias("start"), e.alias("end")),
    )
    rows = cuts.select(*keys, "data", F.posexplode(spans).alias("pos", "_span"))
    piece = F.substring(F.col("data"), F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), piece.alias("data")).select(
        "*", F.octet_length("data").cast("bigint").alias("length"), digest(F.col("data")).alias("digest")
    )
