"""Compression of chunk columns in Arrow batches."""

from __future__ import annotations

import lzma
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import saved_ratio

# Codecs, their levels (None: the codec's default), and the order of preference on ties.
LEVELS = {"zstd": 3, "lz4": 9, "brotli": 6, "gzip": None, "xz": 6}
CANDIDATES = ["zstd", "lz4", "brotli", "gzip"]


def codec_name(name: str) -> str:
    """Lower-case known codec name; anything else is an error."""
    if name.lower() not in LEVELS:
        raise ValueError(f"unknown compression type: {name}")
    return name.lower()


def pack(data: bytes, codec: str, level: int | None = None) -> bytes:
    level = LEVELS[codec] if level is None else level
    if codec == "xz":
        return lzma.compress(data, preset=level)
    return pa.Codec(codec, compression_level=level).compress(data, asbytes=True)


def unpack(data: bytes, codec: str, length: int) -> bytes:
    if codec == "xz":
        return lzma.decompress(data)
    return pa.Codec(codec).decompress(data, decompressed_size=length, asbytes=True)


def _codec_column(codec: str | Column) -> Column:
    return F.lit(codec_name(codec)) if isinstance(codec, str) else F.lower(codec)


def compressed(data: Column, codec: str | Column, level: int | None = None) -> Column:
    """The packed bytes of a binary column, by one codec or by each row's own."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, names in batches:
            yield pd.Series(
                [None if v is None else pack(v, codec_name(n), level) for v, n in zip(values, names)], dtype=object
            )

    return run(data, _codec_column(codec))


def decompressed(data: Column, length: Column, codec: str | Column) -> Column:
    """The original bytes; `length` is the stored original length."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for packed, sizes, names in batches:
            yield pd.Series(
                [None if p is None else unpack(p, codec_name(c), int(n)) for p, n, c in zip(packed, sizes, names)],
                dtype=object,
            )

    return run(data, length, _codec_column(codec))


def best_codec(chunks: DataFrame, data: str = "data") -> DataFrame:
    """Adds `codec`, `packed` and `saved`: the smallest output, the earlier codec on ties."""

    @F.pandas_udf("codec string, packed binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch:
                outs = [(name, pack(value, name)) for name in CANDIDATES]
                # Empty input saves nothing with any codec: the first one stands.
                rows.append(min(outs, key=lambda o: len(o[1])) if value else outs[0])
            yield pd.DataFrame(rows, columns=["codec", "packed"])

    out = chunks.withColumn("_best", run(data))
    return out.withColumns(
        {
            "codec": F.col("_best.codec"),
            "packed": F.col("_best.packed"),
            "saved": saved_ratio(F.octet_length(data), F.octet_length("_best.packed")),
        }
    ).drop("_best")


def codec_report(chunks: DataFrame, kind: str, grid: Iterable[tuple[str, int | None]], data: str = "data") -> DataFrame:
    """Ratio, round-trip check and CPU time per data kind, codec and level, over all chunks.

    Each chunk is read once; the grid is worked off inside the batch.
    """
    grid = [(codec_name(c), level) for c, level in grid]

    @F.pandas_udf("array<struct<codec:string, level:int, packed:bigint, ok:boolean, micros:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        for batch in batches:
            out = []
            for value in batch:
                cells = []
                for codec, level in grid:
                    begin = time.perf_counter_ns()
                    packed = pack(value, codec, level)
                    spent = (time.perf_counter_ns() - begin) // 1000
                    cells.append(
                        {
                            "codec": codec,
                            "level": LEVELS[codec] if level is None else level,
                            "packed": len(packed),
                            "ok": unpack(packed, codec, len(value)) == value,
                            "micros": spent,
                        }
                    )
                out.append(cells)
            yield pd.Series(out)

    cells = chunks.select(kind, F.octet_length(data).cast("bigint").alias("size"), F.explode(run(data)).alias("c"))
    return cells.groupBy(kind, F.col("c.codec").alias("codec"), F.col("c.level").alias("level")).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("size").alias("original_bytes"),
        F.sum("c.packed").alias("packed_bytes"),
        F.count_if("c.ok").alias("restored"),
        F.sum("c.micros").alias("micros"),
    )
