"""Erasure coding of chunks: k data and m parity shards, any k of which restore the chunk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.functions.features import digest

# Fixed value: the field polynomial x^8 + x^4 + x^3 + x^2 + 1.
FIELD_POLYNOMIAL = 0x11D


@lru_cache(maxsize=1)
def _products() -> np.ndarray:
    """256 x 256 multiplication table of the field."""
    powers = [1]
    for _ in range(254):
        doubled = powers[-1] << 1
        powers.append(doubled ^ FIELD_POLYNOMIAL if doubled & 0x100 else doubled)
    exp = np.array(powers + powers, dtype="uint8")
    log = np.zeros(256, dtype="int64")
    log[exp[:255]] = np.arange(255)
    table = exp[log[:, None] + log[None, :]]
    table[0, :] = table[:, 0] = 0
    return table


def _times(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Matrix product over the field, whole byte rows at a time."""
    product = _products()
    out = np.zeros((matrix.shape[0], rows.shape[1]), dtype="uint8")
    for i, j in np.ndindex(*matrix.shape):
        out[i] ^= product[matrix[i, j]][rows[j]]
    return out


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan over the field."""
    product, size = _products(), len(matrix)
    work = np.concatenate([matrix, np.eye(size, dtype="uint8")], axis=1)
    for col in range(size):
        pivot = col + int(np.flatnonzero(work[col:, col])[0])
        work[[col, pivot]] = work[[pivot, col]]
        work[col] = product[int(np.flatnonzero(product[work[col, col]] == 1)[0])][work[col]]
        for row in range(size):
            if row != col and work[row, col]:
                work[row] ^= product[work[row, col]][work[col]]
    return work[:, size:]


@lru_cache(maxsize=32)
def coding_matrix(k: int, m: int) -> np.ndarray:
    """Vandermonde rows made systematic, so the first k shards are the data itself."""
    product = _products()
    power = np.zeros((k + m, k), dtype="uint8")
    power[:, 0] = 1
    for col in range(1, k):
        power[:, col] = product[power[:, col - 1], np.arange(k + m)]
    return _times(power, _inverse(power[:k]))


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    width = -(-len(data) // k)
    padded = np.zeros(width * k, dtype="uint8")
    padded[: len(data)] = np.frombuffer(data, dtype="uint8")
    shards = padded.reshape(k, width)
    parity = _times(coding_matrix(k, m)[k:], shards)
    return [row.tobytes() for row in np.concatenate([shards, parity])]


def decode(shards: dict[int, bytes], k: int, m: int, length: int) -> bytes | None:
    """The original bytes from any k shards, or None with fewer."""
    if len(shards) < k:
        return None
    used = sorted(shards)[:k]
    rows = np.stack([np.frombuffer(shards[i], dtype="uint8") for i in used])
    if used != list(range(k)):
        rows = _times(_inverse(coding_matrix(k, m)[used]), rows)
    return rows.tobytes()[:length]


def encode_chunks(chunks: DataFrame, k: int, m: int, key: str = "chunk_id") -> DataFrame:
    """One row per shard with its digest and the chunk's length. A chunk without data has no shards."""

    @F.pandas_udf("array<binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda value: None if value is None else encode(value, k, m))

    rows = chunks.select(
        key, F.octet_length("data").alias("original_length"), F.posexplode(run("data")).alias("index", "data")
    )
    return rows.select(
        key,
        "index",
        "data",
        digest(F.col("data")).alias("checksum"),
        F.when(F.col("index") < k, "DATA").otherwise("PARITY").alias("shard_type"),
        "original_length",
    )


def reconstruct_chunks(shards: DataFrame, k: int, m: int, key: str = "chunk_id") -> DataFrame:
    """Chunks from their intact shards; `status` is INSUFFICIENT_SHARDS with fewer than k.

    Copies of a shard are reduced to one before chunks are gathered, so a group holds at most
    k + m shards.
    """
    intact = (digest(F.col("data")) == F.col("checksum")) & F.col("index").between(0, k + m - 1)
    # Damaged shards stay as nulls, so a chunk without an intact one is still there.
    single = shards.groupBy(key, "index").agg(
        F.first(F.when(intact, F.col("data")), ignorenulls=True).alias("data"),
        F.max(F.when(intact, F.col("original_length"))).alias("original_length"),
    )
    every = single.groupBy(key).agg(
        F.collect_list(F.when(F.col("data").isNotNull(), F.struct("index", "data"))).alias("_shards"),
        F.max("original_length").alias("original_length"),
    )

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, lengths in batches:
            out = []
            for shard_list, length in zip(lists, lengths):
                found = {} if shard_list is None else {s["index"]: s["data"] for s in shard_list}
                out.append(decode(found, k, m, 0 if pd.isna(length) else int(length)))
            yield pd.Series(out, dtype=object)

    return every.select(
        key, F.size("_shards").alias("intact_shards"), run("_shards", "original_length").alias("data")
    ).withColumn("status", F.when(F.col("data").isNull(), "INSUFFICIENT_SHARDS").otherwise("OK"))
