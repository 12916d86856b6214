"""Distinct chunks and their bytes over any span of days and devices, from stored sketches.

A sketch of a set of chunks keeps those with the `k` smallest hashes, with their sizes, and the limit below which it
keeps all: the next hash, or none if there is none. Sketches of a day and device are made once; those of a span are
merged from them without the chunks. Of hashes that are spread evenly a known share lies below the limit, so counts and
bytes are what is kept divided by that share: exact up to `k` distinct chunks, beyond with a relative error of about
1 / sqrt(k - 1) for counts (one standard deviation), and for bytes as much more as sizes differ.

Rows of a hot key are cut to `k` + 1 in each map task before they meet; a sketch holds at most `k` entries. Hashes have
63 bits; chunks that share one count as one. Null digests are no chunks; null sizes are 0; a digest with several sizes
counts with the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.session import pin

K = 4096
NO_LIMIT = (1 << 63) - 1


def _kept(chunks: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """keys, entries and the next hash after them; `chunks`: keys, hash, size, unique."""
    ranked = chunks.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).filter(F.col("_rank") <= k + 1)
    return ranked.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_rank") <= k, F.struct("hash", "size"))).alias("entries"),
        F.min(F.when(F.col("_rank") > k, F.col("hash"))).alias("_next"),
    )


def sketch(references: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """keys, entries, limit, references, bytes (of all references). `references`: keys, digest, size."""
    rows = references.filter("digest IS NOT NULL").withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("bigint"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("references"), F.sum("size").alias("bytes"))
    hashed = rows.select(*keys, F.shiftrightunsigned(F.xxhash64("digest"), 1).alias("hash"), "size")
    chunks = hashed.groupBy(*keys, "hash").agg(F.max("size").alias("size"))
    kept = _kept(chunks, keys, k).withColumn("limit", F.coalesce("_next", F.lit(NO_LIMIT))).drop("_next")
    return kept.join(totals, list(keys))


def merge(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per value of `keys` from all sketches under it; nothing but sketches is read."""
    keys = list(keys)
    totals = pin(
        sketches.groupBy(*keys).agg(F.min("limit").alias("_limit"), F.sum("references").alias("references"), F.sum("bytes").alias("bytes")), "sketch-limits"
    )
    entries = sketches.select(*keys, F.inline("entries")).join(totals.select(*keys, "_limit"), keys).filter(F.col("hash") < F.col("_limit"))
    kept = _kept(entries.groupBy(*keys, "hash").agg(F.max("size").alias("size")), keys, k)
    joined = totals.join(kept, keys, "left")
    nothing = F.array().cast("array<struct<hash:bigint,size:bigint>>")
    return joined.select(*keys, F.coalesce("entries", nothing).alias("entries"), F.least("_limit", F.coalesce("_next", "_limit")).alias("limit"), "references", "bytes")


def estimates(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, references, bytes, distinct_chunks, distinct_bytes, relative_error (of the count, 0 where exact)."""
    share = F.col("limit") / float(1 << 63)
    exact = F.col("limit") == NO_LIMIT
    count = F.size("entries").cast("bigint")
    size = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["size"])
    scaled = lambda x: F.when(exact, x).otherwise(F.round(x / share).cast("bigint"))
    return sketches.select(
        *keys, "references", "bytes", scaled(count).alias("distinct_chunks"), scaled(size).alias("distinct_bytes"),
        F.when(exact, F.lit(0.0)).otherwise(1 / F.sqrt(F.greatest(count - 1, F.lit(1)))).alias("relative_error"),
    )
