"""Sets of files per key (the files that hold a chunk, the paths that hold a trigram) as compressed bitmaps.

Files are numbered densely in order of their names, so files of a folder lie together. A set is a row per key and bucket
of 32,768 numbers: with few members their sorted positions in the bucket, with more than `DENSE` a bitmap of
4,096 bytes. A row is bounded whatever the key holds, and a hot key is spread over the buckets; no list of all its
files is ever built. Union, difference and intersection meet rows of the same key and bucket.

Buckets without members have no row, so a key without files is no key. Null keys and null files are left out; repeated
references count once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.operators.ordered import sorted_blocks
from backuplake.session import pin, ship

BUCKET = 32_768
#: Members of a bucket from which on a bitmap is smaller than 2 bytes a position.
DENSE = 2_048
SET = "members long, positions array<int>, bitmap binary"


def numbered(files: DataFrame, file: str = "file", first: int = 0) -> DataFrame:
    """Each distinct file with a dense number from `first` on, in order of names; written out."""
    blocks = sorted_blocks(files.select(file).filter(F.col(file).isNotNull()).distinct(), [], [file])
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per block of a million files.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + first - 1).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(file)
    rows = blocks.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(starts), "_block")
    return pin(rows.select(file, (F.col("_start") + F.col("_at")).alias("file_no")), "file-numbers")


def _in_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({"bucket": F.floor(F.col("file_no") / BUCKET).cast("int"), "position": (F.col("file_no") % BUCKET).cast("int")})


def build(references: DataFrame, key: str) -> DataFrame:
    """key, bucket, members, positions or bitmap. `references`: key, file_no; any number of times each."""
    known = references.select(key, "file_no").filter(F.col(key).isNotNull() & F.col("file_no").isNotNull())
    # Copies go in the map tasks; after that a key and bucket has at most 32,768 rows.
    pairs = _in_buckets(known).select(key, "bucket", "position").distinct()
    dealt = pairs.repartition(key, "bucket")
    counted = dealt.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "bucket")))
    few = counted.filter(F.col("_n") <= DENSE).groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_list("position")).alias("positions"), F.lit(None).cast("binary").alias("bitmap")
    )
    many = counted.filter(F.col("_n") > DENSE).groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("members"), F.lit(None).cast("array<int>").alias("positions"), F.bitmap_construct_agg("position").alias("bitmap")
    )
    return few.unionByName(many)


def _bits(positions, bitmap) -> np.ndarray:
    """A bucket as 32,768 flags; the lowest bit of a byte is its first position."""
    if bitmap is not None:
        return np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    flags = np.zeros(BUCKET, bool)
    if positions is not None:
        flags[np.asarray(positions, np.int64)] = True
    return flags


def packed(flags: np.ndarray) -> tuple[int, list | None, bytes | None]:
    n = int(flags.sum())
    if n > DENSE:
        return n, None, np.packbits(flags, bitorder="little").tobytes()
    return n, np.flatnonzero(flags).tolist(), None


_RULES = {"union": np.logical_or, "difference": lambda x, y: x & ~y, "intersection": np.logical_and}


def combine(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """'union', 'difference' or 'intersection' of two frames of sets, key by key."""
    ship(left.sparkSession)
    apply = _RULES[rule]

    @F.pandas_udf(SET)
    def merged(a: pd.Series, x: pd.Series, b: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [packed(apply(_bits(*one), _bits(*two))) for one, two in zip(zip(a, x), zip(b, y))]
        return pd.DataFrame(rows, columns=["members", "positions", "bitmap"])

    theirs = right.select(key, "bucket", F.col("positions").alias("_p"), F.col("bitmap").alias("_b"), F.lit(True).alias("_there"))
    how = {"union": "outer", "difference": "left", "intersection": "inner"}[rule]
    both = left.withColumn("_here", F.lit(True)).join(theirs, [key, "bucket"], how)
    # Only rows with both sides need Python.
    pairs = both.filter("_here AND _there").withColumn("_s", merged("positions", "bitmap", "_p", "_b"))
    done = pairs.select(key, "bucket", "_s.*").filter("members > 0")
    if rule == "intersection":
        return done
    rest = both.filter("_there IS NULL").select(key, "bucket", "members", "positions", "bitmap")
    if rule == "difference":
        return done.unionByName(rest)
    only = right.join(left.select(key, "bucket"), [key, "bucket"], "left_anti").select(key, "bucket", "members", "positions", "bitmap")
    return done.unionByName(rest).unionByName(only)


def members(sets: DataFrame, key: Sequence[str]) -> DataFrame:
    """key columns and file_no, a row per member."""
    ship(sets.sparkSession)

    @F.pandas_udf("array<int>")
    def listed(bitmap: pd.Series) -> pd.Series:
        return bitmap.map(lambda value: np.flatnonzero(_bits(None, value)).astype("int32"))

    few, many = sets.filter("bitmap IS NULL"), sets.filter("bitmap IS NOT NULL")
    rows = few.select(*key, "bucket", F.explode("positions").alias("_at")).unionByName(many.select(*key, "bucket", F.explode(listed("bitmap")).alias("_at")))
    return rows.select(*key, (F.col("bucket").cast("bigint") * BUCKET + F.col("_at")).alias("file_no"))


def counts(sets: DataFrame, key: str) -> DataFrame:
    """key, file_count; no set is opened."""
    return sets.groupBy(key).agg(F.sum("members").alias("file_count"))

