"""Search for text in paths through an index of trigrams.

The index holds every distinct path once, numbered in order and written in folders of `span` buckets, and for each
trigram of the lower-cased paths the set of their numbers (`file_sets`: positions or bitmaps per bucket), sorted by trigram.
A search reads the sets of the needle's trigrams alone (the filter reaches the scan, whose files are in order of trigrams),
intersects them bucket by bucket, opens the folders of paths that have candidates, and tests the paths themselves.
So results equal those of a scan. Needles without three letters in a row are answered by a scan of the paths.

Paths that are null are in no result. An empty needle is in every path.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.functions import text
from backuplake.operators import file_sets as fs
from backuplake.session import pin, shared_path, ship

#: Buckets of paths in a folder: 2 million paths.
SPAN = 64
#: Folders named in a filter; with more, all are read.
MOST_SPANS = 10_000


@dataclass
class PathIndex:
    spark: SparkSession
    root: str
    span: int

    def paths(self) -> DataFrame:
        return self.spark.read.schema("path string, file_no bigint, span int").parquet(f"{self.root}/paths")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"gram string, bucket int, {fs.SET}").parquet(f"{self.root}/postings")


def grams(value: Column) -> Column:
    """Distinct trigrams of a text, in code points; none if it is shorter."""
    places = F.when(F.length(value) >= 3, F.sequence(F.lit(1), F.length(value) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(3))))


def build(files: DataFrame, path: str = "path", span: int = SPAN, bucket_files: int | None = None) -> PathIndex:
    """Indexes the distinct paths of `files`. `bucket_files` is the number of postings files at least."""
    spark = files.sparkSession
    root = shared_path(spark, "path-index")
    numbers = fs.numbered(files.select(F.col(path).alias("path")), "path")
    spanned = numbers.withColumn("span", F.floor(F.col("file_no") / (span * fs.BUCKET)).cast("int"))
    spanned.repartitionByRange("file_no").sortWithinPartitions("file_no").write.partitionBy("span").parquet(f"{root}/paths")
    found = numbers.select("file_no", F.explode(grams(F.lower("path"))).alias("gram"))
    sets = fs.build(found, "gram")
    ranged = sets.repartitionByRange(bucket_files, "gram", "bucket") if bucket_files else sets.repartitionByRange("gram", "bucket")
    ranged.sortWithinPartitions("gram", "bucket").write.parquet(f"{root}/postings")
    return PathIndex(spark, root, span)


def _grams_of(spark: SparkSession, pieces: Iterable[str], lower: bool) -> list[str]:
    """Trigrams of a needle by the same expressions as those of the paths."""
    frame = spark.createDataFrame([(p,) for p in pieces], "piece string")
    piece = F.lower("piece") if lower else F.col("piece")
    return sorted(r.gram for r in frame.select(F.explode(grams(piece)).alias("gram")).distinct().collect())


def candidates(index: PathIndex, needed: list[str]) -> DataFrame:
    """file_no of paths that hold all the trigrams."""
    ship(index.spark)

    def common(group: pd.DataFrame) -> pd.DataFrame:
        flags = reduce(np.logical_and, (fs._bits(p, m) for p, m in zip(group["positions"], group["bitmap"])))
        return pd.DataFrame({"file_no": int(group["bucket"].iloc[0]) * fs.BUCKET + np.flatnonzero(flags)})

    rows = index.postings().filter(F.col("gram").isin(needed))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(needed)).select("bucket")
    # A row per trigram of the needle and bucket, 4 KB at most.
    return rows.join(full, "bucket").groupBy("bucket").applyInPandas(common, "file_no bigint")


def _matching(index: PathIndex, needed: list[str], test: Column) -> DataFrame:
    paths = index.paths()
    if not needed:
        return paths.filter(test).select("path")
    hits = pin(candidates(index, needed), "candidates")
    spans = hits.select(F.floor(F.col("file_no") / (index.span * fs.BUCKET)).cast("int").alias("span")).distinct().limit(MOST_SPANS + 1).collect()
    if len(spans) <= MOST_SPANS:
        paths = paths.filter(F.col("span").isin([r.span for r in spans]))
    return paths.join(hits, "file_no").filter(test).select("path")


def search(index: PathIndex, needle: str, extensions: Iterable[str] = (), name_only: bool = False) -> DataFrame:
    """Distinct paths with the text in name or path, whatever the case, and any of the extensions (none given: all).
    The name is the end of the path, so a path holds what its name holds."""
    name = F.lower(text.base_name(F.col("path")))
    test = (name if name_only else F.lower("path")).contains(F.lower(F.lit(needle)))
    ends = [name.endswith(F.lower(F.lit(e))) for e in extensions]
    if ends:
        test = test & reduce(Column.__or__, ends)
    return _matching(index, _grams_of(index.spark, [needle], lower=True), test)


def like(index: PathIndex, pattern: str) -> DataFrame:
    """Distinct paths that fit a LIKE pattern. Its runs of plain ASCII give the trigrams (other letters may change with their
    neighbours when lower-cased); a pattern with escapes is answered by a scan."""
    pieces = [] if "\\" in pattern else [p.lower() for p in re.split(r"[%_]|[^\x00-\x7f]", pattern) if len(p) >= 3]
    needed = _grams_of(index.spark, pieces, lower=False) if pieces else []
    return _matching(index, needed, F.col("path").like(pattern))
