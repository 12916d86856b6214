"""Orderings, pages and top-k. Every order ends in a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backuplake.functions import features
from backuplake.sources.sinks import newest


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie))


def page(df: DataFrame, number: int, size: int, ts: str, tie: str) -> DataFrame:
    """Page `number` (from 0) with the total rows and pages of the whole result.

    A page past the end is empty. For deep pages use `page_after`, which does not rescan.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "total_pages", F.ceil(F.col("total_rows") / size).cast("bigint")
    )
    rows = df.orderBy(F.col(ts).desc(), F.col(tie)).offset(number * size).limit(size)
    # One-row right side.
    return rows.join(F.broadcast(total), F.lit(True), "left")


def page_after(df: DataFrame, last_ts, last_tie, size: int, ts: str, tie: str) -> DataFrame:
    """The next page after the last row seen."""
    later = (F.col(ts) < last_ts) | ((F.col(ts) == last_ts) & (F.col(tie) > last_tie))
    return df.filter(later).orderBy(F.col(ts).desc(), F.col(tie)).limit(size)


def rank_schedule(jobs: DataFrame, position: str) -> DataFrame:
    """Jobs by score, best first; equal scores keep their input order."""
    return jobs.withColumn("optimization_score", features.schedule_score(F.col("priority"), F.col("estimated_size"))).orderBy(
        F.col("optimization_score").desc(), F.col(position)
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: int) -> DataFrame:
    """The newest rows of each key. Spark cuts each map task to `keep` per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in by])
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep).drop("_rn")


def top_metrics(scores: dict[str, Column], count: int = 2) -> Column:
    """Names of the `count` largest absolute scores, smallest of them first; ties keep list order."""
    pairs = F.array(
        *[
            F.struct(F.abs(value).alias("size"), F.lit(i).alias("pos"), F.lit(name).alias("name"))
            for i, (name, value) in enumerate(scores.items())
        ]
    )
    return F.transform(F.slice(F.array_sort(pairs), -count, count), lambda p: p["name"])


def best_by(df: DataFrame, keys: Sequence[str], value: str, tie: Column, largest: bool = True) -> DataFrame:
    """One row per key: the largest (or smallest) value, the lower `tie` on equality; nulls only win alone."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    rank = F.struct(F.col(value).isNull(), -F.col(value) if largest else F.col(value), tie)
    return df.groupBy(*keys).agg(F.min_by(rest, rank).alias("_best")).select(*keys, "_best.*")


def log_tail(log: DataFrame, level: str = "info", lines: int = 100, ts: str = "ts", tie: str = "id") -> DataFrame:
    return newest(log.filter(F.col("level") == level), [ts, tie], lines)
