"""Vectors that take part in a search, and the blocks that queries and candidates meet in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) and dim: no nulls, nothing that is not finite, one row per id.

    Of rows that share an id the one with the smallest vector counts.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def numbered(df: DataFrame, column: str, count: int) -> DataFrame:
    """Rows in `count` blocks of about the same size."""
    return df.withColumn(column, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))


def on_all(df: DataFrame, column: str, count: int) -> DataFrame:
    """Each row once for each of `count` blocks of the other side."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
