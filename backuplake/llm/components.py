"""Connected components of links, joined step by step in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.session import pin


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """`links` (a, b) to (node, root): root is the smallest node of each component.

    Each round hooks every node's larger neighbours to its smallest one, then its smaller ones too
    (large and small star); links only ever shrink towards the roots, and the frames are written
    out so that a lost executor costs one round. Neighbours are never gathered: a node's smallest
    one is a minimum that each map task takes first.
    """
    edges = pin(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "links")
    before = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        # Large star: larger neighbours of a node go to its smallest one.
        large = edges.select(F.col("u").alias("v"), F.col("v").alias("x")).join(least, "v").select(F.col("x").alias("v"), F.col("m").alias("u"))
        large = large.filter("v <> u").distinct()
        # Small star: smaller neighbours of a node, and itself, go to its smallest one.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
        edges = pin(small.filter("v <> u").distinct(), "links")
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
