"""Isolation forest: trees grown from a bounded sample, scored in Arrow batches.

Growing needs at most `trees x sample` rows however large the table is, so the sample and the
finished trees are broadcast; only scoring runs over all rows, once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, length array<double>"


def usual_depth(rows: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def grow(sample: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as flat arrays; a leaf has feature -1."""
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "length": []}

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(tree["feature"])
        for name, value in zip(tree, (-1, 0.0, node, node, depth + usual_depth(len(rows)))):
            tree[name].append(value)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth < limit and len(spread):
            column = int(rng.choice(spread))
            values = rows[:, column]
            cut = float(rng.uniform(values.min(), values.max()))
            below = values <= cut
            tree["feature"][node], tree["threshold"][node] = column, cut
            tree["left"][node] = add(rows[below], depth + 1)
            tree["right"][node] = add(rows[~below], depth + 1)
        return node

    add(sample, 0)
    return tree


def path_lengths(trees: list[dict[str, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """Mean path length of each row, walking all rows one level at a time."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for tree in trees:
        at = np.zeros(len(rows), dtype="int64")
        while True:
            column = tree["feature"][at]
            inner = column >= 0
            if not inner.any():
                break
            below = rows[index, np.maximum(column, 0)] <= tree["threshold"][at]
            at = np.where(inner, np.where(below, tree["left"][at], tree["right"][at]), at)
        total += tree["length"][at]
    return total / len(trees)


@dataclass
class Forest:
    names: list[str]
    trees: object
    sample: int
    offset: float = -0.5

    def raw_score(self, vector: Column | None = None) -> Column:
        """Minus the anomaly score: near -1 for anomalies, near 0 for normal rows."""
        trees, usual = self.trees, usual_depth(self.sample)

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                yield pd.Series(-np.power(2.0, -path_lengths(trees.value, rows) / usual))

        return run(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names]))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds `anomaly_score` (the decision value) and `is_anomaly`."""
        return df.withColumn("anomaly_score", self.raw_score() - F.lit(self.offset)).withColumn(
            "is_anomaly", F.col("anomaly_score") < 0
        )


def fit(
    df: DataFrame, names: Sequence[str], key: str, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42
) -> Forest:
    """Grows the forest and sets the offset so that `contamination` of the rows are anomalies.

    Rows are drawn by a digest of their key, not at random, so a lost task draws the same again.
    """
    names = list(names)
    spark = df.sparkSession
    order = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    wanted, rows = trees * sample, df.count()
    # Four times the wanted rows by digest, or all there are, so that no task sorts more than its share.
    drawn = df.filter(order < min(1 << 40, (1 << 42) * wanted // max(1, rows)))
    # Proven bound: trees x sample rows.
    pool = (
        drawn.select(order.alias("_o"), key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
        .orderBy("_o", key)
        .limit(wanted)
        .select(*names)
        .toPandas()
        .to_numpy(dtype="float64")
    )
    if len(pool) == 0:
        raise ValueError("no training rows")
    size = min(sample, len(pool))
    shared = spark.sparkContext.broadcast(pool)

    def grow_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            rows = []
            for tree in ids["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                rows.append({"tree": int(tree), **grow(shared.value[rng.choice(len(shared.value), size, replace=False)], rng)})
            yield pd.DataFrame(rows, columns=["tree", "feature", "threshold", "left", "right", "length"])

    parts = min(trees, spark.sparkContext.defaultParallelism)
    grown = spark.range(0, trees, numPartitions=parts).mapInPandas(grow_trees, TREE_SCHEMA).collect()
    flat = [
        {n: np.asarray(row[n]) for n in ("feature", "threshold", "left", "right", "length")}
        for row in sorted(grown, key=lambda r: r["tree"])
    ]
    forest = Forest(names, spark.sparkContext.broadcast(flat), size)
    scores = df.select(forest.raw_score().alias("s"))
    forest.offset = float(scores.agg(F.percentile_approx("s", contamination, 100_000)).first()[0])
    return forest
