"""Random forests for regression, grown level by level from histograms of binned features.

Spark ML's own trainer updates the histograms of all trees and nodes row by row: on a deep level they are hundreds of
megabytes, so nearly every update misses the cache, and a table of one file is one task. Here the rows are binned once
into blocks of bytes below the shared folder. A task takes a few trees and a slice of the blocks, tree by tree, so
the histograms it writes to are small; slices are summed after a shuffle, and the splits of a level are what reaches
the driver. More rows mean more slices, more trees more tasks; no task holds more than a block of rows.

Everything else is as in Spark ML: every tree sees each row as often as a Poisson draw of mean 1 says, every split looks at
all features, cuts lie at quantiles (between all values, if there are no more than bins), the split of the
greatest gain in variance wins. Draws follow from seed, tree and block, so a task that runs again draws the same. The result is
a Spark ML model and is stored and loaded as one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.session import shared_path, ship
from backuplake.sources.committed import _store

#: Rows of a block, and of a step within one: what a step needs stays in the cache.
BLOCK_ROWS, STEP_ROWS = 1 << 20, 1 << 16
#: Rows whose histograms one task adds up, and the trees it does so for.
SLICE_ROWS, TASK_TREES = 1 << 24, 4
#: Values that describe a feature in a block.
POINTS = 1024
#: Nodes of a tree whose histograms are summed together.
PART_NODES = 64

#: Draws of a Poisson variable of mean 1 by 16 random bits, in rising order; the first that is not 0.
_POISSON = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(float)
_ONCE = np.uint16(np.searchsorted(_POISSON, 1))

_FOUND = {"tree": "int", "pos": "int", "n": "double", "s": "double", "q": "double", "feature": "int", "cut": "int", "gain": "double"}
_FOUND |= {"left_n": "double", "left_s": "double", "left_q": "double"}
_SPLITS = ", ".join(f"{k} {v}" for k, v in _FOUND.items())
_DATA = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"


def fit(learner: RandomForestRegressor, rows: DataFrame, slice_rows: int = SLICE_ROWS) -> RandomForestRegressionModel:
    """The learner's model. Columns of `rows` are those the learner names; labels must be finite."""
    if learner.getFeatureSubsetStrategy() != "all" or learner.getMaxBins() > 255:
        raise ValueError("only forests whose splits see all features, in at most 255 bins")
    spark = rows.sparkSession
    ship(spark)
    flat = rows.select(vector_to_array(learner.getFeaturesCol()).alias("x"), F.col(learner.getLabelCol()).cast("double").alias("y"))
    summaries = flat.mapInArrow(_summarised, "n bigint, total double, points binary").collect()
    count = sum(r["n"] for r in summaries)
    if not count:
        raise ValueError("no rows to train on")
    cuts = _cuts([r["points"] for r in summaries], learner.getMaxBins())
    mean = sum(r["total"] for r in summaries) / count
    blocks = _blocks(flat, cuts, mean, shared_path(spark, "forest-blocks"))
    levels = _grown(spark, blocks, count, cuts, learner, slice_rows)
    return _stored(spark, learner, levels, cuts, mean)


def score(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    """`model.transform(rows)`, tree by tree over Arrow batches: one tree at a time stays in the cache. Same numbers, to the bit."""
    spark = rows.sparkSession
    ship(spark)
    path = shared_path(spark, "forest-scored")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toArrow().sort_by([("treeID", "ascending"), ("id", "ascending")])
    split = stored["split"].combine_chunks()
    if len(split) and max(split.field("numCategories").to_pylist()) >= 0:
        raise ValueError("only forests of ordered features")
    tree, left, right, own = (stored[c].to_numpy() for c in ("treeID", "leftChild", "rightChild", "id"))
    inner = left >= 0
    limits = np.array([v[0] if v else 0.0 for v in split.field("leftCategoriesOrThreshold").to_pylist()])
    features = np.where(inner, split.field("featureIndex").to_numpy(), 0)
    # A leaf leads to itself.
    after = np.stack([np.where(inner, left, own), np.where(inner, right, own)], axis=1).astype(np.int32)
    ends = [slice(*np.searchsorted(tree, [t, t + 1])) for t in range(model.getNumTrees)]
    # Some megabytes for a hundred trees of depth 10.
    trees = spark.sparkContext.broadcast(
        [(features[at].astype(np.int32), limits[at], after[at].ravel(), stored["prediction"].to_numpy()[at], _depth(after[at])) for at in ends]
    )

    @F.arrow_udf("double")
    def mean(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.float64())
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        base = np.arange(len(vectors)) * (len(values) // len(vectors))
        total = np.zeros(len(vectors))
        for features, limits, after, predictions, depth in trees.value:
            node = np.zeros(len(vectors), np.int64)
            for _ in range(depth):
                beyond = ~(values.take(base + features.take(node)) <= limits.take(node))
                node += node
                node += beyond
                node = after.take(node)
            total += predictions.take(node)
        return pa.array(total / len(trees.value))

    return rows.withColumn(model.getPredictionCol(), mean(vector_to_array(model.getFeaturesCol())))


def _depth(after: np.ndarray) -> int:
    front, depth = np.zeros(1, np.int64), -1
    while len(front):
        reached = after[front]
        front, depth = reached[reached[:, 0] != front].ravel(), depth + 1
    return depth


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of up to BLOCK_ROWS rows and a batch."""
    xs, ys, held = [], [], 0
    for batch in batches:
        if batch.num_rows:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isfinite(y.astype(float)).all():
                raise ValueError("labels must be finite numbers")
            xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
            ys.append(y)
            held += len(y)
        if held >= BLOCK_ROWS:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sum of labels, and for each feature its values with their counts, or POINTS quantiles if there are more."""
    for x, y in _chunks(batches):
        out = []
        for column in x.T:
            values, counts = np.unique(column[~np.isnan(column)], return_counts=True)
            whole = len(values) <= POINTS
            if not whole:
                at = (np.arange(POINTS) + 0.5) * (counts.sum() / POINTS)
                values = values[np.searchsorted(np.cumsum(counts), at)]
                counts = np.full(POINTS, counts.sum() / POINTS)
            out.append(np.concatenate([[whole, len(values)], values, counts]).astype("<f8"))
        row = {"n": len(y), "total": float(y.sum()), "points": np.concatenate(out).tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("n", pa.int64()), ("total", pa.float64()), ("points", pa.binary())]))


def _cuts(summaries: list[bytes], bins: int) -> list[np.ndarray]:
    """Up to `bins` thresholds for each feature: values up to a threshold go left."""
    found: list[list[tuple[bool, np.ndarray, np.ndarray]]] = []
    for raw in summaries:
        numbers, at, f = np.frombuffer(raw, "<f8"), 0, 0
        while at < len(numbers):
            whole, k = bool(numbers[at]), int(numbers[at + 1])
            if f == len(found):
                found.append([])
            found[f].append((whole, numbers[at + 2 : at + 2 + k], numbers[at + 2 + k : at + 2 + 2 * k]))
            at, f = at + 2 + 2 * k, f + 1
    out = []
    for parts in found:
        values, back = np.unique(np.concatenate([v for _, v, _ in parts]), return_inverse=True)
        if len(values) < 2:
            out.append(np.empty(0))
            continue
        if all(w for w, *_ in parts) and len(values) <= bins:
            at = np.arange(len(values) - 1)
        else:
            upto = np.cumsum(np.bincount(back, np.concatenate([c for *_, c in parts])))
            # The last part is cut once more, as long tails need it; Spark ML's sampling does so now and then.
            at = np.unique(np.searchsorted(upto, upto[-1] * np.append(np.arange(1, bins), bins - 0.25) / bins))
            at = at[at < len(values) - 1]
        with np.errstate(invalid="ignore", over="ignore"):
            middle = (values[at] + values[at + 1]) / 2
        out.append(np.where(np.isfinite(middle) & (middle < values[at + 1]), middle, values[at]))
    return out


def _blocks(flat: DataFrame, cuts: list[np.ndarray], mean: float, folder: str) -> list[tuple[str, int]]:
    """Files of bins, a byte each, row after row, and of labels less their mean; only files of tasks that ended are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for no, (x, y) in enumerate(_chunks(batches)):
            codes = np.empty(x.shape, np.uint8)
            for f, cut in enumerate(cuts):
                codes[:, f] = np.searchsorted(cut, x[:, f])
            store.create_dir(top, recursive=True)
            name = f"{TaskContext.get().partitionId():07d}-{no:05d}-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(codes.tobytes())
                out.write((y - mean).astype("<f8").tobytes())
            yield pa.RecordBatch.from_pylist([{"name": name, "n": len(y)}])

    return [(f"{folder}/{r['name']}", r["n"]) for r in sorted(flat.mapInArrow(run, "name string, n bigint").collect())]


def _grown(spark: SparkSession, blocks: list[tuple[str, int]], count: int, cuts: list[np.ndarray], learner: RandomForestRegressor, slice_rows: int) -> list[pa.Table]:
    """For each level its nodes, with the split of those that have one."""
    trees, depth, bins, seed = learner.getNumTrees(), learner.getMaxDepth(), learner.getMaxBins() + 1, learner.getSeed() & (1 << 63) - 1
    width, numbered = len(cuts), [(i, path, n) for i, (path, n) in enumerate(blocks)]
    wanted = max(1, -(-count // slice_rows))
    slices = [numbered[k::wanted] for k in range(min(wanted, len(numbered)))]
    groups = [list(range(trees))[k : k + TASK_TREES] for k in range(0, trees, TASK_TREES)]
    # By tree: the levels' splits as feature and cut of each place, and the places that are open.
    walks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(trees)]
    places = [np.zeros(1, np.int64) for _ in range(trees)]
    levels = []
    for level in range(max(1, depth)):
        last = level >= depth - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    own = groups[task % len(groups)]
                    sums = _histograms(slices[task // len(groups)], own, walks, places, width, bins, seed, last)
                    for tree, (parts, squares) in zip(own, sums):
                        if not len(places[tree]):
                            continue
                        if len(slices) == 1:
                            yield _splits(tree, places[tree], parts, squares)
                            continue
                        for lo in range(0, len(places[tree]), PART_NODES):
                            at = slice(lo, lo + PART_NODES)
                            row = {"tree": tree, "lo": lo, "parts": parts[:, :, at].tobytes(), "squares": squares[at].tobytes()}
                            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("tree", pa.int32()), ("lo", pa.int64()), ("parts", pa.binary()), ("squares", pa.binary())]))

        def summed(rows: pd.DataFrame) -> pd.DataFrame:
            tree, lo = int(rows["tree"].iloc[0]), int(rows["lo"].iloc[0])
            parts = sum(np.frombuffer(raw) for raw in rows["parts"]).reshape(3 if last else 2, width, -1, bins)
            return _splits(tree, places[tree][lo : lo + PART_NODES], parts, sum(np.frombuffer(raw) for raw in rows["squares"])).to_pandas()

        tasks = len(groups) * len(slices)
        made = spark.range(0, tasks, 1, tasks)
        if len(slices) == 1:
            found = made.mapInArrow(run, _SPLITS).toArrow()
        else:
            partial = made.mapInArrow(run, "tree int, lo bigint, parts binary, squares binary")
            found = partial.groupBy("tree", "lo").applyInPandas(summed, _SPLITS).toArrow()
        found = found.sort_by([("tree", "ascending"), ("pos", "ascending")])
        if depth == 0:
            found = found.set_column(found.schema.get_field_index("feature"), "feature", pa.array([-1] * len(found), pa.int32()))
        levels.append(found)
        tree, pos, feature, cut = (found[c].to_numpy() for c in ("tree", "pos", "feature", "cut"))
        for t in range(trees):
            at = (tree == t) & (feature >= 0)
            features, limits = np.zeros(1 << level, np.int64), np.full(1 << level, 255, np.uint8)
            features[pos[at]], limits[pos[at]] = feature[at], cut[at]
            walks[t].append((features, limits))
            places[t] = np.sort(np.concatenate([2 * pos[at], 2 * pos[at] + 1])).astype(np.int64)
        if not any(len(p) for p in places):
            break
    return levels


def _histograms(blocks, trees, walks, places, width, bins, seed, last) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree: (count, sum of labels and on the last level of their squares) x feature x open node x bin, and squares by node."""
    out = [(np.zeros((3 if last else 2, width, len(places[t]), bins)), np.zeros(len(places[t]))) for t in trees]
    slots = []
    for t in trees:
        slots.append(np.full(1 << len(walks[t]), -1, np.int64))
        slots[-1][places[t]] = np.arange(len(places[t]))
    for no, path, n in blocks:
        store, name = _store(path)
        with store.open_input_file(name) as f:
            raw = f.read()
        codes, labels = np.frombuffer(raw, np.uint8, n * width), np.frombuffer(raw, "<f8", n, n * width)
        for t, (parts, squares), slot in zip(trees, out, slots):
            if not len(places[t]):
                continue
            nodes, draws = len(places[t]), np.random.SFC64([seed, t, no])
            all_open = nodes == len(slot)
            for lo in range(0, n, STEP_ROWS):
                hi = min(n, lo + STEP_ROWS)
                drawn = draws.random_raw(-(-(hi - lo) // 4)).view(np.uint16)[: hi - lo]
                kept = np.flatnonzero(drawn >= _ONCE)
                base, at = (kept + lo) * width, np.zeros(len(kept), np.int64)
                for level, (features, limits) in enumerate(walks[t]):
                    if level:
                        code = codes.take(base + features.take(at))
                        right = code > limits.take(at)
                        at += at
                        at += right
                    else:
                        at += codes.take(base + features[0]) > limits[0]
                node = slot.take(at)
                if not all_open:
                    still = np.flatnonzero(node >= 0)
                    node, base, kept = node[still], base[still], kept[still]
                weight, y = _POISSON.take(drawn.take(kept)), labels[lo:hi].take(kept)
                measures = [weight, weight * y]
                measures.append(measures[1] * y)
                squares += np.bincount(node, measures[2], nodes)
                node = node * bins
                for f in range(width):
                    key = node + codes.take(base + f)
                    for part, measure in zip(parts, measures):
                        part[f] += np.bincount(key, measure, nodes * bins).reshape(nodes, bins)
    return out


def _splits(tree: int, places: np.ndarray, parts: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    """The best split of each node; feature -1 where none tells rows apart."""
    count, total = parts[0], parts[1]
    n, s = count[0].sum(axis=-1), total[0].sum(axis=-1)
    left_n, left_s = np.cumsum(count, axis=-1)[..., :-1], np.cumsum(total, axis=-1)[..., :-1]
    right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((left_n > 0) & (right_n > 0), left_s**2 / left_n + right_s**2 / right_n, -np.inf)
        # By node, features in order.
        score = score.transpose(1, 0, 2).reshape(len(places), -1)
        best = score.argmax(axis=1)
        gain = (score[np.arange(len(places)), best] - s * s / n) / n
    feature, cut = np.divmod(best, left_n.shape[-1])
    here = (feature, np.arange(len(places)), cut)
    # What is no more than rounding is no gain.
    good = (n > 0) & np.isfinite(gain) & (gain > 1e-12 * squares / np.maximum(n, 1))
    left_q = np.cumsum(parts[2], axis=-1)[here] if len(parts) > 2 else np.full(len(places), np.nan)
    found = [np.full(len(places), tree), places, n, s, squares, np.where(good, feature, -1), cut, np.where(good, gain, -1.0), left_n[here], left_s[here], left_q]
    kinds = {"int": pa.int32(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(a, kinds[k]) for a, k in zip(found, _FOUND.values())], names=list(_FOUND))


def _nodes(levels: list[pa.Table], depth: int) -> dict[str, np.ndarray]:
    """All nodes: level, tree, pos, n, s, q, feature, cut, gain. Those below the last splits have no split."""
    columns = ["tree", "pos", "n", "s", "q", "feature", "cut", "gain"]
    parts = []
    for level, found in enumerate(levels):
        parts.append({c: found[c].to_numpy() for c in columns} | {"level": np.full(len(found), level)})
    if depth and len(levels) == depth:
        end = {c: levels[-1][c].to_numpy() for c in _FOUND}
        at = end["feature"] >= 0
        for side in (0, 1):
            leaf = {m: end[f"left_{m}"][at] if not side else end[m][at] - end[f"left_{m}"][at] for m in ("n", "s", "q")}
            k = int(at.sum())
            leaf |= {"tree": end["tree"][at], "pos": 2 * end["pos"][at] + side, "level": np.full(k, depth)}
            parts.append(leaf | {"feature": np.full(k, -1), "cut": np.zeros(k, int), "gain": np.full(k, -1.0)})
    nodes = {c: np.concatenate([p[c] for p in parts]) for c in [*columns, "level"]}
    order = np.lexsort((nodes["pos"], nodes["level"], nodes["tree"]))
    return {c: v[order] for c, v in nodes.items()}


def _stored(spark: SparkSession, learner: RandomForestRegressor, levels: list[pa.Table], cuts: list[np.ndarray], mean: float) -> RandomForestRegressionModel:
    """The forest as a model: Spark's format of stored models, around the settings of a model of two rows."""
    nodes = _nodes(levels, learner.getMaxDepth())
    tree, level, pos = nodes["tree"], nodes["level"], nodes["pos"]
    first = np.searchsorted(tree, tree)
    number = np.arange(len(tree)) - first
    # Children in the order of nodes, so that they can be looked up.
    key = (tree.astype(np.int64) << 40) + (level.astype(np.int64) << 32) + pos
    inner = nodes["feature"] >= 0
    left = np.searchsorted(key, (tree.astype(np.int64) << 40) + ((level.astype(np.int64) + 1) << 32) + 2 * pos.astype(np.int64))
    left = np.where(inner, left - first, -1)
    n, s, q = nodes["n"], nodes["s"], nodes["q"]
    at = s / n
    stats = np.stack([n, s + n * mean, q + 2 * mean * s + n * mean * mean], axis=1)
    limits = [[float(cuts[f][c])] if f >= 0 else [] for f, c in zip(nodes["feature"].tolist(), nodes["cut"].tolist())]
    split = {"featureIndex": pa.array(nodes["feature"], pa.int32()), "leftCategoriesOrThreshold": pa.array(limits, pa.list_(pa.float64()))}
    split["numCategories"] = pa.array(np.full(len(n), -1), pa.int32())
    data = {
        "id": pa.array(number, pa.int32()), "prediction": pa.array(mean + at), "impurity": pa.array(np.maximum(q / n - at * at, 0.0)),
        "impurityStats": pa.array(list(stats), pa.list_(pa.float64())), "rawCount": pa.array(np.rint(n), pa.int64()), "gain": pa.array(nodes["gain"]),
        "leftChild": pa.array(left, pa.int32()), "rightChild": pa.array(np.where(inner, left + 1, -1), pa.int32()),
        "split": pa.StructArray.from_arrays(list(split.values()), names=list(split)),
    }
    table = pa.table({"treeID": pa.array(tree, pa.int32()), "nodeData": pa.StructArray.from_arrays(list(data.values()), names=list(data))})
    ends = [(Vectors.dense([float(v)] * len(cuts)), float(v)) for v in (0, 1)]
    frame = spark.createDataFrame(ends, [learner.getFeaturesCol(), learner.getLabelCol()])
    shell, path = shared_path(spark, "forest-shell"), shared_path(spark, "forest")
    learner.fit(frame).write().save(shell)
    spark.read.text(f"{shell}/metadata").coalesce(1).write.text(f"{path}/metadata")
    spark.read.parquet(f"{shell}/treesMetadata").write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(table, _DATA).write.parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
