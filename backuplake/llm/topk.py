"""Exact search for the largest inner products, by length buckets.

Candidates fall into classes of nearly the same length; a class is split into blocks of bounded
size. A query's k-th best product with a bounded set of long vectors is its first threshold. The
threshold, divided by the query's and the class's length, is the least cosine a candidate of that
class needs: above one, the class is left out; near one, few coordinates exclude most vectors
(each must lie where that cosine allows); otherwise only lengths exclude. What is left is multiplied
out in whole numbers.

Vectors that are null, or hold null or non-finite components, take no part; rows that share an id
count once (see `vectors.usable`). Vectors of another dimension than the query's are no candidates.
Components are whole numbers: floor(scale * x). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.llm.vectors import QUERY_BLOCK, VECTOR_BLOCK, blocks, numbered, on_all, usable
from backuplake.session import pin

#: Length classes per doubling of the length.
STEPS = 8
#: Vectors that give the first thresholds; the longest ones.
SEEDS = 256
#: Least cosine from which coordinates are looked at, and how many of them.
STEEP = 0.7
FOCUS = 3
#: Products computed at once.
CELL = 256


def whole_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (whole numbers), dim, len2 (squared length) and the length class."""
    rows = usable(df).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")))
    len2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("len2", len2)
    step = F.when(F.col("len2") > 0, F.floor(F.log2("len2") * STEPS / 2)).otherwise(-1).cast("int")
    return rows.withColumn("cls", step)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number products; through doubles where these hold them exactly."""
    if not len(q) or not len(v):
        return np.zeros((len(q), len(v)), np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Bucket:
    """Vectors of one length class, longest first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self.unit = None

    def steep(self, q: np.ndarray, cosine: float) -> np.ndarray:
        """Places whose focus coordinates allow a cosine of at least `cosine` with q."""
        if self.unit is None:
            self.unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        unit = q / np.sqrt((q.astype(np.float64) ** 2).sum())
        left = np.arange(len(self.ids))
        angle = np.arccos(min(1.0, cosine))
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low = -1.0 if own + angle >= np.pi else np.cos(own + angle)
            high = 1.0 if own <= angle else np.cos(own - angle)
            x = self.unit[left, f]
            left = left[(x >= low - 1e-9) & (x <= high + 1e-9)]
        return left

    def search(self, qid: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
        """For each query its k best in this bucket among products of at least `need`."""
        qlen = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        longest = self.length[0] if len(self.length) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((need > 0) & (qlen > 0), need / (qlen * longest), 0.0)
        cosine = np.where(np.isfinite(cosine), cosine, 2.0) * (1 - 1e-12)
        for i in np.flatnonzero((cosine >= STEEP) & (cosine <= 1)):
            left = self.steep(q[i], cosine[i])
            yield i, left, products(q[i : i + 1], self.v[left])[0]
        flat = np.flatnonzero(cosine < STEEP)
        for at in range(0, len(flat), CELL):
            rows = flat[at : at + CELL]
            # A product of `need` asks for a length of at least need / |q|.
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where((need[rows] > 0) & (qlen[rows] > 0), need[rows] / qlen[rows], 0.0).min() * (1 - 1e-12)
            upto = int(np.searchsorted(-self.length, -short, side="right"))
            for i, scores in zip(rows, products(q[rows], self.v[:upto])):
                yield i, np.arange(upto), scores


def search(df: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest products with all other vectors."""
    vectors = pin(whole_vectors(df, scale), "vectors")
    # One row per class of length and dimension: at most some thousands, whatever the rows.
    classes = vectors.groupBy("dim", "cls").agg(F.count(F.lit(1)).alias("n"), F.max("len2").alias("most")).collect()
    seeds = vectors.orderBy(F.col("len2").desc(), "vec_id").limit(SEEDS).select("vec_id", "v", "dim").collect()
    by_dim: dict[int, list] = {}
    for s in seeds:
        by_dim.setdefault(s["dim"], []).append((s["vec_id"], s["v"]))
    first = {d: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.int64)) for d, rows in by_dim.items()}
    parts = {(c["dim"], c["cls"]): blocks(c["n"], VECTOR_BLOCK) for c in classes}
    lengths = {(c["dim"], c["cls"]): float(np.sqrt(c["most"])) for c in classes}
    queries = vectors.filter(is_query)
    query_blocks = blocks(queries.count(), QUERY_BLOCK)

    routed = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("need", pa.float64()), ("_cell", pa.string())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every block of the classes that can hold one of its best."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for vec_id, v, dim, block in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "dim", "_q"))):
                q, need = np.array(v, np.int64), -np.inf
                if dim in first:
                    scores = products(q[None, :], first[dim][1])[0][first[dim][0] != vec_id]
                    need = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf
                qlen = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
                for (d, cls), n in parts.items():
                    if d == dim and (need <= 0 or qlen * lengths[d, cls] * (1 + 1e-9) >= need):
                        for p in range(n):
                            for column, value in zip(out, (vec_id, v, need, f"{d}:{cls}:{p}:{block}")):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, routed)], schema=routed)

    asked = numbered(queries, "_q", query_blocks).select("vec_id", "v", "dim", "_q").mapInArrow(
        route, "vec_id long, v array<long>, need double, _cell string"
    )
    names, ns = list(parts), list(parts.values())
    width = F.create_map(*[F.lit(x) for d_c, n in zip(names, ns) for x in (f"{d_c[0]}:{d_c[1]}", n)]) if names else F.lit(None)
    cls = F.concat_ws(":", "dim", "cls")
    part = F.pmod(F.xxhash64("vec_id"), width[cls].cast("bigint")) if names else F.lit(0)
    held = on_all(vectors.withColumn("_p", part), "_b", query_blocks).select(
        "vec_id", "v", F.concat_ws(":", cls, "_p", "_b").alias("_cell")
    )
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(asking: pa.Table, holding: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], []]
        if asking.num_rows and holding.num_rows:
            dim = len(asking.column("v")[0])
            qid, ids = asking.column("vec_id").to_numpy(), holding.column("vec_id").to_numpy()
            bucket = Bucket(ids, _matrix(holding.column("v"), dim))
            for i, places, scores in bucket.search(qid, _matrix(asking.column("v"), dim), asking.column("need").to_numpy(), k):
                near = bucket.ids[places]
                other = near != qid[i]
                near, scores = near[other], scores[other]
                for j in best(scores, near, k):
                    for column, value in zip(columns, (qid[i], near[j], scores[j])):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found)], schema=found)

    hits = asked.groupBy("_cell").cogroup(held.groupBy("_cell")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
