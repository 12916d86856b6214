"""Approximate nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is rotated by a seeded orthogonal matrix; the signs of its coordinates are its code.
The inner product of the vector with its own code is kept as a correction: divided by it, the
product of a code and a query is an unbiased estimate of their cosine, with an error bound that
holds with a probability set by `spread`. Per block of codes, vectors are reranked with exact
cosines where the estimate plus its bound reaches the k-th best cosine known so far. Every row is
indexed; no cell or candidate list is capped.

Vectors that are null, zero, or hold null or non-finite components take no part; rows that share an
id count once. Vectors of another dimension than the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.llm.topk import _matrix, best
from backuplake.llm.vectors import QUERY_BLOCK, VECTOR_BLOCK, blocks, numbered, on_all, usable
from backuplake.session import pin

#: Width of the error bound; a true neighbour is missed where an estimate is this many deviations too low.
SPREAD = 2.2
SEED = 20240529
#: Queries estimated at once, and vectors reranked before the bound is used.
CELL = 256
FIRST = 32


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and their corrections."""
    turned = _units(v) @ rotation(v.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])


def _near_one(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: exact, and squares stay in range."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _units(v: np.ndarray) -> np.ndarray:
    own = _near_one(v)
    return own / np.sqrt((own * own).sum(axis=1))[:, None]


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal values wherever they lie."""
    if not len(v):
        return np.zeros(0)
    q, v = _near_one(q), _near_one(v)
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def index(df: DataFrame) -> DataFrame:
    """vec_id, dim, v, code, correction of every vector that takes part."""
    rows = usable(df).filter(F.exists("v", lambda x: x != 0))
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(pa.float64())), ("code", pa.binary()), ("correction", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                bits, correction = codes(_matrix(part.column("v"), int(dim)))
                columns = [part.column("vec_id"), part.column("dim"), part.column("v"), [b.tobytes() for b in bits], correction]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
                )

    return rows.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, v array<double>, code binary, correction double")


def search_block(qid, q, ids, v, bits, correction, k: int, spread: float = SPREAD):
    """(place of query, places of its k best, their cosines) within one block."""
    dim = q.shape[1]
    turned = _units(q) @ rotation(dim).T
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1
    bound = spread * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(max(1, dim - 1))
    for at in range(0, len(q), CELL):
        estimates = (turned[at : at + CELL] @ signs.T) / (correction * np.sqrt(dim))
        for i, estimate in enumerate(estimates, at):
            estimate = np.where(ids == qid[i], -np.inf, estimate)
            ahead = np.argpartition(-estimate, min(FIRST, len(ids) - 1))[:FIRST]
            ahead = ahead[ids[ahead] != qid[i]]
            exact = cosines(np.broadcast_to(q[i], (len(ahead), dim)), v[ahead])
            kth = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
            near = np.flatnonzero((estimate + bound >= kth) & (ids != qid[i]))
            near = np.union1d(near, ahead)
            exact = cosines(np.broadcast_to(q[i], (len(near), dim)), v[near])
            top = best(exact, ids[near], k)
            yield i, near[top], exact[top]


def search(df: DataFrame, is_query, k: int = 5, spread: float = SPREAD) -> DataFrame:
    """query_id, rank, vec_id, score (cosine of the original vectors): each query's k nearest found."""
    indexed = pin(index(df), "codes")
    queries = indexed.filter(is_query).select("vec_id", "dim", "v")
    query_blocks, vector_blocks = blocks(queries.count(), QUERY_BLOCK), blocks(indexed.count(), VECTOR_BLOCK)
    asked = on_all(numbered(queries, "_q", query_blocks), "_b", vector_blocks)
    held = on_all(numbered(indexed, "_b", vector_blocks), "_q", query_blocks)
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(asking: pa.Table, holding: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], []]
        if asking.num_rows and holding.num_rows:
            dim = len(asking.column("v")[0])
            qid, ids = asking.column("vec_id").to_numpy(), holding.column("vec_id").to_numpy()
            bits = np.frombuffer(b"".join(holding.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            q, v = _matrix(asking.column("v"), dim), _matrix(holding.column("v"), dim)
            for i, places, scores in search_block(qid, q, ids, v, bits, holding.column("correction").to_numpy(), k, spread):
                columns[0] += [qid[i]] * len(places)
                columns[1] += ids[places].tolist()
                columns[2] += scores.tolist()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found)], schema=found)

    keys = ["dim", "_q", "_b"]
    hits = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
