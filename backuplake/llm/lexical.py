"""Ranked lexical search by exact sparse ball trees.

A score is the inner product of two sparse vectors of whole numbers: for each term of an item its weight
times its repeats, and for each term of a document its damped frequency. Only terms of the items matter,
so documents are read once into short rows (place of a term, occurrences), written out, and counted:
documents with a term, terms in all, documents per term. Each task then gathers its rows into blocks of
bounded size and grows a ball tree over each: a ball holds the vectors below it by centroid and radius, and
is split between two vectors far apart. By Cauchy and Schwarz no vector of a ball scores more than
<query, centroid> + |query| radius; nor, term by term, more than centroid plus one-sided radius of each term
(that is, its greatest value) allows, which is exact in whole numbers and by far the tighter of the two. The
smaller counts. The first is raised by more than floating-point arithmetic can have lost; vectors are scaled by
the root of a term's weight on both sides for it (the product stays the same). An item walks the balls of a block
from the highest bound down until no bound reaches its tenth-best score. Leaves are scored in whole numbers, so
ranks are exact whatever the tree looks like.

Tenth-best scores start from a first search of at most `SEED_DOCS` documents (those with the smallest digests
of their ids) and rise from block to block of a task. A task gives at most `k` rows per item.

Items are the query set; they are worked in runs of bounded size (`ITEM_TERMS` distinct terms together, an
item is never split), each against all documents. Terms are maximal runs of ASCII letters, digits and
characters beyond ASCII, with only A-Z lower-cased. A document's number of terms is whole whatever its length.

Null and empty texts have no terms: such documents are not counted and not found, such items have no rows.
Repeated rows are documents of their own, so an id may come up twice for an item, at ranks of their own; rows
with a null doc_id count in the statistics and are never returned; items with a null item_id have no rows, and
the terms of rows that share an item_id count together. Only `doc_id`, `item_id` and `text` are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backuplake.session import pin

#: Distinct (item, term) pairs of one run of items; bounds what tasks are sent.
ITEM_TERMS = 20_000
#: Documents and entries of one tree, and numbers in its centroids.
BLOCK_DOCS, BLOCK_ENTRIES, BLOCK_NUMBERS = 8192, 2_000_000, 1 << 24
LEAF = 8
#: Leaves scored at a time.
LEAVES = 16
SEED_DOCS = 8192

_OTHER = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_LOWER = bytes.maketrans(
    (_OTHER + "ABCDEFGHIJKLMNOPQRSTUVWXYZ").encode(), (" " * len(_OTHER) + "abcdefghijklmnopqrstuvwxyz").encode()
)
EPS = float(np.finfo(np.float64).eps)


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def weight(count: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


class Items:
    """A run of items: for each, places and repeats of its terms."""

    def __init__(self, rows: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.places: dict[bytes, int] = {}
        self.vectors = []
        for _, own in rows:
            count = Counter(own)
            at = [self.places.setdefault(t, len(self.places)) for t in count]
            self.vectors.append((np.array(at, np.int64), np.array(list(count.values()), np.int64)))


class Queries:
    """Items as vectors, once the weights of their terms are known."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        self.weights = weights
        self.scale = np.sqrt(weights.astype(np.float64))
        self.exact = [(at[weights[at] > 0], (n * weights[at])[weights[at] > 0]) for at, n in vectors]
        # Divided by the scale that documents are multiplied with.
        self.bent = [value / self.scale[at] for at, value in self.exact]
        self.norms = [float(np.sqrt((b * b).sum())) * (1 + 8 * EPS * (len(b) + 8)) for b in self.bent]


class Block:
    """Documents as rows of places and whole values."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, place: np.ndarray, value: np.ndarray):
        self.ids, self.starts, self.place, self.value = ids, starts, place, value
        self.sizes = np.diff(np.append(starts, len(place)))

    def take(self, rows: np.ndarray) -> Block:
        sizes = self.sizes[rows]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[rows] - starts, sizes) + np.arange(sizes.sum())
        return Block(self.ids[rows], starts, self.place[at], self.value[at])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Whole-number products of all rows with dense weights; every row has an entry."""
        return np.add.reduceat(self.value * weights[self.place], self.starts)


class Tree:
    """Balls over the rows of a block, which is sorted so that each ball is a run of rows."""

    def __init__(self, block: Block, queries: Queries):
        self.queries, self.dims = queries, len(queries.weights)
        order, self.nodes = self._split(block, block.value * queries.scale[block.place])
        self.block = block.take(order)
        bent = self.block.value * queries.scale[self.block.place]
        shape = (len(self.nodes), self.dims)
        #: Per node and term: the greatest value (centroid and one-sided radius of that term together), and the
        #: centroid, which 32-bit numbers round by less than one part in 2**23.
        self.ceiling, self.centre = np.zeros(shape, np.int32), np.zeros(shape, np.float32)
        self.radius = np.zeros(len(self.nodes))
        leaf_of = np.empty(len(order), np.int64)
        for i, (first, end, children) in enumerate(self.nodes):
            if not children:
                leaf_of[first:end] = i
        at = np.repeat(leaf_of, self.block.sizes) * self.dims + self.block.place
        np.maximum.at(self.ceiling.reshape(-1), at, self.block.value.astype(np.int32))
        for i in range(len(self.nodes) - 1, -1, -1):
            first, end, children = self.nodes[i]
            if children:
                np.maximum(*self.ceiling[list(children)], out=self.ceiling[i])
            a = self.block.starts[first]
            b = self.block.starts[end] if end < len(self.block.starts) else len(self.block.place)
            self._ball(i, self.block.place[a:b], bent[a:b], self.block.starts[first:end] - a)
        self.below = [self._below(i) for i in range(len(self.nodes))]

    def _ball(self, i: int, place: np.ndarray, value: np.ndarray, starts: np.ndarray) -> None:
        """Centroid and radius of a node, the radius a safe upper bound."""
        centre = (np.bincount(place, value, self.dims) / len(starts)).astype(np.float32)
        self.centre[i] = centre
        # |x - c|^2 = |c|^2 + sum over own places of (x - c)^2 - c^2.
        near = centre[place].astype(np.float64)
        whole = float(np.dot(centre.astype(np.float64), centre))
        square = whole + np.add.reduceat((value - near) ** 2 - near * near, starts)
        lost = 8 * EPS * (self.dims + 16) * (whole + np.add.reduceat(value * value + 2 * near * near, starts))
        self.radius[i] = math.sqrt((np.maximum(square, 0) + lost).max()) * (1 + 8 * EPS)

    def _below(self, i: int, levels: int = 3) -> np.ndarray:
        """The balls so many levels below a node, or the leaves met before."""
        row = [i]
        for _ in range(levels):
            row = [k for n in row for k in (self.nodes[n][2] or (n,))]
        return np.array(row)

    def _split(self, block: Block, value: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, tuple[int, int] | None]]]:
        """Row order and nodes (first, end, children), the root first.

        A ball is split by which of two far-apart vectors its rows lie nearer to; equal rows stay together
        in a leaf, so a leaf has more than `LEAF` rows only if no split tells them apart.
        """
        order = np.arange(len(block.ids))
        square = np.add.reduceat(value * value, block.starts)
        nodes: list = [None]
        open_ = [(0, 0, len(order))]
        while open_:
            i, first, end = open_.pop()
            nodes[i] = (first, end, None)
            if end - first <= LEAF:
                continue
            rows = order[first:end]
            sizes = block.sizes[rows]
            starts = np.cumsum(sizes) - sizes
            at = np.repeat(block.starts[rows] - starts, sizes) + np.arange(sizes.sum())
            place, own = block.place[at], value[at]

            def apart(k: int) -> np.ndarray:
                """Squared distance of every row to row k."""
                dense = np.zeros(self.dims)
                dense[place[starts[k] : starts[k] + sizes[k]]] = own[starts[k] : starts[k] + sizes[k]]
                return square[rows] + square[rows[k]] - 2 * np.add.reduceat(own * dense[place], starts)

            one = apart(int(np.argmax(square[rows])))
            a = int(np.argmax(one))
            to_a = apart(a)
            b = int(np.argmax(to_a))
            side = to_a - apart(b)
            left = side < np.median(side)
            if not left.any() or left.all():
                left = side < 0
            if not left.any() or left.all():
                continue
            order[first:end] = np.concatenate([rows[left], rows[~left]])
            middle = first + int(left.sum())
            nodes[i] = (first, end, (len(nodes), len(nodes) + 1))
            open_ += [(len(nodes), first, middle), (len(nodes) + 1, middle, end)]
            nodes += [None, None]
        return order, nodes

    def bounds(self, q: int, nodes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold a row scoring `least` or more for query q, and what no row of each exceeds."""
        at, value = self.queries.exact[q]
        top = self.ceiling[nodes[:, None], at] @ value
        nodes, top = nodes[top >= least], top[top >= least]
        inner = self.centre[nodes[:, None], at].astype(np.float64) @ self.queries.bent[q] * (1 + 2.0**-22)
        reach = (inner + self.queries.norms[q] * self.radius[nodes]) * (1 + 16 * EPS * (len(at) + 16))
        bound = np.minimum(top, np.ceil(reach)).astype(np.int64)
        return nodes[bound >= least], bound[bound >= least]

    def search(self, q: int, best: list[tuple[int, int]], k: int, floor: int, visited: list[int]) -> None:
        """Adds this block's rows to the heap `best` of (score, -doc_id); rows under `floor` are of no use."""
        at, value = self.queries.exact[q]
        if not len(at):
            return
        weights = np.zeros(self.dims, np.int64)
        weights[at] = value
        least = max(floor, best[0][0] if len(best) == k else 1)
        queue = [(-int(b), int(n)) for n, b in zip(*self.bounds(q, np.array([0]), least))]
        while queue:
            leaves = []
            while queue and -queue[0][0] >= least and len(leaves) < LEAVES:
                i = heapq.heappop(queue)[1]
                if self.nodes[i][2]:
                    for n, b in zip(*self.bounds(q, self.below[i], least)):
                        heapq.heappush(queue, (-int(b), int(n)))
                else:
                    leaves.append(i)
            if not leaves:
                return
            rows = np.concatenate([np.arange(*self.nodes[i][:2]) for i in leaves])
            visited[0] += len(rows)
            part = self.block.take(rows)
            scores = part.scores(weights)
            for row in np.flatnonzero(scores >= least):
                entry = (int(scores[row]), -int(part.ids[row]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            least = max(floor, best[0][0] if len(best) == k else 1)


def _blocks(batches: Iterator[pa.RecordBatch], count: int, total: int, dims: int) -> Iterator[Block]:
    """Rows of doc_id, n, places, tfs as blocks of bounded size."""
    # Most splits are even, so a tree has about four nodes for each `LEAF` rows.
    most = min(BLOCK_DOCS, max(LEAF, BLOCK_NUMBERS * LEAF // (4 * dims)))
    ids, sizes, place, value, entries = [], [], [], [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("places")), 0))
        if not len(batch):
            continue
        own = [np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("doc_id", "n")]
        # Whole numbers beyond 64 bits need very long texts; Python has no such bound.
        damp = np.array([8 * (25 + 75 * int(n) * count // total) for n in own[1]], np.int64)
        lists = [batch.column(c) for c in ("places", "tfs")]
        size = pc.list_value_length(lists[0]).to_numpy().astype(np.int64)
        at, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        gain = 1_000_000_000 * tf // (1000 * tf + np.repeat(damp, size))
        begin = row = 0
        while row < len(size):
            room = most - sum(map(len, ids))
            last = row + max(1, int(np.searchsorted(np.cumsum(size[row : row + room]), BLOCK_ENTRIES - entries)))
            last = min(last, len(size), row + room)
            end = begin + int(size[row:last].sum())
            ids.append(own[0][row:last])
            sizes.append(size[row:last])
            place.append(at[begin:end])
            value.append(gain[begin:end])
            entries += end - begin
            row, begin = last, end
            if sum(map(len, ids)) >= most or entries >= BLOCK_ENTRIES:
                yield _block(ids, sizes, place, value)
                ids, sizes, place, value, entries = [], [], [], [], 0
    if ids:
        yield _block(ids, sizes, place, value)


def _block(ids, sizes, place, value) -> Block:
    size = np.concatenate(sizes)
    return Block(np.concatenate(ids), np.cumsum(size) - size, np.concatenate(place), np.concatenate(value))


def _read(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the text) and its item terms with occurrences, for documents with a term."""
    places = docs.sparkSession.sparkContext.broadcast(items.places)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = terms(text)
                if not own:
                    continue
                found = np.array([p for p in map(known.get, own) if p is not None], np.int32)
                at, tf = np.unique(found, return_counts=True)
                for column, x in zip(rows, (doc_id, len(own), at, tf)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return pin(ids.mapInArrow(run, "doc_id long, n long, places array<int>, tfs array<bigint>"), "lexical")


def _counts(read: DataFrame, dims: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all, and documents per term; each task counts its own rows first."""
    schema = pa.schema([("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(dims, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("places").flatten().to_numpy(), minlength=dims)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], schema=schema)

    count, total = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_term = read.select("places").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df = np.zeros(dims, np.int64)
    # One row per term of this run of items at most.
    for place, n in per_term.collect():
        df[place] = n
    return count, total, df


def _search(read: DataFrame, items: Items, queries: Queries, floors: list[int], count: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k of each task, and (item_id null) how many rows it scored."""
    sent = read.sparkSession.sparkContext.broadcast((items.ids, queries, floors))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, floors = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        visited = [0]
        for block in _blocks(batches, count, total, len(queries.weights)):
            tree = Tree(block, queries)
            for q, heap in enumerate(best):
                tree.search(q, heap, k, floors[q], visited)
        rows = [(i, -d, s) for i, heap in zip(ids, best) for s, d in sorted(heap, reverse=True)]
        rows.append((None, None, visited[0]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read.filter("doc_id IS NOT NULL").mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.filter("item_id IS NOT NULL").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def runs(benchmark: DataFrame) -> Iterator[Items]:
    """Items in runs of bounded size; one run is on the driver at a time."""
    schema = pa.schema([("item_id", pa.int64()), ("own", pa.list_(pa.binary())), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [terms(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            arrays = [batch.column("item_id"), pa.array(own, pa.list_(pa.binary())), pa.array([len(set(t)) for t in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    read = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    items = pin(read.mapInArrow(run, "item_id long, own array<binary>, size long").filter("size > 0"), "items")
    sums = items.groupBy(F.xxhash64("item_id").alias("h")).agg(F.sum("size").alias("size"))
    every = max(1, -(-(sums.agg(F.sum("size")).first()[0] or 0) // ITEM_TERMS))
    for part in range(every):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(every)) == part).select("item_id", "own").collect()
        if rows:
            together: dict[int, list[bytes]] = {}
            for item_id, own in rows:
                together.setdefault(item_id, []).extend(map(bytes, own))
            yield Items(sorted(together.items()))


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, seed_docs: int = SEED_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    return search_counted(docs, benchmark, k, seed_docs)[0]


def search_counted(docs: DataFrame, benchmark: DataFrame, k: int = 10, seed_docs: int = SEED_DOCS) -> tuple[DataFrame, DataFrame]:
    """The same, and the numbers of rows scored at leaves per task (`score`, the other columns null)."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for items in runs(benchmark):
        read = _read(docs, items)
        count, total, df = _counts(read, len(items.places))
        if not total:
            continue
        queries = Queries(items.vectors, np.array([weight(count, int(n)) for n in df], np.int64))
        floors = [1] * len(items.ids)
        if count > seed_docs:
            share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (seed_docs << 30) // count
            # The limit makes one partition of the rows that are left.
            seed = _ranked(_search(read.filter(share).limit(seed_docs), items, queries, floors, count, total, k), k)
            place = {i: n for n, i in enumerate(items.ids)}
            # k rows per item of this run at most.
            for row in seed.filter(F.col("rank") == k).collect():
                floors[place[row.item_id]] = row.score
        found = found.unionByName(pin(_search(read, items, queries, floors, count, total, k), "lexical-best"))
    return _ranked(found, k), found.filter("item_id IS NULL")
