"""Packing of documents into sequences of equal capacity.

Each document becomes token ids with an end id and is cut into pieces: whole capacities first, then
a rest. The rests of one document in eight are cut into small shards, which even out the sums of
the others. Pieces fall into blocks by digest; in a block the differencing method of Karmarkar and
Karp splits the rests into windows of nearly equal sums, and the number of windows rises until none
exceeds the capacity.

Null texts count as empty (one piece with the end id). Repeated rows are packed each for itself;
null ids are kept. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.llm.tokens import encoder
from backuplake.session import pin

CAPACITY = 2048
SHARD = 64
#: Pieces expected in a block; its working memory follows.
BLOCK = 1024


def cuts(length: int, whole_rest: bool, capacity: int = CAPACITY, shard: int = SHARD) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full = length // capacity * capacity
    step = capacity if whole_rest else shard
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(step, length - s)) for s in range(full, length, step)]


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens, start, length, ids_crc32 of each piece, and its `ids` if asked for."""
    from backuplake.llm.bpe import _arrow

    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", _arrow(kind)), *[(n, pa.int64()) for n in ("doc_tokens", "start", "length", "ids_crc32")]]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                ids = np.append(coder.ids(data).astype("<u4"), np.uint32(end_id))
                raw = memoryview(ids.tobytes())
                whole_rest = zlib.crc32(raw) % 8 > 0
                for start, n in cuts(len(ids), whole_rest, capacity):
                    row = [doc_id, len(ids), start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])]
                    for column, value in zip(rows, row + [ids[start : start + n].astype(np.int32)] * with_ids):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    ddl = f"doc_id {kind.simpleString()}, doc_tokens long, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, ddl + ", ids array<int>" * with_ids)


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` groups of nearly equal sums.

    A partial partition is a falling list of (sum, node); absent windows are empty. The two with the
    largest spreads are merged, the largest sums of one meeting the smallest of the other.
    """
    left, right = list(range(len(sizes))), [-1] * len(sizes)
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if windows == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - both] + b[: len(b) - both]
            for (x, i), (y, j) in zip(a[len(a) - both :], reversed(b[len(b) - both :])):
                merged.append((x + y, len(left)))
                left.append(i)
                right.append(j)
        merged.sort(reverse=True)
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    groups = []
    for _, node in heap[0][2] if heap else []:
        stack, members = [node], []
        while stack:
            n = stack.pop()
            if right[n] < 0:
                members.append(n)
            else:
                stack += [left[n], right[n]]
        groups.append(members)
    return groups


def windows_of(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Groups whose sums do not exceed the capacity."""
    if not sizes:
        return []
    # Nearly equal sums need a token or two of room in each window.
    count = -(-sum(sizes) // capacity)
    while True:
        groups = differencing(sizes, count)
        over = max(sum(sizes[i] for i in g) for g in groups) - capacity
        if over <= 0:
            return groups
        count += max(1, over * count // (4 * capacity))


def place(cut: DataFrame, count: int, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """`cut` (count rows) with sequence_id and offset.

    A sequence's id is its block's number and its place in the block, so blocks need not know of
    each other.
    """
    names = [c for c in cut.columns if c != "_block"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "_block")

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        first = table.column("_block")[0].as_py() << 24
        full = [[i] for i, n in enumerate(lengths) if n == capacity]
        rest = [i for i, n in enumerate(lengths) if n < capacity]
        groups = full + [[rest[j] for j in g] for g in windows_of([lengths[i] for i in rest], capacity)]
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for g, members in enumerate(groups):
            at = 0
            for i in sorted(members):
                sequence[i], offset[i] = first + g, at
                at += lengths[i]
        out = table.select(names)
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    blocks = max(1, -(-count // block))
    # Row numbers of written files are the same in every attempt, and spread rows that are alike.
    keyed = cut.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return keyed.groupBy("_block").applyInArrow(pack, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece: where it comes from and where it lies."""
    cut = pin(pieces(docs, path, end_id, capacity), "pieces")
    return place(cut, cut.count(), capacity, block)


def sequences(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, `ids` padded to the capacity (or left at a power of two), `used`."""
    cut = pin(pieces(docs, path, end_id, capacity, with_ids=True), "pieces")
    placed = place(cut, cut.count(), capacity, block)
    # A sequence holds at most `capacity` ids.
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda p: p["ids"]))
    used = F.size(ids)
    whole = F.bit_count(used.cast("bigint")) == 1
    padding = F.when(whole, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), F.lit(capacity) - used))
    return rows.select("sequence_id", F.concat(ids, padding).alias("ids"), used.alias("used"))
