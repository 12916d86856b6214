"""Token ids in Arrow's file format: batches of fixed-size lists with masks.

Documents are range-partitioned and sorted by id; each task writes one file of equal-length
sequences through Arrow's file systems, so the folder may be in any store they reach. A reader maps
a file and takes any sequence or document without decoding the rest: position p of a file is in
sequence p // length, whose place is known. The last sequence of a file is padded and its mask says
how far it counts.

Files are named once per attempt; only the manifest, written after them, says which ones count, so
a lost executor leaves at most a file nobody lists. Null texts count as empty. Rows with a null or
repeated id are kept, nulls first. Other columns are not read. An empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backuplake.llm.tokens import encoder
from backuplake.session import pin, shared_path

SEQUENCE = 2048
#: Sequences in a batch of the file.
BATCH = 256
#: Bytes of text encoded at once; a longer text is a part of its own.
PART = 1 << 23


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1))


class Writer:
    """Appends ids to a file of fixed-size sequences."""

    def __init__(self, folder: str, dtype: np.dtype, length: int = SEQUENCE):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        self.name, self.length, self.dtype = f"{uuid.uuid4().hex}.arrow", length, dtype
        value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = store.open_output_stream(f"{path}/{self.name}")
        self.file = ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.position = 0

    def add(self, ids: np.ndarray) -> int:
        """Position of the first of these ids."""
        start = self.position
        self.waiting.append(ids)
        self.position += len(ids)
        self.held += len(ids)
        if self.held >= self.length * BATCH:
            data = np.concatenate(self.waiting)
            step = self.length * BATCH
            for at in range(0, len(data) // step * step, step):
                self._write(data[at : at + step], step)
            self.waiting = [data[len(data) // step * step :].copy()]
            self.held = len(self.waiting[0])
        return start

    def _write(self, data: np.ndarray, used: int) -> None:
        mask = np.zeros(len(data), bool)
        mask[:used] = True
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(data, self.schema.field("ids").type.value_type), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.file.write_batch(pa.record_batch(arrays, schema=self.schema))

    def close(self) -> None:
        data = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.dtype)
        if len(data):
            self._write(np.append(data, np.zeros(-len(data) % self.length, self.dtype)), len(data))
        self.file.close()
        self.sink.close()


class Reader:
    """Random access to a file's sequences, masks and runs of ids. Local files are mapped, not read."""

    def __init__(self, folder: str, name: str):
        store, path = _store(folder)
        path = f"{path}/{name}"
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.at != k:
            self.batch, self.at = self.file.get_batch(k), k
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence `i`; the ids are a view of the file."""
        batch, row = self._batch(i // BATCH), i % BATCH
        ids = batch.column("ids").slice(row, 1).flatten().to_numpy(zero_copy_only=True)
        return ids, batch.column("mask").slice(row, 1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """`count` ids from position `start`."""
        step, parts = self.length * BATCH, []
        for k in range(start // step, -(-(start + count) // step)):
            flat = self._batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[max(0, start - k * step) : start + count - k * step])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, in parts of about `PART` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(start, end - start)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """Writes the files and returns their manifest: file, doc_id, position (in the file), n_tokens."""
    from backuplake.llm.bpe import _arrow

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("file", pa.string()), ("doc_id", _arrow(kind)), ("position", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = encoder(path), None
        for batch in batches:
            out = out or Writer(folder, coder.dtype, length)
            for part in _parts(batch):
                ids, sizes = coder.column(part.column("text"))
                ends = np.cumsum(sizes)
                start = out.add(np.insert(ids, ends, end_id))
                positions = start + ends - sizes + np.arange(len(sizes))
                columns = [pa.array([out.name] * len(sizes)), part.column("doc_id"), pa.array(positions), pa.array(sizes + 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if out:
            out.close()

    rows = docs.select("doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )
    ddl = f"file string, doc_id {kind.simpleString()}, position long, n_tokens long"
    return pin(ordered.mapInArrow(run, ddl), "token-manifest")


def spans(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`: ids of all documents before a document."""
    files = manifest.groupBy("file").agg(F.sum("n_tokens").alias("_n"), F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
    # One row per file; a range of ids is in one file, so files follow each other.
    before = Window.orderBy(F.col("_first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return manifest.join(base, "file").withColumn("start", F.col("_base") + F.col("position")).drop("_base")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads every listed document back: doc_id, start, n_tokens, ids_crc32 of its ids as 32-bit integers."""
    from backuplake.llm.bpe import _arrow

    placed = spans(manifest)
    kind = placed.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", _arrow(kind)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            crcs = []
            for file, position, n in zip(*(batch.column(c).to_pylist() for c in ("file", "position", "n_tokens"))):
                if file != name:
                    name, reader = file, Reader(folder, file)
                crcs.append(zlib.crc32(reader.ids(position, n).astype("<u4").tobytes()))
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long"
    return placed.select("file", "doc_id", "start", "position", "n_tokens").mapInArrow(run, ddl)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared place."""
    return shared_path(spark, "token-files")
