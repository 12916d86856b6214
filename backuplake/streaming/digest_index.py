"""An index of stored digests that a batch reads in proportion to itself, not to the index.

Digests fall into `prefixes` by a hash. Under each prefix lie Parquet files sorted by that hash, each with a Bloom filter per
row group beside it (`<file>.bloom`, one block of the same size per row group). A digest of a batch picks, by the bounds in
a file's footer, the one row group that could hold it, then asks that row group's filter, and only on a yes reads the rows
and compares the digests themselves. Every batch adds one file per prefix it touches at level 0; `fanout` files of a level
are merged into one of the next, slice by slice, so each digest is rewritten once per level and a prefix holds
at most `fanout` - 1 files a level.

The files that count after a batch are named in `root`/manifest/batch_id=N, written last. A replayed batch starts from the
manifest before it, so it finds the same digests; files of tries that failed are named nowhere. Only files are added:
a manifest that was read stays readable. Work is one task per prefix; choose `prefixes` so that a batch's
share of one fits a task (the index itself is never held: rows are read a row group at a time, merges a slice at a time).

A null digest counts as one digest. `root` must be a folder that every executor and Arrow can reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backuplake.session import ship
from backuplake.sources.committed import _store

PREFIXES = 64
FANOUT = 8
#: Rows of a row group, and bits of its Bloom filter per row: about one false yes in 120 with seven probes.
GROUP_ROWS = 65_536
BITS_PER_ROW = 10
PROBES = 7

_RESULT = "kind string, prefix int, file string, level int, rows long, bytes_read long, opened int, digest {kind}"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """`PROBES` places per hash by double hashing."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray, bits: int) -> bytes:
    field = np.zeros(bits, np.uint8)
    field[_places(hashes, bits).ravel()] = 1
    return np.packbits(field).tobytes()


def may_hold(block: bytes, hashes: np.ndarray) -> np.ndarray:
    field = np.unpackbits(np.frombuffer(block, np.uint8))
    return field[_places(hashes, len(field))].all(axis=1)


class _Writer:
    """One sorted file with its filters; rows come in order of their hash."""

    def __init__(self, store, top: str, prefix: int, schema: pa.Schema, group_rows: int):
        self.name, self.group_rows = f"{prefix}/{uuid.uuid4().hex}.parquet", group_rows
        store.create_dir(f"{top}/{prefix}", recursive=True)
        self.rows, self.waiting, self.held = 0, [], 0
        self.file = pq.ParquetWriter(f"{top}/{self.name}", schema, filesystem=store)
        self.blooms = store.open_output_stream(f"{top}/{self.name}.bloom")

    def add(self, table: pa.Table) -> None:
        self.waiting.append(table)
        self.held += table.num_rows
        if self.held >= self.group_rows:
            whole = pa.concat_tables(self.waiting)
            full = whole.num_rows - whole.num_rows % self.group_rows
            for at in range(0, full, self.group_rows):
                self._group(whole.slice(at, self.group_rows))
            self.waiting, self.held = [whole.slice(full)], whole.num_rows - full

    def _group(self, table: pa.Table) -> None:
        self.file.write_table(table, row_group_size=table.num_rows)
        self.blooms.write(bloom(table.column("h").to_numpy(), 8 * _block_bytes(self.group_rows)))
        self.rows += table.num_rows

    def close(self) -> tuple[str, int]:
        if self.held:
            self._group(pa.concat_tables(self.waiting))
        self.file.close()
        self.blooms.close()
        return self.name, self.rows


def _block_bytes(group_rows: int) -> int:
    return -(-group_rows * BITS_PER_ROW // 8)


def _bounds(footer) -> np.ndarray:
    """Least and greatest hash of every row group; `h` is the first column."""
    stats = [footer.row_group(i).column(0).statistics for i in range(footer.num_row_groups)]
    return np.array([(s.min, s.max) for s in stats], np.int64).reshape(-1, 2)


def _held_in(store, path: str, hashes: np.ndarray, digests: list, group_rows: int) -> tuple[np.ndarray, int]:
    """Which of the digests a file holds, and the bytes read from it beyond the footer. `hashes` ascend."""
    found, read, block = np.zeros(len(hashes), bool), 0, _block_bytes(group_rows)
    with store.open_input_file(path) as raw, store.open_input_file(f"{path}.bloom") as filters:
        file = pq.ParquetFile(raw)
        for g, (low, high) in enumerate(_bounds(file.metadata)):
            a, b = np.searchsorted(hashes, low, "left"), np.searchsorted(hashes, high, "right")
            if a == b:
                continue
            filters.seek(g * block)
            likely = a + np.flatnonzero(may_hold(filters.read(block), hashes[a:b]))
            read += block
            if not len(likely):
                continue
            rows = file.read_row_group(g)
            read += file.metadata.row_group(g).total_byte_size
            stored = rows.filter(pa.array(np.isin(rows.column("h").to_numpy(), hashes[likely])))
            known = set(zip(stored.column("h").to_pylist(), stored.column("digest").to_pylist()))
            for i in likely:
                found[i] |= (int(hashes[i]), digests[i]) in known
    return found, read


def _merge(store, top: str, prefix: int, names: list[str], schema: pa.Schema, group_rows: int) -> tuple[str, int]:
    """Sorted files as one. Slices between bounds of the largest file's row groups are merged one at a time."""
    files = [pq.ParquetFile(f"{top}/{n}", filesystem=store) for n in names]
    bounds = [_bounds(f.metadata) for f in files]
    cuts = np.unique(max(bounds, key=len)[:, 1])
    out, last = _Writer(store, top, prefix, schema, group_rows), None
    # A row group that straddles a cut is read once for each slice it touches.
    for cut in [*cuts.tolist(), None]:
        parts = []
        for file, bound in zip(files, bounds):
            touched = [g for g, (low, high) in enumerate(bound) if (cut is None or low <= cut) and (last is None or high > last)]
            for g in touched:
                rows = file.read_row_group(g)
                h = rows.column("h").to_numpy()
                parts.append(rows.filter(pa.array((h <= (cut if cut is not None else h)) & (h > last if last is not None else True))))
        if parts and sum(p.num_rows for p in parts):
            out.add(pa.concat_tables(parts).sort_by("h"))
        last = cut
    for file in files:
        file.close()
    return out.close()


def manifest(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """prefix, file, level, rows of the files that count after a batch."""
    path = f"{root.rstrip('/')}/manifest/batch_id={batch_id}"
    return spark.read.schema("prefix int, file string, level int, rows long").parquet(path)


def read(spark: SparkSession, root: str, batch_id: int, kind: str, key: str = "digest") -> DataFrame:
    """All digests after a batch. `kind` is their type."""
    # Files a prefix: fanout - 1 a level at most, so names are few whatever the rows.
    files = [f"{root.rstrip('/')}/files/{r.file}" for r in manifest(spark, root, batch_id).select("file").collect()]
    rows = spark.read.schema(f"h long, digest {kind}")
    return (rows.parquet(*files) if files else spark.createDataFrame([], f"h long, digest {kind}")).select(F.col("digest").alias(key))


def add(batch: DataFrame, batch_id: int, root: str, key: str = "digest", prefixes: int = PREFIXES, fanout: int = FANOUT, group_rows: int = GROUP_ROWS) -> None:
    """Puts a batch's digests into the index. `root`/steps/batch_id=N tells what was new, what was merged and read:
    kind ('new', 'file' or 'read'), prefix, file, level, rows, bytes_read, opened, digest."""
    spark, root = batch.sparkSession, root.rstrip("/")
    ship(spark)
    kind = batch.schema[key].dataType.simpleString()
    digests = batch.select(F.col(key).alias("digest")).distinct().withColumn("h", F.xxhash64("digest"))
    # The low bits deal prefixes; order within one is by the whole hash.
    fresh = digests.withColumn("prefix", F.pmod("h", F.lit(prefixes)).cast("int"))
    nothing = spark.createDataFrame([], "prefix int, file string, level int, rows long")
    before = manifest(spark, root, batch_id - 1) if batch_id else nothing

    def step(arrived: pa.Table, files: pa.Table) -> pa.Table:
        store, base = _store(root)
        top = f"{base}/files"
        schema = pa.schema([("h", pa.int64()), ("digest", arrived.schema.field("digest").type)])
        old = files.select(["file", "level", "rows"]).to_pylist()
        out: list[tuple] = []
        prefix = (arrived if arrived.num_rows else files).column("prefix")[0].as_py()
        if arrived.num_rows:
            rows = arrived.select(["h", "digest"]).cast(schema).sort_by("h")
            hashes, names = rows.column("h").to_numpy(), rows.column("digest").to_pylist()
            stored, read_bytes = np.zeros(len(hashes), bool), 0
            for f in old:
                left = np.flatnonzero(~stored)
                if len(left):
                    found, read_ = _held_in(store, f"{top}/{f['file']}", hashes[left], [names[i] for i in left], group_rows)
                    stored[left] |= found
                    read_bytes += read_
            out.append(("read", prefix, None, None, len(hashes), read_bytes, len(old), None))
            new = rows.filter(pa.array(~stored))
            if new.num_rows:
                writer = _Writer(store, top, prefix, schema, group_rows)
                writer.add(new)
                path, count = writer.close()
                old.append({"file": path, "level": 0, "rows": count})
                out += [("new", prefix, None, None, 1, 0, 0, d) for d in new.column("digest").to_pylist()]
            level = 0
            while sum(f["level"] == level for f in old) >= fanout:
                full = [f for f in old if f["level"] == level]
                path, count = _merge(store, top, prefix, [f["file"] for f in full], schema, group_rows)
                old = [f for f in old if f["level"] != level] + [{"file": path, "level": level + 1, "rows": count}]
                level += 1
        out += [("file", prefix, f["file"], f["level"], f["rows"], 0, 0, None) for f in old]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), schema.field("digest").type]
        names_ = ["kind", "prefix", "file", "level", "rows", "bytes_read", "opened", "digest"]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names_)

    steps = fresh.groupBy("prefix").cogroup(before.groupBy("prefix")).applyInArrow(step, _RESULT.format(kind=kind))
    steps.write.mode("overwrite").parquet(f"{root}/steps/batch_id={batch_id}")
    done = spark.read.schema(steps.schema).parquet(f"{root}/steps/batch_id={batch_id}")
    # A row per file: small. Written last; the batch counts once it is there.
    done.filter("kind = 'file'").select("prefix", "file", "level", "rows").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch_id={batch_id}")


def new_digests(spark: SparkSession, root: str, kind: str, key: str = "digest") -> DataFrame:
    """batch_id and every digest that was new in it."""
    rows = spark.read.schema(_RESULT.format(kind=kind) + ", batch_id long").parquet(f"{root.rstrip('/')}/steps")
    return rows.filter("kind = 'new'").select("batch_id", F.col("digest").alias(key))


def reads(spark: SparkSession, root: str) -> DataFrame:
    """batch_id, prefix, digests asked, files opened and bytes read from them."""
    rows = spark.read.schema("kind string, prefix int, rows long, bytes_read long, opened int, batch_id long").parquet(f"{root.rstrip('/')}/steps")
    return rows.filter("kind = 'read'").select("batch_id", "prefix", F.col("rows").alias("asked"), "opened", "bytes_read")


def writer(root: str, key: str = "digest", **sizes: int) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` target."""
    return lambda batch, batch_id: add(batch, batch_id, root, key, **sizes)
