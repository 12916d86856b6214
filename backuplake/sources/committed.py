"""A sink whose rows count only once they are committed: each batch once, however often it is tried.

    stream.writeStream.format("committed_files").option("path", root).option("log", "alerts").start()
    rows = committed.read(spark, root)

Tasks write Parquet files of their own names below `root`/files, in any number of tries; nothing there counts yet. The
commit, on the driver, puts the names of one try's files into `root`/commits/<log>.<batch>.json, complete and only
if that file is not there: a batch that is committed stays as it is, and files of lost or repeated tries are in no
commit. Readers take the rows of committed files only. `log` names the stream, so several can share a root; batch
numbers count from a stream's checkpoint, so a stream that starts on a new checkpoint needs a new name.

`root` must be reachable from every executor: a plain path, `file:`, or a store that Arrow knows. On local file
systems the commit is a hard link, which the system refuses if the name is taken; elsewhere it is written aside and moved
after a look, which is enough for the one driver that a checkpoint has. A batch needs a row per task on the driver.
Files of tries that never committed stay; `orphans` lists them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

NAME = "committed_files"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")


def put_if_absent(store, folder: str, name: str, data: bytes) -> bool:
    """Writes a small file, complete, unless there is one of that name; False if there is."""
    from pyarrow import fs

    target, aside = f"{folder}/{name}", f"{folder}-tries/{uuid.uuid4().hex}"
    for needed in (folder, f"{folder}-tries"):
        store.create_dir(needed, recursive=True)
    with store.open_output_stream(aside) as out:
        out.write(data)
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(aside, target)
        except FileExistsError:
            return False
        return True
    if store.get_file_info(target).type != fs.FileType.NotFound:
        return False
    store.move(aside, target)
    return True


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Files:
    """Writing a task's rows, and putting a try's files into the log."""

    def __init__(self, root: str, log: str, overwrite: bool = False):
        if overwrite:
            raise ValueError(f"{NAME} only adds rows")
        if not root:
            raise ValueError(f"{NAME} needs a path")
        if "/" in log or "." in log:
            raise ValueError(f"not a name for a log: {log}")
        self.root, self.log = root, log

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.root)
        name, writer, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not len(batch):
                continue
            if writer is None:
                store.create_dir(f"{top}/files", recursive=True)
                writer = pq.ParquetWriter(f"{top}/files/{name}", batch.schema, filesystem=store)
            writer.write_batch(batch)
            rows += len(batch)
        if writer is None:
            return Written(None, 0)
        writer.close()
        return Written(name, rows)

    def put(self, messages: list[Written | None], batch: int) -> bool:
        """Commits a try; False if the batch is committed already."""
        store, top = _store(self.root)
        found = [m for m in messages if m is not None and m.file]
        lines = [json.dumps({"log": self.log, "batch": batch, "file": m.file, "rows": m.rows}) for m in found]
        return put_if_absent(store, f"{top}/commits", f"{self.log}.{batch}.json", "\n".join([*lines, ""]).encode())


class StreamFiles(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self.put(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        """Nothing to undo: files count only in a commit."""


class BatchFiles(_Files, DataSourceArrowWriter):
    """One batch, named by the option `batch`."""

    def __init__(self, root: str, log: str, batch: int, overwrite: bool):
        super().__init__(root, log, overwrite)
        self.batch = batch

    def commit(self, messages) -> None:
        self.put(messages, self.batch)

    def abort(self, messages) -> None:
        """Nothing to undo: files count only in a commit."""


class CommittedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema, overwrite: bool) -> StreamFiles:
        return StreamFiles(self.options.get("path"), self.options.get("log", "log"), overwrite)

    def writer(self, schema, overwrite: bool) -> BatchFiles:
        if self.options.get("batch") is None:
            raise ValueError(f"{NAME} needs the option batch: a number that stays the same when the write is repeated")
        return BatchFiles(self.options.get("path"), self.options.get("log", "log"), int(self.options["batch"]), overwrite)


def append(df: DataFrame, root: str, log: str, batch: int) -> None:
    """Adds a batch; a batch of that log and number that is there already stays."""
    df.sparkSession.dataSource.register(CommittedFiles)
    df.write.format(NAME).option("path", root).option("log", log).option("batch", batch).mode("append").save()


def stream_to_end(df: DataFrame, root: str, log: str, checkpoint: str) -> None:
    """Commits all available input of a stream, batch by batch."""
    df.sparkSession.dataSource.register(CommittedFiles)
    writer = df.writeStream.format(NAME).option("path", root).option("log", log).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def commits(spark: SparkSession, root: str) -> DataFrame:
    """log, batch, file, rows of every committed file."""
    return spark.read.schema("log string, batch bigint, file string, rows bigint").json(f"{root.rstrip('/')}/commits")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Committed rows with their `log` and `batch`. A commit names each file once, so rows meet one entry each."""
    rows = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/files").withColumn("_file", _base(F.input_file_name()))
    return rows.join(commits(spark, root).withColumnRenamed("file", "_file").drop("rows"), "_file").drop("_file")


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Files (path) that no commit names: of tries that failed, were repeated, or are still going on."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/files").select("path", _base(F.col("path")).alias("file"))
    return files.join(commits(spark, root), "file", "left_anti").select("path")
