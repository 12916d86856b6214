"""Directory trees as a Spark data source: a row per file and folder below a root, contents never read.

    spark.dataSource.register(TreeSource)
    spark.read.format("backup_tree").load("/mnt/backups").filter("size > 1000000")

Files of zero bytes, folders (empty ones too) and permissions are all there. The tree is cut into subtrees that
tasks walk on their own; planning opens no more folders than there are pieces wanted, and looks at no more than
`WIDE` entries of any. A folder with more than that is cut by the digest of its entries' names instead. The options
`prefix`, `least`, `most` and `kind` narrow the scan: subtrees that cannot hold a match are never opened.

With the option `pushdown` and `spark.sql.python.filterPushdown.enabled` (off by default) filters on the start of `path`, on `path`,
`parent_path`, `is_directory` and the bounds of `size` go the same way. Spark 4.1 keeps one set of such filters per
loaded DataFrame, so with that setting a query must not use one DataFrame twice under different filters: load the
tree once for each. Options have no such limit, so the library uses those.

The root must be reachable from every executor. Plain paths and `file:` are read with their permissions; other
schemes that Arrow knows have none (null). Symbolic links are rows of their own and are not followed. What is
removed during the scan is left out; a folder that may not be opened ends the scan.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
)

SCHEMA = "path string, parent_path string, name string, size bigint, modified_time timestamp, is_directory boolean, permissions string"
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("parent_path", pa.string()), ("name", pa.string()), ("size", pa.int64()),
        ("modified_time", pa.timestamp("us", tz="UTC")), ("is_directory", pa.bool_()), ("permissions", pa.string()),
    ]
)
#: Pieces of a tree, unless the option `pieces` says otherwise.
PIECES = 256
#: Entries of one folder that planning looks at.
WIDE = 50_000
BATCH = 8192


@dataclass
class Entry:
    path: str
    name: str
    size: int
    modified_us: int | None
    is_directory: bool
    permissions: str | None


class LocalFiles:
    """Folders that the operating system can open."""

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(os.fsencode(folder)) as found:
            for item in found:
                try:
                    info = item.stat(follow_symlinks=False)
                except FileNotFoundError:
                    continue
                name = os.fsdecode(item.name)
                directory = stat.S_ISDIR(info.st_mode)
                size = 0 if directory else info.st_size
                yield Entry(
                    f"{folder.rstrip('/')}/{name}", name, size, info.st_mtime_ns // 1000, directory, stat.filemode(info.st_mode)[1:]
                )


class ArrowFiles:
    """Folders of other stores."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.store, _ = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow import fs

        for info in self.store.get_file_info(fs.FileSelector(folder)):
            directory = info.type == fs.FileType.Directory
            when = None if info.mtime_ns is None else info.mtime_ns // 1000
            yield Entry(info.path, info.base_name, 0 if directory else info.size, when, directory, None)


def _opened(root: str) -> tuple[LocalFiles | ArrowFiles, str]:
    """The store that `root` names, and the folder in it."""
    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        folder = unquote(parts.path) if parts.scheme else root
        return LocalFiles(), os.path.abspath(folder)
    from pyarrow import fs

    return ArrowFiles(root), fs.FileSystem.from_uri(root)[1]


@dataclass
class Piece(InputPartition):
    """The entries of `folder` whose names fall in slice `part` of `parts`; with what is below them if `deep`."""

    folder: str
    deep: bool
    part: int = 0
    parts: int = 1


@dataclass
class Wanted:
    """What the filters leave: bounds are inclusive."""

    prefixes: tuple[str, ...] = ()
    path: str | None = None
    parent: str | None = None
    directory: bool | None = None
    least: int | None = None
    most: int | None = None

    def row(self, e: Entry, parent: str) -> bool:
        return (
            all(e.path.startswith(p) for p in self.prefixes)
            and (self.path is None or e.path == self.path)
            and (self.parent is None or parent == self.parent)
            and (self.directory is None or e.is_directory == self.directory)
            and (self.least is None or e.size >= self.least)
            and (self.most is None or e.size <= self.most)
        )

    def below(self, folder: str) -> bool:
        """Whether a match may lie below the folder."""
        inside = folder.rstrip("/") + "/"
        starts = [*self.prefixes, *[p for p in (self.path,) if p is not None]]
        if not all(inside.startswith(p) or p.startswith(inside) for p in starts):
            return False
        return self.parent is None or self.parent == folder or self.parent.startswith(inside)

    def take(self, f: Filter) -> bool:
        """Takes a filter over, if it can be decided here in full."""
        if isinstance(f, Not):
            if isinstance(f.child, EqualTo) and f.child.attribute == ("is_directory",) and isinstance(f.child.value, bool):
                return self.take(EqualTo(("is_directory",), not f.child.value))
            return False
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return column in (("path",), ("parent_path",), ("name",), ("size",), ("is_directory",))
        if value is None:
            return False
        if isinstance(f, StringStartsWith) and column == ("path",):
            self.prefixes += (value,)
            return True
        if isinstance(f, EqualTo) and column in (("path",), ("parent_path",), ("is_directory",)):
            field = {"path": "path", "parent_path": "parent", "is_directory": "directory"}[column[0]]
            if getattr(self, field) not in (None, value):
                return False
            setattr(self, field, value)
            return True
        if column == ("size",):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                least = value + isinstance(f, GreaterThan)
                self.least = least if self.least is None else max(self.least, least)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                most = value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))
        return False


class TreeReader(DataSourceReader):
    def __init__(self, root: str, pieces: int, wanted: Wanted | None = None):
        self.root, self.pieces, self.wanted = root, pieces, wanted or Wanted()

    def partitions(self) -> Sequence[Piece]:
        """Folders are opened widest first until there are enough of them."""
        store, top = _opened(self.root)
        done, queue = [], deque([top])
        while queue and len(done) + len(queue) < self.pieces:
            folder, folders, count = queue.popleft(), [], 0
            if not self.wanted.below(folder):
                continue
            for e in store.entries(folder):
                count += 1
                if count > WIDE:
                    break
                if e.is_directory and self.wanted.below(e.path):
                    folders.append(e.path)
            if count > WIDE:
                done += [Piece(folder, True, i, self.pieces) for i in range(self.pieces)]
            else:
                done.append(Piece(folder, False))
                queue.extend(folders)
        return (done + [Piece(f, True) for f in queue]) or [Piece(top, False, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.root)
        rows: list[tuple] = []
        if partition.parts:
            for entry, parent in self._walk(store, partition):
                if self.wanted.row(entry, parent):
                    path, parent, name = (x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in (entry.path, parent, entry.name))
                    rows.append((path, parent, name, entry.size, entry.modified_us, entry.is_directory, entry.permissions))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _walk(self, store: LocalFiles | ArrowFiles, piece: Piece) -> Iterator[tuple[Entry, str]]:
        open_ = [piece.folder]
        while open_:
            folder = open_.pop()
            try:
                for e in store.entries(folder):
                    if folder == piece.folder and zlib.crc32(os.fsencode(e.name)) % piece.parts != piece.part:
                        continue
                    yield e, folder
                    if e.is_directory and piece.deep and self.wanted.below(e.path):
                        open_.append(e.path)
            except FileNotFoundError:
                if folder == piece.folder and folder == _opened(self.root)[1]:
                    raise


class PushedTreeReader(TreeReader):
    """Also takes filters over from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "backup_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        root = self.options.get("path")
        if not root:
            raise ValueError("backup_tree needs the path of a folder")
        bound = lambda name: int(self.options[name]) if self.options.get(name) else None
        prefix, kind = self.options.get("prefix"), self.options.get("kind")
        if kind not in (None, "", "file", "directory"):
            raise ValueError(f"unknown kind: {kind}")
        wanted = Wanted((prefix,) if prefix else (), None, None, kind == "directory" if kind else None, bound("least"), bound("most"))
        pushed = self.options.get("pushdown", "").lower() == "true"
        return (PushedTreeReader if pushed else TreeReader)(root, bound("pieces") or PIECES, wanted)


def directory_tree(
    spark: SparkSession,
    root: str,
    prefix: str | None = None,
    least: int | None = None,
    most: int | None = None,
    kind: str | None = None,
    pieces: int = PIECES,
) -> DataFrame:
    """All files and folders below `root` with size, time of change and permissions.

    Narrowed by the start of the path, by bounds of the size (inclusive) and to kind `file` or `directory`.
    """
    spark.dataSource.register(TreeSource)
    given = {"prefix": prefix, "least": least, "most": most, "kind": kind, "pieces": pieces}
    return spark.read.format(TreeSource.name()).options(**{k: v for k, v in given.items() if v is not None}).load(root)
