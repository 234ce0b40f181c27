"""A data source over a directory tree: one row for each file and symlink.

    file_tree(spark, root, symlinks="true").filter("relative_path like 'src/%' and size > 4096")

Folders are opened from the root down until there are ``splits`` of them (64 by
default) or no deeper ones; each is one input partition with all below it, and the
opened ones together are one more. A root that is missing or no folder gives no rows. Content is not read; join with ``binaryFile`` for it.

Filters on single columns are pushed into the scan: folders that a filter on the path rules out are never opened, entries that
the path or the kind rules out are never asked for their attributes, and the rest is dropped before it leaves the worker.
``spark.read.format("filetree")`` reads the same rows without pushing, unless the option ``pushdown`` is true and
``spark.sql.python.filterPushdown.enabled`` is set. The root is a path that every executor sees under the same name.
"""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

SCHEMA = "relative_path string, kind string, target string, size long, mode long, mtime_sec long, uid long, gid long, xattrs array<struct<name:string,value:binary>>"
COLUMNS = ("relative_path", "kind", "target", "size", "mode", "mtime_sec", "uid", "gid", "xattrs")
TYPES = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.struct([("name", pa.string()), ("value", pa.binary())])))
BATCH = 4096
#: What a pushed filter asks of a value that is not null.
ASKS = {
    EqualTo: lambda x, f: x == f.value,
    GreaterThan: lambda x, f: x > f.value,
    GreaterThanOrEqual: lambda x, f: x >= f.value,
    LessThan: lambda x, f: x < f.value,
    LessThanOrEqual: lambda x, f: x <= f.value,
    In: lambda x, f: x in f.value,
    StringStartsWith: lambda x, f: x.startswith(f.value),
    StringEndsWith: lambda x, f: x.endswith(f.value),
    StringContains: lambda x, f: f.value in x,
}


def file_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The tree under ``root`` with filters pushed into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(root=root, pushdown="true", **options).load()


def column_of(f: Filter) -> str | None:
    """The column of a filter that the scan can answer, or None."""
    inner = f.child if isinstance(f, Not) else f
    known = type(inner) in ASKS or inner is f and isinstance(f, (IsNull, IsNotNull))
    path = getattr(inner, "attribute", ())
    return path[0] if known and len(path) == 1 and path[0] in COLUMNS[:-1] else None


def holds(f: Filter, x) -> bool:
    """Whether a row with this value stays; a comparison with null is never true, nor is its opposite."""
    if isinstance(f, IsNull):
        return x is None
    if x is None or isinstance(f, IsNotNull):
        return x is not None
    return not ASKS[type(f.child)](x, f.child) if isinstance(f, Not) else ASKS[type(f)](x, f)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PushingReader(self.options) if self.options.get("pushdown", "false") == "true" else TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.symlinks = options.get("symlinks", "true") == "true"
        self.xattrs = options.get("xattrs", "false") == "true"
        self.splits = int(options.get("splits", "64"))
        self.filters: dict[str, list[Filter]] = {}

    def _stays(self, **values) -> bool:
        return all(holds(f, x) for column, x in values.items() for f in self.filters.get(column, ()))

    def _may_hold(self, folder: str) -> bool:
        """Whether a path below this folder can pass the filters on the path."""
        starts = [f.value for f in self.filters.get("relative_path", ()) if isinstance(f, (EqualTo, StringStartsWith))]
        return all(f"{folder}/".startswith(s) or s.startswith(f"{folder}/") for s in starts)

    def partitions(self):
        if not os.path.isdir(self.root):
            return [InputPartition(None)]
        opened, closed = [], [""]
        while closed and len(closed) < self.splits:
            below = [f"{folder}/{e.name}".lstrip("/") for folder in closed for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False)]
            opened += closed
            closed = [folder for folder in below if self._may_hold(folder)]
        return [InputPartition((False, sorted(opened))), *(InputPartition((True, [folder])) for folder in sorted(closed))]

    def read(self, partition):
        held = []
        for row in self._rows(partition) if partition.value is not None else ():
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _rows(self, partition):
        deep, stack = partition.value
        while stack:
            folder = stack.pop()
            for e in os.scandir(os.path.join(self.root, folder)):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if deep and self._may_hold(path):
                        stack.append(path)
                elif e.is_file(follow_symlinks=False) or self.symlinks and e.is_symlink():
                    if self._stays(relative_path=path, kind="Symlink" if e.is_symlink() else "File"):
                        row = self._row(path, e)
                        if self._stays(**dict(zip(COLUMNS[2:-1], row[2:-1]))):
                            yield row

    def _row(self, path, e):
        s = e.stat(follow_symlinks=False)
        link = stat.S_ISLNK(s.st_mode)
        found = []
        if self.xattrs:
            try:
                found = [(n, os.getxattr(e.path, n, follow_symlinks=False)) for n in sorted(os.listxattr(e.path, follow_symlinks=False))]
            except OSError:  # the file system has none
                found = []
        return path, "Symlink" if link else "File", os.readlink(e.path) if link else None, s.st_size, s.st_mode, int(s.st_mtime // 1), s.st_uid, s.st_gid, found


class PushingReader(TreeReader):
    def pushFilters(self, filters):
        for f in filters:
            column = column_of(f)
            if column is None:
                yield f
            else:
                self.filters.setdefault(column, []).append(f)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[-1] = [[{"name": n, "value": v} for n, v in found] for found in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], list(COLUMNS))
