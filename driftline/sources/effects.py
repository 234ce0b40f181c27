"""Effects on a folder that driver and executors share, as rows of answers.

Each function takes paths below ``root`` (checked: no path leaves it) and gives
(relative_path, accepted, message, bytes_written). An answer that says no changes
nothing. A repeated task writes the same again, so lost executors do no harm.
A task acts on the paths of its partition, in their order; ``spread`` deals paths
evenly, where a table comes in few pieces.
"""

from __future__ import annotations

import os
import shutil
import stat
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import sanitized

ANSWERS = "relative_path string, accepted boolean, message string, bytes_written long"
COPY_BYTES = 1 << 20
#: Files that are open at most until they are on the disk: a flush of one file commits the file system's journal, and one commit does for all.
SYNC_FILES = 256
#: Folders of a batch that are remembered as looked at.
FOLDERS = 4096


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by relative_path, four tasks for each core: an effect costs by the path, however few pieces the table comes in."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "relative_path")


def _run(df: DataFrame, root: str, act: Callable[[str, dict], tuple], files_only: bool = False) -> DataFrame:
    """Answers of ``act``: (accepted, message, bytes_written) and, where a file must be on the disk before its answer, that file, still open.

    With ``files_only`` the act neither makes nor removes links or folders that are there, so a folder is looked at once a batch."""
    names = ["relative_path", "accepted", "message", "bytes_written"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, opened = [], {}
            top, inside = os.path.realpath(root), lru_cache(FOLDERS)(_inside) if files_only else _inside
            try:
                for row in batch.to_pylist():
                    path = None if row["_safe"] is None else os.path.join(root, row["_safe"])
                    if path is None or not inside(os.path.dirname(path), top):
                        answer = (False, "unsafe path", 0)
                    else:
                        try:
                            answer = act(path, row)
                        except OSError as e:
                            answer = (False, f"{type(e).__name__}", 0)
                    if len(answer) > 3:
                        opened[len(out)] = answer[3]
                    out.append((row["relative_path"], *answer[:3]))
                    if len(opened) == SYNC_FILES:
                        _flush(opened, out)
                _flush(opened, out)
            finally:
                for file in opened.values():
                    file.close()
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return df.withColumn("_safe", sanitized(F.col("relative_path"))).mapInArrow(task, ANSWERS)


def _flush(opened: dict[int, BinaryIO], out: list[tuple]) -> None:
    """Put files on the disk and close them; the answer of one that fails says no."""
    for file in opened.values():  # all are on their way before the first is waited for
        os.posix_fadvise(file.fileno(), 0, 0, os.POSIX_FADV_DONTNEED)
    while opened:
        k, file = opened.popitem()
        with file:
            try:
                os.fsync(file.fileno())
            except OSError as e:
                out[k] = (out[k][0], False, f"{type(e).__name__}", 0)


def _inside(folder: str, top: str) -> bool:
    """Whether a path's folder stays below the root's real path even where folders on the way are links."""
    return os.path.commonpath([top, os.path.realpath(folder)]) == top


def _created(path: str) -> BinaryIO:
    """A file to be written from the start, in a folder that is made if it is not there."""
    try:
        return open(path, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Whole files (relative_path, content), written from the start over what is there."""

    def act(path, row):
        with _created(path) as f:
            f.write(row["content"] or b"")
        return True, "written", len(row["content"] or b"")

    return _run(df, root, act, files_only=True)


def finalize_partials(df: DataFrame, root: str, suffix: str = ".part") -> DataFrame:
    """Partial files (relative_path, size) moved to their names, if they have the size; else they stay."""

    def act(path, row):
        part = path + suffix
        if not os.path.exists(part):
            return False, "no partial file", 0
        got = os.path.getsize(part)
        if got != row["size"]:
            return False, f"size mismatch: expected {row['size']} got {got}", 0
        os.replace(part, path)
        return True, "file finalized", got

    return _run(df, root, act)


def copy_files(df: DataFrame, source: str, root: str) -> DataFrame:
    """Files (relative_path) copied from below ``source``, in pieces, to the disk before the answer."""

    def act(path, row):
        n = 0
        with open(os.path.join(source, row["_safe"]), "rb", buffering=0) as a:
            b = _created(path)
            try:
                while piece := a.read(COPY_BYTES):
                    b.write(piece)
                    n += len(piece)
                b.flush()
            except BaseException:
                b.close()
                raise
        return True, "copied", n, b

    return _run(df, root, act, files_only=True)


def make_links(df: DataFrame, root: str) -> DataFrame:
    """Symlinks (relative_path, target): an equal one is left, a file, folder or other link in the way is removed."""

    def act(path, row):
        if os.path.islink(path) and os.readlink(path) == row["target"]:
            return True, "already there", 0
        there = os.path.lexists(path)
        if there and os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path)
        elif there:
            os.remove(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        os.symlink(row["target"], path)
        return True, "replaced" if there else "created", 0

    return _run(df, root, act)


def apply_metadata(df: DataFrame, root: str) -> DataFrame:
    """Permissions (mode), attributes (xattrs, where the file system has them), owner (uid and gid, if allowed) and at last the time (mtime_sec) of files."""

    def act(path, row):
        if not stat.S_ISREG(os.lstat(path).st_mode):
            return False, "not a regular file", 0
        os.chmod(path, row["mode"] & 0o7777)
        try:
            have, wanted = set(os.listxattr(path)), {x["name"]: x["value"] for x in row.get("xattrs") or []}
            for name in have - set(wanted):
                os.removexattr(path, name)
            for name, value in wanted.items():
                os.setxattr(path, name, value)
        except OSError:  # none here
            pass
        if row.get("uid") is not None:
            try:
                os.chown(path, row["uid"], row["gid"])
            except PermissionError:
                pass
        os.utime(path, (row["mtime_sec"], row["mtime_sec"]))
        return True, "metadata updated", 0

    return _run(df, root, act)


def delete_paths(df: DataFrame, root: str) -> DataFrame:
    """Files and links (relative_path) removed; what is gone already is no error."""

    def act(path, row):
        if not os.path.lexists(path):
            return True, "already gone", 0
        os.remove(path)
        return True, "deleted", 0

    return _run(df, root, act)


def stat_paths(df: DataFrame, root: str, kind: str = "File") -> DataFrame:
    """(relative_path, kind, target, size, mode, mtime_sec) of listed paths that must be of ``kind`` (File, Symlink or any): another kind, or none, fails the query."""
    schema = "relative_path string, kind string, target string, size long, mode long, mtime_sec long"

    def task(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                path = os.path.join(root, name)
                s = os.lstat(path)
                what = "Symlink" if stat.S_ISLNK(s.st_mode) else "File" if stat.S_ISREG(s.st_mode) else "other"
                if what == "other" or kind not in ("any", what):
                    raise ValueError(f"{name} is no {kind}")
                out.append((name, what, os.readlink(path) if what == "Symlink" else None, s.st_size, s.st_mode, int(s.st_mtime // 1)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["relative_path", "kind", "target", "size", "mode", "mtime_sec"])

    return df.select("relative_path").mapInArrow(task, schema)
