"""Streams with typed keyed state: replay, upload progress and delete sessions on transformWithState.

State lives in RocksDB, value by value: of a keep set or of frames that came early only
the entries that a row needs are read, so a key's state may be larger than a worker's
memory. Idle paths end by timers. The answers are those of the same rows at rest
(``streaming.frames``), whatever the batches, and go on after a restart from the
checkpoint. Rows of a batch are taken in order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .frames import FILES, PROGRESS, SESSIONS, Progress, Replay, _frame, _plain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Queries of this session that start from now on keep their state in RocksDB, which writes changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def _whole(part: pd.DataFrame) -> list[dict]:
    """Rows as dicts; pandas holds whole numbers beside nulls as floats, and no column here has others."""
    return [{k: int(v) if isinstance(v, float) else v for k, v in row.items()} for row in _plain(part)]


class _Keyed(StatefulProcessor):
    """Rows of a key in order of ``seq``; ``one`` gives the answers to a row."""

    schema, key = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.begin()
        for part in rows:
            out = [answer | {self.key: key[0]} for row in _whole(part.sort_values("seq", kind="stable")) for answer in self.one(row)]
            if out:
                yield _frame(out, self.schema)
        self.end()

    def begin(self) -> None:
        pass

    def end(self) -> None:
        pass

    def close(self) -> None:
        pass


class SessionState(_Keyed):
    """Delete sessions: whether one is open and how many paths it keeps; the paths are a map."""

    schema, key = SESSIONS, "session"

    def open(self) -> None:
        self.flag = self.handle.getValueState("session", "open boolean, kept long")
        self.paths = self.handle.getMapState("paths", "path string", "kept boolean")

    def begin(self) -> None:
        self.is_open, self.kept = self.flag.get() if self.flag.exists() else (False, 0)

    def end(self) -> None:
        self.flag.update((self.is_open, self.kept))

    def one(self, row: dict) -> list[dict]:
        said = lambda ok, why, n: [{"seq": row["seq"], "accepted": ok, "message": why, "keep_paths": n}]
        if row["stage"] == "begin":
            if self.kept:
                self.paths.clear()
            self.is_open, self.kept = True, 0
            return said(True, "ready", 0)
        if not self.is_open:
            return said(False, "no session", 0)
        if row["stage"] == "add":
            for path in dict.fromkeys(row["paths"]):
                if not self.paths.containsKey((path,)):
                    self.paths.updateValue((path,), (True,))
                    self.kept += 1
            return said(True, "added", self.kept)
        self.is_open = False
        return said(True, "applied", self.kept)


class ReplayState(_Keyed):
    """Frames of a stream in any order: the machine is a value, frames that came early are a map by their number."""

    schema, key = FILES, "stream_id"
    FRAME = "frame_type string, relative_path string, kind string, size long, chunk_len long, files long"
    NAMES = [f.strip().split(" ")[0] for f in FRAME.split(",")]

    def open(self) -> None:
        self.machine = self.handle.getValueState("machine", "next long, path string, kind string, size long, got long, opened boolean, files long, ended boolean, failed boolean")
        self.early = self.handle.getMapState("early", "seq long", self.FRAME)

    def begin(self) -> None:
        self.replay = Replay()
        if self.machine.exists():
            n, path, kind, size, got, opened, files, ended, failed = self.machine.get()
            self.replay.s.update({"next": n, "open": {"path": path, "kind": kind, "size": size, "got": got} if opened else None, "files": files, "ended": ended, "failed": failed})

    def end(self) -> None:
        s = self.replay.s
        o = s["open"] or {"path": None, "kind": None, "size": None, "got": None}
        self.machine.update((s["next"], o["path"], o["kind"], o["size"], o["got"], s["open"] is not None, s["files"], s["ended"], s["failed"]))

    def one(self, row: dict) -> list[dict]:
        s, out = self.replay.s, []
        if row["seq"] > s["next"]:
            if not self.early.containsKey((row["seq"],)):
                self.early.updateValue((row["seq"],), tuple(row[c] for c in self.NAMES))
            return []
        while row is not None and row["seq"] == s["next"]:
            s["next"] += 1
            if found := self.replay.step(row):
                out.append(found | {"seq": row["seq"]})
            due, row = (s["next"],), None
            if self.early.containsKey(due):
                row = dict(zip(self.NAMES, self.early.getValue(due))) | {"seq": due[0]}
                self.early.removeKey(due)
        return out


class ProgressState(_Keyed):
    """Uploads of a path; after ``idle_ms`` without an event its state ends by a timer."""

    schema, key = PROGRESS, "key"

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def open(self) -> None:
        self.at = self.handle.getValueState("progress", "next long, total long, done boolean")

    def begin(self) -> None:
        self.own = Progress(dict(zip(("next", "total", "done"), self.at.get())) if self.at.exists() else None)

    def end(self) -> None:
        self.at.update((self.own.s["next"], self.own.s["total"], self.own.s["done"]))

    def one(self, row: dict) -> list[dict]:
        return [self.own.step(row) | {"seq": row["seq"]}]

    def handleInputRows(self, key, rows, timers):  # noqa: N802, N803
        yield from super().handleInputRows(key, rows, timers)
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.at.clear()
        yield _frame([], PROGRESS)


def _stateful(rows: DataFrame, processor: _Keyed, timed: bool = False) -> DataFrame:
    with_rocksdb(rows.sparkSession)
    mode = "processingTime" if timed else "none"
    return rows.groupBy(processor.key).transformWithStateInPandas(processor, outputStructType=processor.schema, outputMode="Append", timeMode=mode)


def keyed_sessions(events: DataFrame) -> DataFrame:
    """Answers to delete sessions (session, seq, stage, paths) on a stream."""
    return _stateful(events.select("session", "seq", "stage", "paths"), SessionState())


def keyed_replay(frames: DataFrame) -> DataFrame:
    """Finished files and the first error of each stream, from frames in any order, repeated ones too."""
    return _stateful(frames.select("stream_id", "seq", *ReplayState.NAMES), ReplayState())


def keyed_progress(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Answers to upload events in order of arrival; with ``idle_ms`` a path's state ends after that time without events."""
    used = ("key", "seq", "event", "start_chunk", "sent_chunks", "total_chunks", "finalize", "bytes")
    return _stateful(events.select(*used), ProgressState(idle_ms), timed=idle_ms is not None)


def run_available(answers: DataFrame, path: str, checkpoint: str, timed: bool = False) -> None:
    """Append the answers to what has come so far to a folder, and end. A later call with the same checkpoint goes on from there.

    ``timed``: one batch, since a query with timers always has another one to run."""
    trigger = {"once": True} if timed else {"availableNow": True}
    query = answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).outputMode("append").start()
    query.awaitTermination()
