"""Replay of framed source streams and upload progress as keyed state.

The state machines are written once, over plain rows, and run in two ways. At rest,
rows are dealt by key and sorted by (key, seq), and a task carries one machine along
its Arrow batches: no key's rows are gathered, so a hot key streams through. On a
stream, ``applyInPandasWithState`` keeps the machine as state, and rows that come
early wait in it for those before them.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.frames import CODEC, LITTLE, MAGIC, PREFIX, PROTOCOL

#: seq long, frame_type string (start, chunk, end, done), relative_path string, kind string, size long, chunk_len long, files long
FILES = "stream_id string, seq long, relative_path string, kind string, bytes long, error string"
PROGRESS = "key string, seq long, accepted boolean, message string, next_chunk long, written long"


class Replay:
    """One stream: Start opens a file, Chunks fill it, End closes it, Done ends the stream with a count."""

    def __init__(self, state: dict | None = None):
        self.s = state or {"next": 0, "open": None, "files": 0, "ended": False, "failed": False, "early": {}}

    def step(self, row: dict) -> dict | None:
        """The outcome of a frame: a finished file, an error, or nothing yet."""
        s, kind, path = self.s, row["frame_type"], row["relative_path"]
        if s["failed"]:
            return None

        def fail(why: str) -> dict:
            s["failed"] = True
            return {"relative_path": path, "kind": None, "bytes": None, "error": why}

        if s["ended"]:
            return fail("frame after done")
        if kind == "start":
            if s["open"]:
                return fail("start within a file")
            s["open"] = {"path": path, "kind": row["kind"], "size": row["size"], "got": 0}
        elif kind == "chunk":
            if not s["open"]:
                return fail("chunk outside a file")
            if s["open"]["kind"] == "Symlink":
                return fail("chunk for a symlink")
            s["open"]["got"] += row["chunk_len"]
            if s["open"]["got"] > s["open"]["size"]:
                return fail("more bytes than announced")
        elif kind == "end":
            done, s["open"] = s["open"], None
            if not done or done["path"] != path:
                return fail("end of another file")
            if done["kind"] != "Symlink" and done["got"] != done["size"]:
                return fail("size differs")
            s["files"] += 1
            return {"relative_path": path, "kind": done["kind"], "bytes": done["got"], "error": None}
        elif kind == "done":
            if s["open"]:
                return fail("done within a file")
            s["ended"] = True
            if row["files"] != s["files"]:
                return fail("file count differs")
        else:
            return fail("unknown frame")
        return None

    def feed(self, rows: list[dict]) -> list[dict]:
        """Outcomes of these frames and of early ones whose turn has come; repeated frames are ignored."""
        out = []
        for row in rows:
            if row["seq"] >= self.s["next"]:
                self.s["early"].setdefault(str(row["seq"]), row)
        while str(self.s["next"]) in self.s["early"]:
            row = self.s["early"].pop(str(self.s["next"]))
            self.s["next"] += 1
            if found := self.step(row):
                out.append(found | {"seq": row["seq"]})
        return out


    def at_rest(self, row: dict) -> list[dict]:
        """The outcome of the next frame in order of seq; repeated ones, and all behind a gap, are ignored."""
        if row["seq"] != self.s["next"]:
            return []
        self.s["next"] += 1
        found = self.step(row)
        return [found | {"seq": row["seq"]}] if found else []


class Progress:
    """Uploads of one path, in order of arrival: late ones are acknowledged, early ones rejected, the due one applied."""

    def __init__(self, state: dict | None = None):
        self.s = state or {"next": None, "total": 0, "done": False}

    def step(self, row: dict) -> dict:
        s, kind = self.s, row["event"]
        said = lambda ok, why, n=0: {"accepted": ok, "message": why, "next_chunk": s["next"] or 0, "written": n}
        if kind == "init":
            s.update({"next": min(row["start_chunk"], row["total_chunks"]), "total": row["total_chunks"], "done": False})
            return said(True, "ready")
        if s["next"] is None:
            return said(False, "no init")
        if row["start_chunk"] < s["next"]:
            return said(True, "already applied")
        if row["start_chunk"] > s["next"]:
            return said(False, f"expected chunk {s['next']}")
        s["next"] = max(s["next"], min(s["total"], s["next"] + row["sent_chunks"]))
        if row["finalize"]:
            if s["next"] != s["total"]:
                return said(False, "incomplete", row["bytes"])
            s["done"] = True
            return said(True, "completed", row["bytes"])
        return said(True, "applied", row["bytes"])


class DeleteSession:
    """Begin resets, AddKeep gathers, Apply uses the keep set once; anything out of turn is refused."""

    def __init__(self, state: dict | None = None):
        self.s = state or {"open": False}
        self.keep = set(self.s.get("keep", ()))

    def step(self, row: dict) -> dict:
        s, stage = self.s, row["stage"]
        if stage == "begin":
            s["open"] = True
            self.keep.clear()
            return {"accepted": True, "message": "ready", "keep_paths": 0}
        if not s["open"]:
            return {"accepted": False, "message": "no session", "keep_paths": 0}
        if stage == "add":
            self.keep.update(row["paths"])
            return {"accepted": True, "message": "added", "keep_paths": len(self.keep)}
        n, s["open"] = len(self.keep), False
        return {"accepted": True, "message": "applied", "keep_paths": n}


SESSIONS = "session string, seq long, accepted boolean, message string, keep_paths long"


def _value(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, np.generic):
        v = v.item()
    return None if v is pd.NA or isinstance(v, float) and v != v else v


def _plain(frame: pd.DataFrame) -> list[dict]:
    return [{k: _value(v) for k, v in r.items()} for r in frame.to_dict("records")]


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names).astype(object)


def by_key(rows: DataFrame, key: str, machine: Callable[[], Callable[[dict], list[dict]]], schema: str) -> DataFrame:
    """What a machine, new for each key, says to the key's rows in order of seq."""
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def task(batches):
        now, step = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if step is None or row[key] != now:
                    now, step = row[key], machine()
                for answer in step(row):
                    answer[key] = now
                    out.append(answer)
            if out:
                yield pa.RecordBatch.from_pylist(out, made)

    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(task, schema)


def replay(frames: DataFrame) -> DataFrame:
    """Finished files and the first error of each stream, from frames at rest."""
    used = ("stream_id", "seq", "frame_type", "relative_path", "kind", "size", "chunk_len", "files")
    return by_key(frames.select(*used), "stream_id", lambda: Replay().at_rest, FILES)


def _ordered(frames: DataFrame, key: str, machine, schema: str) -> DataFrame:
    def new():
        own = machine()
        return lambda row: [own.step(row) | {"seq": row["seq"]}]

    return by_key(frames, key, new, schema)


def progress(events: DataFrame) -> DataFrame:
    """Answers to upload events (key, seq, event, start_chunk, sent_chunks, total_chunks, finalize, bytes) at rest; seq is the order of arrival."""
    return _ordered(events, "key", Progress, PROGRESS)


def delete_sessions(events: DataFrame) -> DataFrame:
    """Answers to delete sessions (session, seq, stage, paths) at rest, for keep sets of any size: a path counts at the first
    event of its session that adds it, and running sums over those events give the sizes."""
    named = events.select("session", "seq", "stage", "paths")
    order = Window.partitionBy("session").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.col("stage").isin("begin", "apply"), F.col("stage"))
    known = named.withColumns({
        "i": F.row_number().over(order), "in_session": F.coalesce(F.last(edge, ignorenulls=True).over(before) == "begin", F.lit(False)),
        "run": F.count_if(F.col("stage") == "begin").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    adds = known.filter("in_session AND stage = 'add'").select("session", "run", "i", F.explode("paths").alias("path"))
    firsts = adds.groupBy("session", "run", "path").agg(F.min("i").alias("i")).groupBy("session", "i").agg(F.count("*").alias("news"))
    sums = Window.partitionBy("session", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sized = known.drop("paths").join(firsts, ["session", "i"], "left").withColumn("kept", F.coalesce(F.sum("news").over(sums), F.lit(0)))
    begins, ok = F.col("stage") == "begin", F.col("in_session") | (F.col("stage") == "begin")
    message = F.when(begins, "ready").when(~ok, "no session").when(F.col("stage") == "add", "added").otherwise("applied")
    return sized.select("session", "seq", ok.alias("accepted"), message.alias("message"), F.when(ok & ~begins, F.col("kept")).otherwise(0).cast("long").alias("keep_paths"))


def idle_connections(events: DataFrame, idle: int) -> DataFrame:
    """Connections of clients (connection, seq, ts in microseconds): one ends ``idle`` after its last event, and a later event opens the next.

    (connection, run, events, closed_at)."""
    order = Window.partitionBy("connection").orderBy("ts", "seq")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(order) > idle, F.lit(False))
    runs = events.withColumn("_new", gap.cast("long")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("connection", "run").agg(F.count("*").alias("events"), (F.max("ts") + idle).alias("closed_at"))


def stop_when_idle(query, seconds: float, poll: float = 0.2) -> None:
    """Stop a streaming query once no rows have come for so long, as a server for one client does."""
    last, seen = time.monotonic(), None
    while query.isActive:
        now = query.lastProgress
        if now and now["numInputRows"] and now["batchId"] != seen:
            last, seen = time.monotonic(), now["batchId"]
        if time.monotonic() - last > seconds and not query.status["isTriggerActive"]:
            query.stop()
            return
        time.sleep(poll)


def replay_stream(frames: DataFrame) -> DataFrame:
    """``replay`` on a streaming DataFrame: frames of a stream may come in any order and more than once."""

    def group(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Replay(json.loads(state.get[0]) if state.exists else None)
        out = [r | {"stream_id": key[0]} for part in parts for r in own.feed(_plain(part))]
        state.update((json.dumps(own.s),))
        yield _frame(out, FILES)

    return frames.groupBy("stream_id").applyInPandasWithState(group, FILES, "state string", "append", GroupStateTimeout.NoTimeout)


def progress_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``progress`` on a streaming DataFrame, by arrival; with ``idle_ms`` a path's state is dropped after that time without events."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def group(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if idle_ms and state.hasTimedOut:
            state.remove()
            return
        own = Progress(json.loads(state.get[0]) if state.exists else None)
        out = [own.step(r) | {"key": key[0], "seq": r["seq"]} for part in parts for r in _plain(part.sort_values("seq"))]
        state.update((json.dumps(own.s),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield _frame(out, PROGRESS)

    return events.groupBy("key").applyInPandasWithState(group, PROGRESS, "state string", "append", timeout)


class FrameBuffer:
    """Cuts a byte stream into frames: whatever the reads, frames come whole.

    A prefix of another magic, protocol, codec or endianness is an error before its lengths are
    believed, and so are a frame over the limit and a stream that ends within one."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, b""

    def _size(self) -> int:
        magic, protocol, codec, endianness, head, body = struct.unpack_from(">4sHBBII", self.held)
        for name, got, want in (("magic", magic, MAGIC), ("protocol", protocol, PROTOCOL), ("codec", codec, CODEC), ("endianness", endianness, LITTLE)):
            if got != want:
                raise ValueError(f"{name} mismatch: {got!r}")
        size = PREFIX + head + body
        if size > self.limit:
            raise ValueError(f"frame of {size} bytes is over the limit of {self.limit}")
        return size

    def feed(self, data: bytes) -> list[bytes]:
        self.held += data
        out = []
        while len(self.held) >= PREFIX and len(self.held) >= (size := self._size()):
            out.append(self.held[:size])
            self.held = self.held[size:]
        return out

    def close(self) -> None:
        if self.held:
            raise ValueError("stream ends within a frame")


FRAMES = "stream_id string, frame_no long, frame binary, error string"


def _cut(buffer: FrameBuffer, first: int, reads: Iterator[bytes], last: bool) -> tuple[list[dict], bool]:
    """Frames of these reads, numbered from ``first``, and whether the stream has failed."""
    out: list[dict] = []
    try:
        for data in reads:
            out += [{"frame_no": first + len(out) + k, "frame": f, "error": None} for k, f in enumerate(buffer.feed(data))]
        if last:
            buffer.close()
    except ValueError as e:
        return [*out, {"frame_no": first + len(out), "frame": None, "error": str(e)}], True
    return out, False


def framed(reads: DataFrame, limit: int) -> DataFrame:
    """Frames of byte streams at rest (stream_id, seq, data), in order of seq; the first error of a stream ends it."""

    def group(key, frame):
        return _frame([r | {"stream_id": key[0]} for r in _cut(FrameBuffer(limit), 0, map(bytes, frame.sort_values("seq")["data"]), True)[0]], FRAMES)

    return reads.groupBy("stream_id").applyInPandas(group, FRAMES)


def framed_stream(reads: DataFrame, limit: int) -> DataFrame:
    """``framed`` on a streaming DataFrame whose reads of a stream arrive in order; what is cut off waits in state."""

    def group(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, number, failed = state.get if state.exists else (b"", 0, False)
        buffer = FrameBuffer(limit)
        buffer.held = bytes(held)
        out: list[dict] = []
        for part in parts:
            if not failed:
                more, failed = _cut(buffer, number + len(out), map(bytes, part.sort_values("seq")["data"]), False)
                out += more
        state.update((buffer.held, number + len(out), failed))
        yield _frame([r | {"stream_id": key[0]} for r in out], FRAMES)

    return reads.groupBy("stream_id").applyInPandasWithState(group, FRAMES, "held binary, number long, failed boolean", "append", GroupStateTimeout.NoTimeout)
