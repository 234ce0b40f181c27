"""Greedy batches of ordered rows, exact and without a single-task fold.

A batch takes rows in order until the next one would break a limit, so where a
batch ends depends only on where it starts. Rows are stored in ranges of order. A
first pass over the sizes alone gives each range's jump function: for every row at
which a batch from before may close, the batch that is then left open at the
range's end. A batch spans at most ``max_count`` rows or one limit's worth, so only
rows near the head matter. Jump functions of neighbours compose to one of the same
kind, so they are scanned as a tree, FAN at a time, up to one and down again; each
range then knows the batch that is open where it begins. A second pass streams the
ranges and cuts batches in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .ordering import ordered, runs


#: As a count of rows: no limit.
UNLIMITED = 1 << 62


@dataclass(frozen=True)
class Limit:
    """Close before adding: at ``max_count`` rows or when bytes would exceed ``max_bytes``; a larger row is a batch alone.

    ``close_after``: close once this many bytes are in, checked after adding."""

    max_bytes: int
    max_count: int = 4096
    close_after: int | None = None


def small_limit(payload: int) -> Limit:
    return Limit(min(max(payload - (512 << 10), 512 << 10), 32 << 20))


def init_limit(payload: int) -> Limit:
    return Limit(min(max(payload - (512 << 10), 256 << 10), 8 << 20))


def split_limit(total: int, connections: int, payload: int) -> Limit:
    """Batches small enough that every connection gets some."""
    return Limit(min(payload, max(-(-total // max(connections, 1)), 4 << 20)), UNLIMITED)


def keep_limit(payload: int) -> Limit:
    return Limit(max(payload - (128 << 10), 8 << 10), UNLIMITED)


def framed_limit(payload: int, overhead: int) -> Limit:
    """Entries whose encoded sizes, with the frame's own ``overhead``, fit one payload."""
    return Limit(payload - overhead, UNLIMITED)


def chunk_limit(payload: int, chunk: int) -> Limit:
    return Limit(1 << 62, max(1, (payload - (64 << 10)) // (chunk + 16)), 8 << 20)


def next_starts(sizes: np.ndarray, limit: Limit) -> np.ndarray:
    """For each row the row at which the batch that starts there ends."""
    n = len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    by_bytes = np.searchsorted(ends, ends[:-1] + limit.max_bytes, side="right") - 1
    out = np.minimum(by_bytes, np.arange(n) + min(limit.max_count, n + 1))
    if limit.close_after is not None:
        out = np.minimum(out, np.searchsorted(ends, ends[:-1] + limit.close_after, side="left"))
    return np.clip(np.maximum(out, np.arange(n) + 1), 0, n)


#: Ranges whose jump functions are composed in one task.
FAN = 64
RESULTS = ("batch_id", "pos", "offset")
#: A batch that is open: its rows and bytes so far, and the batches before it.
State = tuple[int, int, int]


def greedy_batches(df: DataFrame, order: list[str], size: Column, limit: Limit, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """``df`` + batch_id (from 0, in order), pos (in the batch, from 0) and offset (bytes before it in the batch).

    ``df`` may be any plan: it runs once, and ranges go by the bytes that it gives. ``order`` must identify rows; a null size
    counts as 0. With ``strict`` a row that is larger than ``max_bytes`` alone fails the query. Columns of ``df`` that have a
    result's name are replaced. To the driver come three numbers a range.
    """
    spark = df.sparkSession
    own = F.coalesce(size, F.lit(0)).cast("long")
    if strict:
        own = F.when(own > limit.max_bytes, F.raise_error(F.lit("a single row exceeds the limit")).cast("long")).otherwise(own)
    table = ordered(df, order, {"size": own}, partitions)
    jumps = stored(table.select("at", "s0").mapInArrow(_jumps(limit), JUMP), "jumps")
    found = _entries(jumps, limit).toArrow().sort_by("part")
    entries = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("part", "rows", "bytes", "closed")))
    fields = [(f"c{i}", f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in RESULTS]
    kept = [c for c, _ in fields]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in fields), *(T.StructField(c, T.LongType()) for c in RESULTS)])

    def task(batches):
        state: State = (0, 0, 0)
        for part, begins, rows in runs(batches):
            if begins:
                parts, *states = entries.value
                k = int(np.searchsorted(parts, part))
                state = tuple(int(s[k]) for s in states)
            made, state = cut(rows.column("s0").to_numpy(), state, limit)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *map(pa.array, made)], names=schema.names)

    return table.select(*kept, "s0", "at").mapInArrow(task, schema).toDF(*[f.name for _, f in fields], *RESULTS)


def cut(sizes: np.ndarray, state: State, limit: Limit) -> tuple[list[np.ndarray], State]:
    """batch_id, pos and offset of the next rows, and the batch that they leave open."""
    total, (rows, size, closed) = len(sizes), state
    at = np.flatnonzero(sizes)
    start = _closes(at, sizes[at], total, rows, size, limit) if rows else 0
    step, starts = next_starts(sizes, limit), []
    while start < total:
        starts.append(start)
        start = int(step[start])
    which = np.searchsorted(np.array(starts, np.int64), np.arange(total), side="right") - 1
    begin = np.where(which >= 0, np.array([*starts, 0])[which], 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    carried = which < 0
    pos = np.arange(total) - begin + np.where(carried, rows, 0)
    offset = ends[:-1] - ends[begin] + np.where(carried, size, 0)
    batch = closed + which + (rows > 0)
    if not starts:
        return [batch, pos, offset], (rows + total, size + int(ends[-1]), closed)
    return [batch, pos, offset], (total - starts[-1], int(ends[-1] - ends[starts[-1]]), int(batch[-1]))


#: A range's rows and bytes, its rows with bytes until a batch from before must have closed, and by the row at which one closes: the batch left open and how many closed.
JUMP = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "rows", "bytes", "reach")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("at", "sizes", "start", "open_rows", "open_bytes", "closed")])
ENTRY = "part long, rows long, bytes long, closed long"


@dataclass(frozen=True)
class Jump:
    """What a range of rows does to the batch that is open before it."""

    part: int
    rows: int
    bytes: int
    reach: int  # a batch from before has closed at this row at the latest
    at: np.ndarray
    sizes: np.ndarray
    start: np.ndarray
    open_rows: np.ndarray
    open_bytes: np.ndarray
    closed: np.ndarray

    @staticmethod
    def of(part: int, sizes: np.ndarray, limit: Limit) -> Jump:
        at, heads = _head(np.flatnonzero(sizes), sizes[sizes != 0], limit)
        step = next_starts(sizes, limit)
        return Jump(part, len(sizes), int(sizes.sum()), int(step[0]), at, heads, *_opens(sizes, step, limit))

    @staticmethod
    def read(row: dict) -> Jump:
        return Jump(**{k: np.array(v, np.int64) if isinstance(v, list) else v for k, v in row.items()})

    def after(self, state: State, limit: Limit) -> State:
        rows, size, closed = state
        start = _closes(self.at, self.sizes, self.rows, rows, size, limit) if rows else 0
        if start >= self.rows:  # it takes the whole range
            return rows + self.rows, size + self.bytes, closed
        k = int(np.searchsorted(self.start, start))
        return int(self.open_rows[k]), int(self.open_bytes[k]), closed + int(self.closed[k]) + (rows > 0)


def composed(jumps: list[Jump], part: int, limit: Limit) -> Jump:
    """The jump function of neighbouring ranges."""
    out = jumps[0]
    for right in jumps[1:]:
        states = np.stack([out.open_rows, out.open_bytes], 1)
        distinct, which = np.unique(states, axis=0, return_inverse=True)  # batches that once meet stay together
        moved = np.array([right.after((int(r), int(b), 0), limit) for r, b in distinct], np.int64).reshape(-1, 3)[which.ravel()]
        swallowed = out.reach >= out.rows  # a batch from before may reach into the right one
        more = slice(0, None if swallowed else 0)
        parts = [(out.start, right.start[more] + out.rows), (moved[:, 0], right.open_rows[more]), (moved[:, 1], right.open_bytes[more]), (out.closed + moved[:, 2], right.closed[more])]
        start, *opened = (np.concatenate(p) for p in parts)
        reach = out.rows + right.reach if swallowed else out.reach
        at, sizes = np.concatenate([out.at, right.at + out.rows]), np.concatenate([out.sizes, right.sizes])
        out = Jump(out.part, out.rows + right.rows, out.bytes + right.bytes, reach, *_head(at, sizes, limit), start, *opened)
    return replace(out, part=part)


def _jumps(limit: Limit):
    def table(part: int, sizes: list[np.ndarray]) -> pa.RecordBatch:
        jump = Jump.of(part, np.concatenate(sizes), limit)
        return pa.RecordBatch.from_arrays([pa.array([getattr(jump, f.name)], pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64()) for f in JUMP.fields], names=JUMP.names)

    def task(batches):
        now, sizes = None, []
        for part, begins, rows in runs(batches):
            if begins and sizes:
                yield table(now, sizes)
                sizes = []
            now = part
            sizes.append(rows.column("s0").to_numpy())
        if sizes:
            yield table(now, sizes)

    return task


def _entries(jumps: DataFrame, limit: Limit) -> DataFrame:
    """(part, rows, bytes, closed): the batch that is open where each range begins."""
    highest = jumps.agg(F.max("part")).first()[0]
    grouped = jumps.withColumn("of", F.floor(F.col("part") / FAN))
    if highest is None or highest < FAN:
        with_state = grouped.withColumns({c: F.lit(0).cast("long") for c in ("e_rows", "e_bytes", "e_closed")})
    else:

        def up(table: pa.Table) -> pa.Table:
            found = sorted((Jump.read(r) for r in table.drop_columns(["of"]).to_pylist()), key=lambda j: j.part)
            one = composed(found, found[0].part // FAN, limit)
            return pa.Table.from_pylist([{c: v.tolist() if isinstance(v := getattr(one, c), np.ndarray) else v for c in JUMP.names}])

        above = _entries(stored(grouped.groupBy("of").applyInArrow(up, JUMP), "composed"), limit)
        with_state = grouped.join(above.select(F.col("part").alias("of"), F.col("rows").alias("e_rows"), F.col("bytes").alias("e_bytes"), F.col("closed").alias("e_closed")), "of")

    def down(table: pa.Table) -> pa.Table:
        state = tuple(table.column(c)[0].as_py() for c in ("e_rows", "e_bytes", "e_closed"))
        out = []
        for jump in sorted((Jump.read({k: r[k] for k in JUMP.names}) for r in table.to_pylist()), key=lambda j: j.part):
            out.append((jump.part, *state))
            state = jump.after(state, limit)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], ["part", "rows", "bytes", "closed"])

    return with_state.groupBy("of").applyInArrow(down, ENTRY)


def _head(at: np.ndarray, sizes: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows with bytes and their sizes, those until a batch from before must have closed."""
    n = int(np.searchsorted(at, limit.max_count, side="right"))
    n = min(n, int(np.searchsorted(np.cumsum(sizes[:n]), max(limit.max_bytes, limit.close_after or 0), side="right")) + 1)
    return at[:n], sizes[:n]


def _opens(sizes: np.ndarray, step: np.ndarray, limit: Limit) -> tuple[np.ndarray, ...]:
    """For each possible first start: the batch left open at the range's end (rows, bytes), and how many closed before it.

    A batch from before closes by count within ``max_count`` rows, or by bytes at a row that has some, or right after one; one that is a larger row alone, at once."""
    n = len(sizes)
    last, closed = np.where(step < n, step, np.arange(n)), (step < n).astype(np.int64)
    while True:  # each pass doubles the number of batches gone through
        further = last[last]
        if (further == last).all():
            break
        closed, last = closed + closed[last], further
    ends = np.concatenate([[0], np.cumsum(sizes)])
    head = min(n, int(step[0]) + 1)
    starts = np.arange(head)
    if limit.max_count >= UNLIMITED:
        starts = starts[(starts == 0) | (sizes[:head] > 0) | np.concatenate([[False], sizes[: head - 1] > 0])]
    return starts, n - last[starts], ends[n] - ends[last[starts]], closed[starts]


def _closes(at: np.ndarray, sizes: np.ndarray, total: int, rows: int, size: int, limit: Limit) -> int:
    """The row at which a batch closes that already has ``rows`` rows of ``size`` bytes; ``total`` if it takes them all."""
    if size > limit.max_bytes:  # a larger row, which is alone: no row joins it, without bytes either
        return 0
    ends = size + np.cumsum(sizes)
    out = [total, max(0, limit.max_count - rows)]
    over = int(np.searchsorted(ends, limit.max_bytes, side="right"))
    if over < len(at):
        out.append(int(at[over]))
    if limit.close_after is not None:
        if size >= limit.close_after:
            return 0
        full = int(np.searchsorted(ends, limit.close_after, side="left"))
        if full < len(at):
            out.append(int(at[full]) + 1)
    return min(out)
