"""Best-fit packing of token pieces into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the instance is a histogram of
at most ``capacity`` counts, however many documents there are. It is solved on
the driver in three steps:

1. Pieces as long as a sequence fill one each.
2. Martello-Toth reduction: for a piece of length w, a set of at most three with it
   is fixed for good when every other set with that piece could be exchanged for
   it without needing more sequences. With r the room beside it: nothing fits
   in r -> {w}; b, the longest that fits, is r long, or no two fit together, or no
   three fit and no two are longer than b together -> {w, b}; no three fit, and with s
   the longest that fits beside b no two pieces longer than s fit -> {w, b, s}. All
   lengths are tried, longest first, again and again until none can be fixed. Many equal
   pieces are fixed at once, as the rule holds on for what is left.
3. The remainder goes by best fit in falling order, whole groups of equal pieces
   and equal rooms at a time.

The plan is a table of runs (length, first rank, items a sequence, first
sequence, offset), a few for each length, and the pieces find their place by
their rank among the pieces of their length. Ranks come in two levels, counts by
part of the input and row numbers in it, so a hot length is no single task.

Defined cases: a null or empty text is one piece that holds the end id; repeated
rows are packed one by one; an empty table gives no pieces; columns of the
input other than key and text are carried along unless ``pieces`` makes their name.
"""

from __future__ import annotations

import bisect
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .arrowtext import given_back, texts_of
from .names import fresh, with_plain_names
from .tokens import encoded_slices

CAPACITY = 2048
PIECE = ("piece", "start", "length", "ids", "ids_crc32")


def pieces(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", digest_only: bool = False) -> DataFrame:
    """One row for each piece: the input's columns but ``text``, then piece, start, length and ids
    (little-endian unsigned 32-bit), or with ``digest_only`` ids_crc32 in their place."""
    return with_plain_names(df, lambda d, n: _cut(d, tokenizer, end_id, capacity, n[text], digest_only), (text,), PIECE)


def _cut(df: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str, digest_only: bool) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    last = T.StructField("ids_crc32", T.LongType()) if digest_only else T.StructField("ids", T.BinaryType())
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), last])

    def task(batches):
        for batch in batches:
            for lo, hi, flat, ends in encoded_slices(tokenizer, texts_of(batch.column(len(rest)))):
                flat = np.insert(flat, ends[1:], end_id).astype("<u4")
                ends = ends + np.arange(len(ends))
                count = -(-np.diff(ends) // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(ends)[row] - start)
                first = ends[row] + start
                data = memoryview(flat.tobytes())
                parts = [data[4 * a : 4 * (a + n)] for a, n in zip(first.tolist(), length.tolist())]
                body = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest_only else pa.array([bytes(x) for x in parts], pa.binary())
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(rest))), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), body], schema.names)
        given_back()

    return df.select(*rest, text).mapInArrow(task, schema)


class Run(NamedTuple):
    """``count`` pieces of one length, ``each`` in a sequence, from sequence ``first`` on, the first of them at ``offset``."""

    length: int
    count: int
    each: int
    first: int
    offset: int


class Plan:
    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.runs, self.sequences, self.fixed = capacity, [], 0, 0
        left = {w: n for w, n in histogram.items() if n > 0}
        if any(not 0 < w <= capacity for w in left):
            raise ValueError("a piece must hold 1 to capacity tokens")
        self._reduce(left)
        self.fixed = self.sequences
        self._best_fit(left)

    def _open(self, count: int, *lengths: int) -> None:
        """``count`` new sequences, each with one piece of every length given."""
        offset = 0
        for w in lengths:
            self.runs.append(Run(w, count, 1, self.sequences, offset))
            offset += w
        self.sequences += count

    def _reduce(self, left: dict[int, int]) -> None:
        """Fix dominating sets until no length has one; what is left stays in ``left``."""
        sizes = sorted(left)

        def use(own: tuple[int, ...]) -> None:
            times = {w: own.count(w) for w in own}
            n = min(left[w] // k for w, k in times.items())
            self._open(n, *own)
            for w, k in times.items():
                left[w] -= n * k
                if not left[w]:
                    del left[w]
                    sizes.pop(bisect.bisect_left(sizes, w))

        # exact pairs first: they dominate wherever they stand
        for w in sorted(left, reverse=True):
            mate = self.capacity - w
            if w in left and mate in left and (w != mate or left[w] > 1):
                use((w, mate))
        moved = True
        while moved:
            moved = False
            for w in sorted(left, reverse=True):
                while w in left and (own := self._dominating(left, sizes, w)):
                    use(own)
                    moved = True

    def _dominating(self, left: dict[int, int], sizes: list[int], w: int) -> tuple[int, ...] | None:
        """A set with a piece of length w that dominates all others with it, if one is proven."""
        room = self.capacity - w

        def free(x: int, *used: int) -> int:
            return left[x] - (w, *used).count(x)

        def shortest(n: int, above: int = 0) -> list[int]:
            """The n shortest other pieces longer than ``above``."""
            out: list[int] = []
            for x in sizes[bisect.bisect_right(sizes, above) :]:
                out += [x] * min(free(x), n - len(out))
                if len(out) == n:
                    break
            return out

        def longest(most: int, *used: int) -> int | None:
            k = bisect.bisect_right(sizes, most) - 1
            while k >= 0 and free(sizes[k], *used) < 1:
                k -= 1
            return sizes[k] if k >= 0 else None

        few = shortest(3)
        if not few or few[0] > room:
            return (w,)
        b = longest(room)
        if b == room or len(few) < 2 or few[0] + few[1] > room:
            return (w, b)
        if len(few) == 3 and sum(few) <= room:
            return None
        if (s := longest(room - b, b)) is not None:
            two = shortest(2, s)
            if len(two) < 2 or sum(two) > room:
                return (w, b, s)
        best, i, j = 0, 0, bisect.bisect_right(sizes, room) - 1
        while i <= j:  # the longest two that fit together
            pair = sizes[i] + sizes[j]
            if pair > room or free(sizes[j]) < 1:
                j -= 1
            elif free(sizes[i]) < 1 or i == j and free(sizes[i]) < 2:
                i += 1
            else:
                best = max(best, pair)
                i += 1
        return (w, b) if best <= b else None

    def _best_fit(self, left: dict[int, int]) -> None:
        rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count) of the sequences with it
        order: list[int] = []

        def offer(room: int, first: int, count: int) -> None:
            if room and count:
                if room not in rooms:
                    bisect.insort(order, room)
                    rooms[room] = []
                rooms[room].append((first, count))

        for w in sorted(left, reverse=True):
            n = left[w]
            while n:
                k = bisect.bisect_left(order, w)
                if k < len(order):
                    room = order[k]
                    first, count = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[k]
                else:
                    room, first, count = self.capacity, self.sequences, -(-n // (self.capacity // w))
                    self.sequences += count
                each = min(room // w, n)
                full = min(count, n // each)
                self.runs.append(Run(w, full * each, each, first, self.capacity - room))
                offer(room - each * w, first, full)
                n -= full * each
                offer(room, first + full, count - full)

    def table(self) -> dict[str, np.ndarray]:
        """Runs sorted by length and first rank."""
        rank: dict[int, int] = {}
        rows = []
        for r in self.runs:
            rows.append((r.length, rank.get(r.length, 0), r.each, r.first, r.offset))
            rank[r.length] = rank.get(r.length, 0) + r.count
        made = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "each", "first", "offset"), made.T))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    shift = int(max(table["rank"].max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(table["length"] * shift + table["rank"], length * shift + rank, side="right") - 1
    step = rank - table["rank"][at]
    return table["first"][at] + step // table["each"][at], table["offset"][at] + step % table["each"][at] * length


def pack(df: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``df``, whose rows are pieces, with sequence_id and offset; sequences are gapless from offset 0."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("sequence_id", "offset")])
    names = [F.col(f"`{c}`") for c in df.columns]
    part, at, n, base, rank = fresh(df, "part", "at", "n", "base", "rank")
    parted = stored(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "pieces")
    counts = parted.groupBy(part, length).agg(F.count("*").alias(n))
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum(n)).collect()}  # capacity rows at most
    plan = Plan(histogram, capacity)
    table = df.sparkSession.sparkContext.broadcast(plan.table())
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = Window.partitionBy(part, length).orderBy(at)
    ranked = parted.withColumn(rank, F.row_number().over(inside) - 1).join(bases, [part, length])
    ranked = ranked.select(*names, (F.col(rank) + F.col(base)).alias(rank))
    at_length = df.columns.index(length)
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def task(batches):
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at_length, batch.num_columns - 1))
            sequence, offset = place(table.value, n, rank) if len(n) else (n, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema.names)

    return ranked.mapInArrow(task, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length and ids, from pieces that carry their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
