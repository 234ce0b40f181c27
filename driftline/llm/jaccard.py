"""Exact Jaccard self-join of word-shingle sets, by set-relation skipping.

A document's set holds its distinct shingles of ``width`` lower-cased words (A-Z
only); with fewer words, the whole sequence as one shingle. Two documents link
when 100 * |intersection| >= percent * |union|. The result is one row for each
document with its set's size and component.

Shingles are 64-bit hashes; a set is known by a 64-bit hash of its shingles, which a
second one confirms, so equal sets are one class and are never expanded into pairs.

1. Order. Every set is sorted rarest shingle first: one pass over all documents
   collects the frequent shingles (Misra-Gries), which go last; the rest go by
   hash. Two linked sets share a shingle among the first n - ceil(t * n) + 1 of each.
2. Index. These prefixes are inverted. In each list, sorted by size, rows of sizes
   that cannot link are skipped as a block, as are positions that leave too few
   shingles. Pairs that meet are held against a bound of their symmetric difference
   from parity maps of about half a bit to one bit for each shingle. Classes without
   a candidate are done. Lists beyond SMALL_LIST rows are left for step 4.
3. Families. Candidates with the same min-hash are compared in blocks. In a block
   the overlaps of a set with all others are derived from those of the linked set
   through which it was reached: only the lists of the shingles in which they
   differ are read. Sets that are connected already are not compared again. Large
   families are dealt into blocks that share pivots.
4. Rest. Pairs left between different components are compared one by one. Long
   lists are inverted again over the families' components; two components that
   meet in one are compared in full, in blocks, until a link is found. So no link
   between different texts is lost, and dense groups cost no square.

Defined cases: null and empty texts have no set, size 0, and are linked with
nothing (component: own id); a null id links like any other row, but a
component's id is the least that is not null (null if it has none); repeated rows
are equal sets; very long texts are whole sets; an empty table gives an empty
result; other input columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, new_path, stored
from .arrowtext import coded, given_back, hashes, mixed, owners, slices, texts_of, windows, words_of
from .components import components
from .names import fresh
from .skew import join_by_size

FREQUENT = 1 << 18
SMALL_LIST = 64
#: A block holds about so many sets, and shingles.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Up to so many rows of four numbers (32 MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
PIVOTS = 64
SEEN = 1 << 20
CHECK = 0x632BE59BD9B4E019
EMPTY = 0


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash."""
    flat, offsets = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(flat)
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    row = owners(offsets)
    own = windows(h, width)
    inside = row[: len(own)] == row[width - 1 :] if len(own) else np.zeros(0, bool)
    rows, values = row[: len(own)][inside], own[inside]
    n = np.diff(offsets)
    for k in np.flatnonzero((n > 0) & (n < width)):
        value = np.uint64(n[k])
        for x in h[offsets[k] : offsets[k + 1]]:
            value = mixed(np.array([value ^ x]))[0]
        rows, values = np.append(rows, k), np.append(values, value)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[fresh], values[fresh]


def set_hash(values: np.ndarray, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of values from ``starts`` on, whatever their order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = mixed(values + np.uint64(seed)) if seed else values
    total = np.add.reduceat(mixed(values), starts)
    other = np.bitwise_xor.reduceat(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return mixed(total * np.uint64(0x9E3779B97F4A7C15) + other)


def needed(n: np.ndarray | int, percent: int):
    """Least overlap with any set that links to one of n shingles: ceil(t * n)."""
    return -(-n * percent // 100)


def frequent_shingles(df: DataFrame, width: int, size: int = FREQUENT) -> np.ndarray:
    """Hashes of the corpus's frequent shingles, rarest first, at most ``size``."""

    def fold(held, values, counts):
        values, inverse = np.unique(np.concatenate([held[0], values]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([held[1], counts]), len(values)).astype(np.int64)
        if len(values) > size:
            cut = np.partition(counts, -size - 1)[-size - 1]
            keep = counts > cut
            values, counts = values[keep], counts[keep] - cut
        return values, counts

    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def row(held):
        return pa.RecordBatch.from_arrays([pa.array([held[0].tobytes()], pa.binary()), pa.array([held[1].tobytes()], pa.binary())], ["values", "counts"])

    def summed(batches):
        held = none
        for batch in batches:
            texts = texts_of(batch.column(0))
            for lo, hi in slices(texts):
                _, values = shingles(texts.slice(lo, hi - lo), width)
                values, counts = np.unique(values, return_counts=True)
                held = fold(held, values[counts > 1], counts[counts > 1])
        yield row(held)
        given_back()

    def merged(batches):
        held = none
        for batch in batches:
            for v, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = fold(held, np.frombuffer(v, np.uint64), np.frombuffer(c, np.int64))
        yield row(held)

    n = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    names = "values binary, counts binary"
    held = none  # two levels of merging, so that one summary of bounded size is all that comes to the driver
    for r in df.mapInArrow(summed, names).repartition(n).mapInArrow(merged, names).repartition(1).mapInArrow(merged, names).collect():
        held = fold(held, np.frombuffer(r["values"], np.uint64), np.frombuffer(r["counts"], np.int64))
    return held[0][np.lexsort((held[0], held[1]))]


class Order:
    """The common order of shingles: infrequent ones by hash, then the frequent ones, rarest first."""

    def __init__(self, frequent: np.ndarray):
        at = np.argsort(frequent)
        self.values, self.ranks = frequent[at], at + 1

    def rank(self, values: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return np.where(self.values[at] == values, self.ranks[at], 0)


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _signed(order, width: int, percent: int):
    """Of each document: size, class, min-hash, and of one document of a class in a task the prefix."""

    def task(batches):
        own, seen = Order(order.value), set()
        for batch in batches:
            texts = texts_of(batch.column(2))
            for lo, hi in slices(texts):
                rows, values = shingles(texts.slice(lo, hi - lo), width)
                n = np.bincount(rows, minlength=hi - lo)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                cls, check, low = (np.zeros(hi - lo, np.uint64) for _ in range(3))
                cls[full], check[full] = set_hash(values, starts), set_hash(values, starts, CHECK)
                if len(full):
                    low[full] = np.minimum.reduceat(mixed(values ^ np.uint64(0x2545F4914F6CDD1D)), starts)
                words, begin = parity(rows, values, n)
                bits = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), as_long(words))
                first = np.zeros(hi - lo, bool)
                for k in full:
                    c = int(cls[k]), int(check[k])
                    first[k] = c not in seen
                    seen.add(c)
                if len(seen) > SEEN:
                    seen.clear()
                mine = first[rows]
                rows, values = rows[mine], values[mine]
                by = np.lexsort((values, own.rank(values), rows))
                rows, values = rows[by], values[by]
                length = np.where(first, n - needed(n, percent) + 1, 0)
                begin = np.cumsum(np.bincount(rows, minlength=hi - lo)) - np.bincount(rows, minlength=hi - lo)
                inside = np.arange(len(rows)) - begin[rows] < length[rows]
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), as_long(values[inside]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), pa.array(n, pa.int64()), as_long(cls), as_long(check), as_long(low), prefix, bits], ["rid", "doc_id", "n", "cid", "check", "low", "prefix", "bits"])
        given_back()

    return task


def list_pairs(key: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists sorted by key and size: pairs of rows that size and position allow, and the rows of lists beyond ``small``.

    Row i meets row i + d of its list for d = 1, 2, ... All lists go side by side,
    and a row leaves as soon as the next size is too large: the rest of its list is skipped.
    """
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(edges)
    large = np.repeat(length > small, length)
    end = np.repeat(edges[1:], length)
    row = np.flatnonzero(~large & (np.arange(len(key)) + 1 < end))
    out_i, out_j = [], []
    for d in range(1, small):
        row = row[row + d < end[row]]
        row = row[n[row + d] * percent <= n[row] * 100]
        if not len(row):
            break
        least = -(-percent * (n[row] + n[row + d]) // (100 + percent))
        ok = row[np.minimum(n[row] - pos[row], n[row + d] - pos[row + d]) >= least]
        out_i.append(ok)
        out_j.append(ok + d)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none), np.flatnonzero(large)


def partners(low: np.ndarray, high: np.ndarray, room: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list, sorted by least size, that the bounds of their rows allow."""
    last = np.searchsorted(low, high * 100 // percent, side="right")
    count = np.maximum(last - np.arange(len(low)) - 1, 0)
    i = np.repeat(np.arange(len(low)), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
    least = -(-percent * (low[i] + low[j]) // (100 + percent))
    ok = np.minimum(room[i], room[j]) >= least
    return i[ok], j[ok]


def distinct_pairs(pair: np.ndarray) -> np.ndarray:
    """Rows (a, b) of different a and b, smaller first, each once."""
    pair = pair[pair[:, 0] != pair[:, 1]] if len(pair) else pair.reshape(0, 2)
    pair = np.stack([pair.min(1), pair.max(1)], 1) if len(pair) else pair
    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]).any(1)
    return pair[fresh]


def _pair_batch(pair: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], ["a", "b"])


def _met(percent: int):
    """Distinct pairs (a < b) of ids that meet in a list, from postings (hash, n, pos, id) sorted by hash and size; (hash, hash) tells of a long list."""

    small = SMALL_LIST  # the driver's value, whatever a worker's module says

    def pairs(rows):
        key, n, pos, name = rows
        i, j, large = list_pairs(key, n, pos, percent, small)
        found = distinct_pairs(np.stack([name[i], name[j]], 1))
        told = np.unique(key[large])
        return np.concatenate([found, np.stack([told, told], 1)])

    def task(batches):
        # the rows of the list that is open: pieces are put together once, when it ends
        held, size, long_list = [np.zeros((4, 0), np.int64)], 0, None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            if not rows.shape[1]:
                continue
            # one row for each class of a list, however many documents there are of it
            rows = rows[:, np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[3, 1:] != rows[3, :-1])])]
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            if size and held[-1][0, -1] != rows[0, 0]:
                yield _pair_batch(pairs(np.concatenate(held, 1)))
                held, size = [rows[:, :0]], 0
            if cut:
                yield _pair_batch(pairs(np.concatenate([*held, rows[:, :cut]], 1)))
                held, size = [rows[:, :0]], 0
            held.append(rows[:, cut:])
            size += rows.shape[1] - cut
            now = int(rows[0, -1])
            if size > small or now == long_list:
                if now != long_list:  # a long list is told once and never held
                    long_list = now
                    yield _pair_batch(np.array([[long_list, long_list]]))
                held, size = [rows[:, :0]], 0
        if size:
            yield _pair_batch(pairs(np.concatenate(held, 1)))

    return task


def long_pairs(entries: DataFrame, percent: int, shuffle: int) -> DataFrame:
    """Distinct pairs (a < b) of ids that may meet in long lists, from entries (hash, n, pos, id).

    The entries of one id in one cell of a list (like size and position) become one row with bounds of what they hold: least
    and largest size, and most shingles from the entry's place on. So a list is as long as its ids are many, however many sets
    an id stands for. Large cells are cut into blocks by the ids' hashes. Of blocks only bounds meet: two whose sizes are too
    far apart, or whose rows stand too late in their sets, are skipped whole. Each pair of blocks left is one task's, so a list
    of any length is many tasks' work. Lists of one id are left out."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("long")
    late = F.floor(F.log2(F.col("pos") + 1.0)).cast("long")
    bounds = (F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("room"))
    folded = stored(entries.groupBy("hash", band.alias("band"), late.alias("late"), "id").agg(*bounds), "folded")
    several = folded.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most").select("hash")
    own = stored(folded.join(several, "hash", "left_semi"), "banded")
    cells = own.groupBy("hash", "band", "late").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("room").alias("room"))
    cells = stored(cells, "cells")
    code = lambda part: F.shiftleft("band", 44) + F.shiftleft("late", 36) + part
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("hash", code(F.col("part")).alias("block"), "low", "high", "room")
    left, right = (blocks.select("hash", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high", "room"))) for side in "ij")
    least = F.ceil(percent * (F.col("low_i") + F.col("low_j")) / (100 + percent))
    near = (F.col("low_i") * percent <= F.col("high_j") * 100) & (F.col("low_j") * percent <= F.col("high_i") * 100)
    pairs = left.join(right, "hash").filter((F.col("block_i") <= F.col("block_j")) & near & (F.least("room_i", "room_j") >= least))
    pairs = pairs.select("hash", F.col("block_i").alias("i"), F.col("block_j").alias("j"), F.explode(F.array_distinct(F.array("block_i", "block_j"))).alias("block"))
    placed = own.join(cells.select("hash", "band", "late", "parts"), ["hash", "band", "late"])
    placed = placed.select("hash", code(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "low", "high", "room", "id")
    dealt = pairs.join(placed, ["hash", "block"]).select("hash", "i", "j", "block", "low", "high", "room", "id").repartition(shuffle, "hash", "i", "j").sortWithinPartitions("hash", "i", "j", "low")

    def task(batches):
        for table in _grouped(batches, 3):
            block, low, high, room, name = (table.column(c).to_numpy() for c in ("block", "low", "high", "room", "id"))
            i, j = partners(low, high, room, percent)
            # two blocks meet each other here, and themselves in a group of their own
            ok = (name[i] != name[j]) & ((block[i] != block[j]) | (table.column("i")[0] == table.column("j")[0]))
            yield _pair_batch(distinct_pairs(np.stack([name[i[ok]], name[j[ok]]], 1)))

    return dealt.mapInArrow(task, "a long, b long").distinct()


def map_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity map of a set of n shingles: a power of two from n / 2 on, 64 at least."""
    return 64 << np.ceil(np.log2(np.maximum(n, 128) / 128)).astype(np.int64)


def parity(rows: np.ndarray, values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, as 64-bit words, the parity of how many of its shingles fall on each bit; and where its words begin."""
    bits = map_bits(n)
    ends = np.concatenate([[0], np.cumsum(bits)])
    at = ends[:-1][rows] + (mixed(values ^ np.uint64(0x9FB21C651E98DF25)) & (bits[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(ends[-1])).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64), ends // 64


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference from two maps; the longer one is folded, which keeps parities."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _near(percent: int):
    """Of pairs (a, b, na, nb, bits_a, bits_b): those whose sets may link."""

    def task(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            words, starts = [], []
            for k in (4, 5):
                column = batch.column(k)
                starts.append(column.offsets.to_numpy())
                words.append(column.values.to_numpy(zero_copy_only=False).view(np.uint64))
            (wa, wb), (sa, sb) = words, starts
            far = np.fromiter((apart(wa[sa[k] : sa[k + 1]], wb[sb[k] : sb[k + 1]]) for k in range(batch.num_rows)), np.int64, batch.num_rows)
            keep = pa.array(far * (100 + percent) <= (100 - percent) * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return task


def may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the parity bound; classes: (cid, n, bits)."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_near(percent), "a long, b long")


class Block:
    """Some sets with an inverted index over all their shingles."""

    def __init__(self, texts: pa.Array, width: int, percent: int):
        rows, values = shingles(texts, width)
        self.percent = percent
        self.n = np.bincount(rows, minlength=len(texts))
        ends = np.cumsum(self.n)
        self.distinct, codes = np.unique(values, return_inverse=True)
        self.sets = [codes[a:b] for a, b in zip((ends - self.n).tolist(), ends.tolist())]
        order = np.argsort(codes, kind="stable")
        self.members = rows[order]
        self.index = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.distinct)))])

    def lists(self, codes: np.ndarray) -> np.ndarray:
        """For each set the number of these shingles that it holds."""
        a, n = self.index[codes], self.index[codes + 1] - self.index[codes]
        ends = np.cumsum(n)
        at = np.repeat(a - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.bincount(self.members[at], minlength=len(self.n))

    def answers(self, x: np.ndarray, base: np.ndarray | None, overlap: np.ndarray | None) -> np.ndarray:
        """``lists`` of set ``x``: derived from those of ``base`` where the two differ in less than x holds, else read in full."""
        if base is not None:
            gone, new = np.setdiff1d(base, x, True), np.setdiff1d(x, base, True)
            if len(gone) + len(new) < len(x):
                return overlap - self.lists(gone) + self.lists(new)
        return self.lists(x)

    def links(self, overlap: np.ndarray, n: int) -> np.ndarray:
        return 100 * overlap >= self.percent * (self.n + n - overlap)

    def components(self) -> np.ndarray:
        """For each set the first one of its component."""
        label = np.full(len(self.n), -1, np.int64)
        open_ = np.ones(len(self.n), bool)
        for start in range(len(self.n)):
            if label[start] >= 0:
                continue
            label[start], open_[start] = start, False
            stack = [(start, None, None)]
            while stack and open_.any():
                x, base, overlap = stack.pop()
                overlap = self.answers(self.sets[x], None if base is None else self.sets[base], overlap)
                found = np.flatnonzero(open_ & self.links(overlap, int(self.n[x])))
                label[found], open_[found] = start, False
                stack += [(int(y), x, overlap) for y in found]
        return label


def _grouped(batches, keys: int):
    """Batches sorted by their first ``keys`` columns as one table for each combination."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held


def _families(width: int, percent: int):
    def task(batches):
        for table in _grouped(batches, 2):
            if table.num_rows < 2:
                continue
            cid = table.column("cid").to_numpy()
            label = Block(texts_of(table.column("text")), width, percent).components()
            linked = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(cid[linked], pa.int64()), pa.array(cid[label[linked]], pa.int64())], ["a", "b"])

    return task


def _compared(width: int, percent: int):
    """Of each (component, part, round): links of its members with other components' members."""

    def task(batches):
        for table in _grouped(batches, 3):
            other = table.column("other").to_numpy()
            home = int(table.column("home")[0].as_py())
            target = other == home
            if target.all() or not target.any():
                continue
            block = Block(texts_of(table.column("text").combine_chunks()), width, percent)
            linked, base, overlap = set(), None, None
            for k in np.flatnonzero(~target):  # sorted by component, so the set before is a similar one as a rule
                if other[k] in linked:
                    continue
                overlap, base = block.answers(block.sets[k], base, overlap), block.sets[k]
                if (target & block.links(overlap, int(block.n[k]))).any():
                    linked.add(other[k])
            yield pa.RecordBatch.from_arrays([pa.array([home] * len(linked), pa.int64()), pa.array(list(linked), pa.int64())], ["a", "b"])

    return task


def jaccard_components(df: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df``; needs percent > 50."""
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed(df, key, text)
    order = spark.sparkContext.broadcast(frequent_shingles(docs.select("text"), width))
    signed_at = new_path(spark, "signed")
    signed = stored(docs.mapInArrow(_signed(order, width, percent), "rid binary, doc_id long, n long, cid long, check long, low long, prefix array<long>, bits array<long>"), "signed", signed_at)
    # different sets of one hash, if ever there are any, become classes of their own
    torn = signed.filter("n > 0").groupBy("cid").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least != most").select("cid")
    if torn.limit(1).count():
        here = F.broadcast(torn.withColumn("torn", F.lit(True)))
        own = F.when(F.col("torn"), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
        signed = stored(signed.join(here, "cid", "left").withColumn("cid", own).drop("torn"), "signed-apart")

    # pairs of classes that meet in a short list and may link; long lists are kept for later
    indexed = signed.filter("size(prefix) > 0")
    postings = indexed.select("cid", "n", F.posexplode("prefix").alias("pos", "hash")).select("hash", "n", "pos", "cid")
    dealt = postings.repartition(shuffle, "hash").sortWithinPartitions("hash", "n", "cid")
    found = stored(dealt.mapInArrow(_met(percent), "a long, b long").distinct(), "candidates")
    classes = indexed.select("cid", "n", "bits").dropDuplicates(["cid"])
    near = stored(may_link(found.filter("a != b"), classes, percent), "near")
    long_lists = found.filter("a = b").select(F.col("a").alias("hash"))
    any_long = long_lists.limit(1).count() > 0
    active = near.select(F.explode(F.array("a", "b")).alias("cid"))
    if any_long:
        crowded = stored(postings.join(sent(long_lists), "hash").distinct(), "long-lists")
        active = active.unionByName(crowded.select("cid"))

    # their texts, one for each class; few classes are sent to where the texts are, many meet them in a shuffle
    reps = indexed.groupBy("cid").agg(F.min(F.struct("rid", "n", "low")).alias("r")).join(active.distinct(), "cid").select("cid", "r.*")
    reps = stored(reps, "reps")
    members = stored(docs.select("rid", "text").join(sent(reps), "rid").select("cid", "n", "low", "text"), "members")

    # families: equal min-hash, in blocks with shared pivots
    sizes = members.groupBy("low").agg(F.count("*").alias("size"), blocks_of(F.count("*"), F.sum("n")).alias("blocks")).filter("size > 1")
    family = members.join(sent(stored(sizes, "sizes")), "low")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cid"), F.col("size")) < PIVOTS)
    block = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")).cast("int")))
    family = family.select("low", F.explode(block).alias("block"), "cid", "text").repartition(shuffle, "low", "block").sortWithinPartitions("low", "block", "cid")
    first = components(family.mapInArrow(_families(width, percent), "a long, b long"))

    labelled = members.select("cid", "n").distinct().join(first.withColumnsRenamed({"node": "cid", "label": "comp"}), "cid", "left")
    labelled = stored(labelled.select("cid", F.coalesce("comp", "cid").alias("comp"), "n"), "labelled")
    comp_of = lambda c: labelled.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}"))

    # what is left: pairs of classes in different components, and components that meet in a long list
    left = stored(near.join(comp_of("a"), "a").join(comp_of("b"), "b").filter("comp_a != comp_b").select("a", "b"), "left")
    links = compared(left, members.select(F.col("cid").alias("unit"), "cid", "n", "text"), width, percent, shuffle)
    if any_long:
        entries = stored(crowded.join(labelled.select("cid", "comp"), "cid").select("hash", "n", "pos", F.col("comp").alias("id")), "entries")
        met = stored(long_pairs(entries, percent, shuffle), "met")
        units = members.join(labelled.select("cid", "comp"), "cid").select(F.col("comp").alias("unit"), "cid", "n", "text")
        links = links.unionByName(compared(met, units, width, percent, shuffle))
    links = links.join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left")
    second = components(links.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))

    final = labelled.join(second.withColumnsRenamed({"node": "comp", "label": "whole"}), "comp", "left").select("cid", F.coalesce("whole", "comp").alias("whole"))
    rows = signed.select("rid", "doc_id", "n", "cid").join(final, "cid", "left")
    rows = stored(rows.select("rid", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("whole", "cid")).alias("whole")), "rows")
    drop(spark, signed_at)
    names = rows.filter("whole is not null").groupBy("whole").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"), F.count("*").alias("size"))
    names = stored(names.select("whole", "component_id", F.col("first.rid").alias("first"), "size"), "names")
    linked = join_by_size(rows.filter("whole is not null"), names, "whole", "size").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "rid", "first")
    return linked.unionByName(rows.filter("whole is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid", F.col("rid").alias("first")))


def compared(pairs: DataFrame, units: DataFrame, width: int, percent: int, shuffle: int) -> DataFrame:
    """Those pairs (a, b) of units of which a member links with one of the other's; units: (unit, cid, n, text).

    The larger unit's members lie in blocks; the smaller unit's come to each of them."""
    size = units.groupBy("unit").agg(F.sum("n").alias("size"), blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    for side in "ab":
        pairs = pairs.join(size.select(F.col("unit").alias(side), F.col("size").alias(f"n{side}"), F.col("blocks").alias(f"k{side}")), side)
    swap = F.col("na") < F.col("nb")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    pairs = stored(pairs.select(pick("b", "a").alias("home"), pick("a", "b").alias("other"), pick("kb", "ka").alias("parts"), pick("na", "nb").alias("asked")), "pairs")
    homes = pairs.groupBy("home", "parts").agg(blocks_of(F.count("*"), F.sum("asked")).alias("rounds"))
    texts = units.select("unit", "cid", "text")
    targets = texts.join(homes, F.col("unit") == F.col("home")).select(
        "home", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), F.col("home").alias("other"), "text"
    )
    asking = pairs.join(homes.select("home", "rounds"), "home").join(texts, F.col("unit") == F.col("other"))
    asking = asking.select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("other"), F.col("rounds")).cast("int").alias("round"), "other", "text")
    dealt = targets.unionByName(asking).repartition(shuffle, "home", "part", "round").sortWithinPartitions("home", "part", "round", "other")
    return stored(dealt.mapInArrow(_compared(width, percent), "a long, b long"), "links")


def sent(table: DataFrame) -> DataFrame:
    """A narrow stored table, to be broadcast if it is small by count and joined by shuffle if not."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def rid_of(doc_id: Column, body: Column) -> Column:
    """128 bits of a row's key and text, the same whenever and wherever the row is read."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(body.isNull(), F.lit("-")).otherwise(F.lit(":")), F.coalesce(body, F.lit("")))
    return F.unhex(F.md5(told.cast("binary")))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, doc_id, text)."""
    doc_id, body = F.col(key).cast("long"), F.col(text)
    return df.select(rid_of(doc_id, body).alias("rid"), doc_id.alias("doc_id"), body.alias("text"))


def blocks_of(sets, shingles_):
    """How many blocks so many sets with so many shingles take."""
    return F.ceil(F.greatest(sets / BLOCK, shingles_ / BLOCK_SHINGLES, F.lit(1.0))).cast("int")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component of linked documents: that with the least key, nulls last.

    Rows without words are linked with nothing and all stay. Of rows with words that
    are the same in key and text one stays, whatever their other columns hold.
    """
    found = stored(jaccard_components(df, width, percent, key, text).filter("n_shingles > 0").select("rid", "first"), "found")
    (rid,) = fresh(df, "rid")
    removed = found.filter("rid != first").select(F.col("rid").alias(rid)).distinct()
    repeated = found.groupBy(F.col("rid").alias(rid)).agg(F.count("*").alias("n")).filter("n > 1").select(rid)
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*names, rid_of(F.col(key).cast("long"), F.col(text)).alias(rid))
    rows = rows.join(sent(removed), rid, "left_anti")
    if repeated.limit(1).count():  # only then do whole rows have to meet
        rows = rows.join(repeated, rid, "left_anti").unionByName(rows.join(repeated, rid, "left_semi").dropDuplicates([rid]))
    return rows.select(*names)
