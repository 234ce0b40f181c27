"""Reconciliation in proportion to the change: snapshots stored with a tree of digests.

Rows are dealt into blocks by the hash of their key. A block's digest is a sum of hashes
of its rows, so it does not depend on their order, and a node's digest is the sum of its
children's: the levels above the blocks are plain aggregates. Two snapshots are compared
from the root down; subtrees of equal digests are skipped, and rows are read and joined
only in blocks that differ. Rows are stored in order of their block, so the filter on
blocks prunes row groups of the stored side.

Digests are four sums of 32-bit halves of two 64-bit hashes, and a count: equal digests of
different blocks are out of the question by accident, but not for an adversary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import column, fresh
from ..scratch import new_path, stored
from .ledger import KEY

#: Children of a node, and rows of a block as a rule.
FAN, BLOCK_ROWS = 16, 4096
SUMS = ("s0", "s1", "s2", "s3", "n")


@dataclass(frozen=True)
class Snapshot:
    """A stored snapshot: its rows with their ``block``, and the digests of each level (``levels[0]``: blocks)."""

    rows: DataFrame
    levels: list[DataFrame]
    key: str
    columns: tuple[str, ...]
    block: str


def blocks_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """How many blocks: a power of FAN."""
    n = 1
    while n * block_rows < rows:
        n *= FAN
    return n


def snapshot(df: DataFrame, columns: list[str], blocks: int, key: str = KEY, path: str | None = None) -> Snapshot:
    """Store ``df`` with its digests over ``columns``. Snapshots to be compared have the same number of blocks."""
    spark, (block,) = df.sparkSession, fresh(df, "block")
    where = path or new_path(spark, "snapshot")
    dealt = df.withColumn(block, F.pmod(F.xxhash64(column(key)), F.lit(blocks))).repartitionByRange(column(block)).sortWithinPartitions(column(block))
    rows = stored(dealt, "rows", f"{where}/rows")
    own = [column(key), *map(column, columns)]
    halves = [f(F.xxhash64(F.lit(seed), *own)) for seed in (1, 2) for f in (lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32))]
    # a null hashes as nothing: how many columns before it are set tells (null, 1) from (1, null)
    marks = F.concat(*[c.isNull().cast("int").cast("string") for c in own])
    halves = [F.pmod(h + F.xxhash64(F.lit(i), marks), F.lit(1 << 32)) for i, h in enumerate(halves)]
    level = rows.groupBy(column(block).alias("node")).agg(*(F.sum(h).alias(s) for h, s in zip(halves, SUMS)), F.count("*").alias("n"))
    levels, width = [stored(level, "level", f"{where}/level-0")], blocks
    while width > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*(F.sum(s).alias(s) for s in SUMS))
        levels.append(stored(up, "level", f"{where}/level-{len(levels)}"))
        width = -(-width // FAN)
    return Snapshot(rows, levels, key, tuple(columns), block)


def changed_blocks(old: Snapshot, new: Snapshot) -> tuple[DataFrame, int]:
    """(node) of the blocks whose digests differ, and how many pairs of nodes were compared on the way down."""
    if len(old.levels) != len(new.levels):
        raise ValueError("snapshots of different numbers of blocks")
    compared, open_ = 0, None
    for a, b in zip(reversed(old.levels), reversed(new.levels)):
        if open_ is not None:  # children of the nodes that differ
            inside = open_.select(F.col("node").alias("up"))
            a, b = (t.withColumn("up", F.floor(F.col("node") / FAN)).join(inside, "up", "left_semi").drop("up") for t in (a, b))
        both = a.select("node", F.struct(*SUMS).alias("was")).join(b.select("node", F.struct(*SUMS).alias("now")), "node", "full")
        met = stored(both.select("node", (~F.col("was").eqNullSafe(F.col("now"))).alias("differs")), "met")
        compared += met.count()
        open_ = met.filter("differs")
    return open_.select("node"), compared


@dataclass(frozen=True)
class Changes:
    """``rows``: (key, action COPY, UPDATE or DELETE) of keys that differ; what it took to find them."""

    rows: DataFrame
    nodes_compared: int
    rows_compared: int


def changes(old: Snapshot, new: Snapshot) -> Changes:
    """What makes ``old`` into ``new``, over the digested columns; keys identify rows."""
    blocks, compared = changed_blocks(old, new)
    own = [column(c).alias(f"v{i}") for i, c in enumerate(new.columns)]
    side = lambda s, name: s.rows.join(blocks, column(s.block) == F.col("node"), "left_semi").select(column(s.key).alias("k"), F.struct(*own).alias(name))
    names = _few(blocks)
    if names is not None:  # so that the scans skip row groups
        side = lambda s, name: s.rows.filter(column(s.block).isin(names) if names else F.lit(False)).select(column(s.key).alias("k"), F.struct(*own).alias(name))
    joined = stored(side(old, "was").join(side(new, "now"), "k", "full"), "compared")
    action = F.when(F.col("was").isNull(), "COPY").when(F.col("now").isNull(), "DELETE").when(~F.col("was").eqNullSafe(F.col("now")), "UPDATE")
    found = joined.select(F.col("k").alias(new.key), action.alias("action")).filter("action IS NOT NULL")
    return Changes(found, compared, joined.count())


def _few(blocks: DataFrame, most: int = 1024) -> list[int] | None:
    """The numbers of the blocks where there are few of them."""
    found = blocks.limit(most + 1).collect()
    return [r[0] for r in found] if len(found) <= most else None
