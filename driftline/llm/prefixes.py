"""The trie of all conversations' prefixes, from their sorted order.

A conversation is the sequence of its turns' digests, 16 bytes each. Conversations
are sorted by range partitioning, copies too (by id), so no group of equal ones is
one task's work. ``lcp`` of a row is the number of turns that it shares with the row
before. The trie's shared nodes are the nodes of the Cartesian tree over these
numbers: the rows between the nearest smaller values on both sides of a position
share as many turns as its number says, and positions of equal numbers in the same
interval are one node.

Each task finds the intervals that lie inside its rows with a stack. What is left of
a block are its prefix and suffix minima, a falling and a rising run of numbers with
the sums of the rows between them, no more than twice the longest shared prefix.
Blocks of neighbours are joined FAN at a time by the same stack, level by level, until
one is left; what closes on the way is emitted. No level gathers rows.

All figures of a node are figures of its interval: its members, the least id, the
leaves (rows that the next one doesn't continue), the children (its positions, and
one more; rows that end there have none) and the sum S of the words of the turns that
each row but the first shares with the one before it. Of a subtree below depth d,
S - (members - 1) * words above d are the words that the trie saves. Depths without
a branch between a node and its parent are expanded from one of its members.

Rebuilding: the first h turns of conversation c - c mod GROUP, then c's own turns
after its first h, with h = crc32(decimal c) mod 4.

Defined cases: rows without a conv_id take no part; turns are ordered by number (null
first), ties by their digest; null role or text count as empty; repeated rows are
turns of their own; c mod GROUP is never negative; an empty table has no nodes (no
member could name the root); other columns are not carried. A conversation is one row
of 16 bytes and two numbers for each turn (its texts never are); the hash of the ids
that end at a node is sequential by definition, so it streams through one task, fed
with ready pieces of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import stored
from .skew import join_by_size

SIZE = 16
GROUP, HEADS = 20, 4
#: Blocks joined in one task, ids in a piece of text, rows of a batch that leaves a task.
FAN, PIECE, ROWS = 64, 1 << 14, 1 << 12
UNKNOWN = 1 << 62
EMPTY = hashlib.sha256(b"").hexdigest()
#: What tasks emit: rows, closed intervals, ids that end at a node, reduced blocks, and lcp across the edge of two blocks.
ROW, NODE, ENDS, BLOCK, EDGE = range(5)


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, turns): digests (hex) and words of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, seq binary, words array): each conversation with the head of its group's first one."""
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(group)), F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.filter(F.pmod("conv_id", F.lit(group)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    with_head = turns.withColumn("base", base).withColumn("h", h.cast("int")).join(first, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    whole = F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    made = with_head.select("conv_id", whole.alias("turns"))
    return made.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.words").alias("words"))


@dataclass(frozen=True)
class Part:
    """Neighbouring rows between two positions: start, number, least id, leaves, and words shared inside."""

    at: int
    n: int
    least: int
    leaves: int
    saved: int
    first: int  # turns of the first row
    last: int  # and of the last one

    def then(self, other: Part, saved: int = 0) -> Part:
        return Part(self.at, self.n + other.n, min(self.least, other.least), self.leaves + other.leaves, self.saved + saved + other.saved, self.first, other.last)


@dataclass(frozen=True)
class Item:
    """Positions of one lcp without a smaller one between them: the rows from the first to the last position, and those after it."""

    v: int
    branches: int  # positions whose row before goes on
    saved: int  # words shared at the positions
    closed: Part | None
    last: Part


class Stack:
    """Reduces a sequence of items; ``nodes`` gets (depth, depth of the parent, children, part) of what closes."""

    def __init__(self):
        self.fallen, self.items, self.nodes = [], [], []

    def push(self, item: Item) -> None:
        items = self.items
        while items and items[-1].v > item.v:
            top = items.pop()
            if not items:  # its left end lies in a block before
                self.fallen.append(top)
                break
            before = items[-1]
            inside = before.last if top.closed is None else before.last.then(top.closed)
            whole = inside.then(top.last, top.saved)
            children = 0 if whole.last == top.v else top.branches + 1
            self.nodes.append((top.v, max(before.v, item.v), children, whole))
            items[-1] = replace(before, last=whole)
        if items and items[-1].v == item.v:
            top = items[-1]
            closed = top.last if top.closed is None else top.closed.then(top.last)
            closed = closed if item.closed is None else closed.then(item.closed)
            items[-1] = Item(top.v, top.branches + item.branches, top.saved + item.saved, closed, item.last)
        else:
            items.append(item)

    def meet(self, v: int) -> None:
        """The row to come shares ``v`` turns with the last one, which is a leaf if that is not all of it."""
        top = self.items[-1]
        if v < top.last.last:
            self.items[-1] = replace(top, last=replace(top.last, leaves=top.last.leaves + 1))

    def left(self) -> list[Item]:
        return [*self.fallen, *self.items]

    def closed(self) -> list[dict]:
        made = [{"kind": NODE, "at": p.at, "conv_id": p.least, "d": d, "dp": dp, "n": p.n, "children": c, "leaves": p.leaves, "saved": p.saved, "ended": p.first == d} for d, dp, c, p in self.nodes]
        self.nodes = []
        return made


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from their beginning."""
    low, high = 0, min(len(a), len(b)) // SIZE
    if a[: high * SIZE] == b[: high * SIZE]:
        return high
    while high - low > 1:  # low turns agree, high do not
        middle = (low + high) // 2
        if a[: middle * SIZE] == b[: middle * SIZE]:
            low = middle
        else:
            high = middle
    return low


PARTS = [f"{p}_{f}" for p in ("closed", "last") for f in ("at", "n", "least", "leaves", "saved", "first", "last")]
ITEMS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("v", "branches", "saved", *PARTS)]))
SCHEMA = T.StructType(
    [T.StructField("kind", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("at", "conv_id", "lcp", "next_lcp", "d", "dp", "n", "children", "leaves", "saved", "part", "piece", "end")]
    + [T.StructField(n, T.BinaryType()) for n in ("seq", "tail")]
    + [T.StructField(n, T.BooleanType()) for n in ("ended", "whole")]
    + [T.StructField("words", T.ArrayType(T.LongType())), T.StructField("ids", T.StringType()), T.StructField("items", ITEMS)]
)


def _flat(item: Item) -> dict:
    out = {"v": item.v, "branches": item.branches, "saved": item.saved}
    for name, p in (("closed", item.closed), ("last", item.last)):
        out |= {f"{name}_{f.name}": p and getattr(p, f.name) for f in fields(Part)}
    return out


def _item(d: dict) -> Item:
    closed, last = (None if d[f"{p}_n"] is None else Part(**{f.name: d[f"{p}_{f.name}"] for f in fields(Part)}) for p in ("closed", "last"))
    return Item(d["v"], d["branches"], d["saved"], closed, last)


class Sender:
    """Gathers rows of SCHEMA into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def send(self, *rows: dict) -> Iterator[pa.RecordBatch]:
        self.rows += rows
        self.bytes += sum(2 * len(r.get("seq") or b"") + len(r.get("ids") or "") for r in rows)
        if len(self.rows) >= ROWS or self.bytes > 8 << 20:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.bytes = [], 0


class Run:
    """The ids of equal neighbours, in pieces of text. Of a run that may go on in another block no piece is ``whole``."""

    def __init__(self, part: int, seq: bytes, at_edge: bool):
        self.part, self.seq, self.at_edge, self.ids, self.pieces, self.n = part, seq, at_edge, [], 0, 0

    def piece(self, whole: bool = False) -> dict:
        made = {"kind": ENDS, "seq": hashlib.md5(self.seq).digest(), "part": self.part, "piece": self.pieces, "ids": ",".join(map(str, self.ids)), "whole": whole and not self.pieces and not self.at_edge}
        self.ids, self.pieces = [], self.pieces + 1
        return made

    def add(self, conv_id: int) -> list[dict]:
        out = [self.piece()] if len(self.ids) == PIECE else []
        self.ids.append(conv_id)
        self.n += 1
        return out


def _swept(schema: pa.Schema):
    """A task over one partition in order: its rows, closed intervals, ended ids, and what is left of the block."""

    def task(batches: Iterator[pa.RecordBatch]):
        part, out, stack = TaskContext.get().partitionId(), Sender(schema), Stack()
        first = row = run = None
        count = 0
        for batch in batches:
            for conv_id, seq, words in zip(*(c.to_pylist() for c in batch.columns)):
                upto, length = list(accumulate(words, initial=0)), len(words)
                new = {"kind": ROW, "at": (part << 33) | count, "conv_id": conv_id, "seq": seq, "words": upto}
                v, branches = UNKNOWN, 0
                if row is None:
                    first, run = new, Run(part, seq, True)
                else:
                    v, before = shared(row["seq"], seq), len(row["words"]) - 1
                    row["next_lcp"] = new["lcp"] = v
                    branches = int(before > v)
                    stack.meet(v)
                    if not v == before == length:
                        if run.n > 1 or run.at_edge or not branches:  # else the node has one row, whose id is at hand
                            yield from out.send(run.piece(whole=True))
                        run = Run(part, seq, False)
                    yield from out.send(row)
                stack.push(Item(v, branches, upto[v] if row else 0, None, Part(new["at"], 1, conv_id, 0, 0, length, length)))
                yield from out.send(*run.add(conv_id), *stack.closed())
                row, count = new, count + 1
        if row is not None:
            block = {"kind": BLOCK, "part": part, "seq": first["seq"], "words": first["words"], "at": first["at"], "tail": row["seq"], "end": row["at"]}
            yield from out.send(run.piece(), row, block | {"items": [_flat(i) for i in stack.left()]})
        yield from out.flush()

    return task


def _met(schema: pa.Schema, last: bool):
    """A task over blocks of neighbours: what closes between them, and one block of the rest. ``last``: they are all there is."""

    def task(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda b: b["part"])
        stack, found, before = Stack(), [], None
        for b in blocks:
            items = [_item(i) for i in b["items"]]
            if before is not None or last:
                v = -1 if before is None else shared(before["tail"], b["seq"])
                branches = 0 if before is None else int(len(before["tail"]) // SIZE > v)
                items[0] = replace(items[0], v=v, branches=branches, saved=b["words"][max(v, 0)])
                found.append({"kind": EDGE, "at": b["at"], "lcp": v})
                if before is not None:
                    found.append({"kind": EDGE, "at": before["end"], "next_lcp": v})
                    stack.meet(v)
            for item in items:
                stack.push(item)
            before = b
        if last:
            stack.meet(-1)
            stack.push(Item(-1, 0, 0, None, Part(0, 0, 0, 0, 0, 0, 0)))
            found.append({"kind": EDGE, "at": before["end"], "next_lcp": -1})
        else:
            own = {k: blocks[0][k] for k in ("kind", "seq", "words", "at")} | {k: before[k] for k in ("tail", "end")}
            found.append(own | {"part": blocks[0]["part"] // FAN, "items": [_flat(i) for i in stack.left()]})
        return pa.Table.from_pylist([*stack.closed(), *found], schema=schema)

    return task


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, ends) of pieces in order: one hash is fed at a time."""
    key, state = None, None
    give = lambda: pa.RecordBatch.from_pydict({"seq": pa.array([key], pa.binary()), "ends": [state.hexdigest()]})
    for batch in batches:
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if seq != key:
                if state:
                    yield give()
                key, state = seq, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield give()


def _ends(pieces: DataFrame) -> DataFrame:
    """(seq, ends): digest of an ended sequence, hash of its ids."""
    whole = pieces.filter("whole").select("seq", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    parts = pieces.filter("NOT whole").repartition("seq").sortWithinPartitions("seq", "part", "piece").select("seq", "ids")
    return whole.unionByName(parts.mapInArrow(_hashed, "seq binary, ends string"))


def _prefix(k) -> F.Column:
    return F.unhex(F.md5(F.substring("seq", F.lit(1), (k * SIZE).cast("int"))))


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of (conv_id, seq, words), one row a conversation: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    schema = to_arrow_schema(SCHEMA)
    sequences = stored(sequences, "conversations")  # range partitioning reads it twice
    in_order = sequences.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").select("conv_id", "seq", "words")
    swept = stored(in_order.mapInArrow(_swept(schema), SCHEMA), "swept")
    levels, blocks = [swept], swept.filter(F.col("kind") == BLOCK)
    highest = blocks.agg(F.max("part")).first()[0]
    while highest is not None:
        last = highest < FAN
        level = stored(blocks.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group").applyInArrow(_dropped(_met(schema, last)), SCHEMA), "level")
        levels.append(level)
        blocks, highest = level.filter(F.col("kind") == BLOCK), None if last else highest // FAN
    of_kind = lambda kind, columns, tables: _union([t.filter(F.col("kind") == kind).select(*columns) for t in tables])
    rows = of_kind(ROW, ("at", "conv_id", "seq", "words", "lcp", "next_lcp"), levels[:1])
    nodes = of_kind(NODE, ("at", "conv_id", "d", "dp", "n", "children", "leaves", "saved", "ended"), levels)
    edges = of_kind(EDGE, ("at", "lcp", "next_lcp"), levels[1:]) if levels[1:] else rows.select("at", "lcp", "next_lcp")
    edges = edges.groupBy("at").agg(F.max("lcp").alias("l"), F.max("next_lcp").alias("r"))
    open_ = "lcp IS NULL OR next_lcp IS NULL"
    joined = rows.filter(open_).join(edges, "at").withColumn("lcp", F.coalesce("lcp", "l")).withColumn("next_lcp", F.coalesce("next_lcp", "r")).drop("l", "r")
    every = rows.filter(f"NOT ({open_})").unionByName(joined)
    length, near = (F.size("words") - 1).cast("long"), F.greatest("lcp", "next_lcp")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = every.filter(length > near).select(
        "conv_id", "seq", "words", length.alias("d"), near.alias("dp"), one.alias("n"), none.alias("children"), one.alias("leaves"), none.alias("saved"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends"),
    )
    nodes = nodes.join(rows.select("at", "seq", "words"), "at").withColumn("key", _prefix(F.col("d")))
    ends = _ends(of_kind(ENDS, ("seq", "part", "piece", "ids", "whole"), levels[:1])).withColumnRenamed("seq", "key")
    nodes = stored(nodes.filter("ended").join(ends, "key", "left").unionByName(nodes.filter("NOT ended").withColumn("ends", F.lit(EMPTY))), "nodes")
    chains = alone.unionByName(nodes.select(alone.columns)).withColumn("parent", F.when(F.col("dp") >= 0, _prefix(F.col("dp"))))
    chains = stored(chains, "chains")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"), "children").withColumnRenamed("children", "size")
    tops = chains.filter("parent IS NULL").withColumn("above", F.lit(None).cast("long"))
    linked = join_by_size(chains.filter("parent IS NOT NULL"), parents, "parent", "size").drop("size").unionByName(tops)
    depth = linked.withColumn("depth", F.explode(F.sequence(F.col("dp") + 1, F.col("d"))))
    above = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("dp") + 1, F.col("above")).otherwise(F.col("conv_id"))
    words = F.when(F.col("depth") > 0, F.element_at("words", F.col("depth").cast("int"))).otherwise(0)
    at_end = F.col("depth") == F.col("d")
    return depth.select(
        "conv_id", "depth", above.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(at_end, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * words).alias("saved_tokens"), F.when(at_end, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )


def _dropped(task):
    return lambda table: task(table.drop_columns(["group"]))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def conversation_trie(df: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations of ``df`` (conv_id, turn, role, text)."""
    return trie(rebuilt(turns_of(df)))
