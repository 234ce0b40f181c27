"""Tables in order: ranges as files, and row numbers and running sums over them without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import column
from ..scratch import bytes_of, new_path, stored

#: Stored bytes of a range, and the most ranges of a table (what is kept for each of them is a few numbers, 32 MB in all).
RANGE_BYTES, RANGES = 64 << 20, 1 << 20
#: A row's place is its range * 2^33 + its number in the range.
ROW_BITS = 33


def ordered(df: DataFrame, order: list[str], numbers: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """The rows of ``df`` sorted and stored: columns c0, c1 and so on, ``numbers`` as longs s0, s1 and so on (null: 0), and ``at``, their place.

    The plan of ``df`` runs once; how many ranges there are goes by the bytes that it has written. A range is one
    file of one row group, so a task reads it whole and in order, and what follows needs no shuffle."""
    spark = df.sparkSession
    own = [column(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    path = new_path(spark, "unordered")
    rows = stored(df.select(*own, *(F.coalesce(c, F.lit(0)).cast("long").alias(f"s{i}") for i, c in enumerate(numbers.values()))), "unordered", path)
    n = ranges or min(max(1, -(-bytes_of(spark, path) // RANGE_BYTES)), RANGES)
    keys = [f"c{df.columns.index(c)}" for c in order]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    return stored(dealt, "ordered", options={"parquet.block.size": str(1 << 30)})


def runs(batches: Iterator[pa.RecordBatch], expected: dict[int, int] | None = None) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(range, whether it begins here, rows) of an ordered table's batches, cut where one range ends and the next begins.

    Fails where rows of a range are missing, which is what a split file would look like."""
    now, due = None, 0
    for batch in batches:
        at = batch.column("at").to_numpy()
        part, row = at >> ROW_BITS, at & ((1 << ROW_BITS) - 1)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            begins = part[lo] != now
            now, due = part[lo], 0 if begins else due
            if row[lo] != due:
                raise RuntimeError(f"range {now} was not read as a whole")
            due += hi - lo
            yield int(now), bool(begins), batch.slice(lo, hi - lo)


def running(df: DataFrame, order: list[str], number: str = "row", **sums: Column) -> DataFrame:
    """``df`` + ``number`` (from 0, in order) and for each ``name=column`` the sum of that column over all rows before.

    Each range streams through one task, and of each only a count and sums come to the driver. Columns of ``df`` that have
    a result's name are replaced."""
    spark, results = df.sparkSession, [number, *sums]
    df = df.select(*[column(c) for c in df.columns if c.lower() not in {r.lower() for r in results} or c in order])
    table = ordered(df, order, sums)
    part = F.shiftrightunsigned("at", ROW_BITS)
    totals = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums)))).toArrow().sort_by("part")
    columns = [totals.column(i).to_numpy() for i in range(totals.num_columns)]
    bases = spark.sparkContext.broadcast((columns[0], [np.cumsum(c) - c for c in columns[1:]]))  # a few numbers for each of at most RANGES ranges
    fields = [f for f in df.schema.fields if f.name not in results]
    kept = [f"c{df.columns.index(f.name)}" for f in fields]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(kept, fields)), *(T.StructField(f"r{i}", T.LongType()) for i in range(len(results)))])

    def task(batches):
        parts, starts = bases.value
        now: list[int] = []
        for part, begins, rows in runs(batches):
            if begins:
                k = int(np.searchsorted(parts, part))
                now = [int(s[k]) for s in starts]
            made = []
            for i, base in enumerate(now):
                each = np.ones(rows.num_rows, np.int64) if i == 0 else rows.column(f"s{i - 1}").to_numpy()
                made.append(base + np.cumsum(each) - each)
                now[i] = base + int(each.sum())
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *map(pa.array, made)], names=schema.names)

    return table.select(*kept, *(f"s{i}" for i in range(len(sums))), "at").mapInArrow(task, schema).toDF(*[f.name for f in fields], *results)
