"""Joins with a table of known group sizes, in which no group is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_size(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (stored, one row for each key; ``size``: how many of ``rows`` have it), without other keys.

    Groups beyond a quarter of a task's share are no more than four for each shuffle
    partition, whatever the input, so these go by broadcast and the others by shuffle.
    """
    spark = rows.sparkSession
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cut = max(1, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot, rest = table.filter(F.col(size) > cut), table.filter(F.col(size) <= cut)
    if not hot.limit(1).count():
        return rows.join(table, key)
    spread = rows.join(F.broadcast(hot), key)
    return spread.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
