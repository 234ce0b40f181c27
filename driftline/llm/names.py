"""Column names of any kind: dots, clashes with an operator's own columns, names of its results."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame

from ..names import column, fresh

__all__ = ["column", "fresh", "with_plain_names"]


def with_plain_names(df: DataFrame, made: Callable[[DataFrame, dict[str, str]], DataFrame], used: Collection[str], results: Collection[str]) -> DataFrame:
    """What ``made`` does to ``df`` under names without dots or clashes (given as a dict), with the names put back.

    ``used``: the columns that it works on. Others that have the name of one of its ``results`` are left out, and so replaced."""
    kept = [c for c in df.columns if c not in results or c in used]
    names = [f"in{i}_" for i in range(len(kept))]
    out = made(df.select(*(column(c).alias(n) for c, n in zip(kept, names))), dict(zip(kept, names)))
    back = dict(zip(names, kept))
    return out.toDF(*(back.get(c, c) for c in out.columns))
