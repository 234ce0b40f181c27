"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long); label is the same throughout a component.

    Each round every node points to the least of itself and its neighbours, pointers
    are followed to their roots by doubling, so a path of any length takes one round,
    and edges are carried over to the roots of their ends; loops and repeats go. Only
    counts come to the driver. Minima are pre-aggregated and joins are by equality,
    so a hub with many neighbours is split like any skewed key.
    """
    edges = stored(edges.filter("a != b").select("a", "b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("parent")), "parents")
        parent = _rooted(parent)
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            step = parent.select(F.col("node").alias("label"), "parent")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        labels = stored(labels, "labels")
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(left, "a").join(right, "b").filter("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        edges = stored(edges, "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def _rooted(parent: DataFrame) -> DataFrame:
    """(node, parent) with every pointer followed to its root; each pass doubles the steps taken."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        met = stored(parent.join(up, "parent").select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved")), "jumped")
        parent = met.select("node", "parent")
        if not met.filter("moved").limit(1).count():
            return parent
