"""Summaries, medians and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import parent, write_concurrency


def manifest_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def filter_report(df: DataFrame, allowed: Column, would_delete: DataFrame | None = None) -> DataFrame:
    """One row: files kept and dropped by a filter, bytes kept, and what a delete would take."""
    out = df.agg(
        F.count_if(allowed).alias("files_kept"), F.count_if(~allowed).alias("files_dropped"), F.coalesce(F.sum(F.when(allowed, F.col("size"))), F.lit(0)).cast("long").alias("bytes_kept")
    )
    return out if would_delete is None else out.crossJoin(would_delete.agg(F.count("*").alias("would_delete")))  # one row each


def action_summary(plan: DataFrame, size: str = "size") -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def batch_report(batches: DataFrame) -> DataFrame:
    """Of each batch: rows, bytes, mean size and how many files to write at once."""
    out = batches.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
    mean = F.call_function("div", F.col("bytes"), F.col("files")).cast("long")
    return out.withColumn("mean_bytes", mean).withColumn("concurrency", write_concurrency(F.col("bytes"), F.col("files")))


def parents(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Folders that must be there."""
    return df.select(parent(F.col(path)).alias("parent")).filter("parent != ''").distinct()


def keep_count(keep: DataFrame, path: str = "relative_path") -> DataFrame:
    """How many distinct paths a keep set holds."""
    return keep.agg(F.count_distinct(path).alias("keep_paths"))


def client_status(policy: DataFrame) -> DataFrame:
    return policy.agg(F.count("*").alias("total"), F.count_if(~F.col("revoked")).alias("active"), F.count_if("revoked").alias("revoked"))


def written_by(results: DataFrame, connection: str = "connection") -> DataFrame:
    return results.groupBy(connection).agg(F.coalesce(F.sum("bytes_written"), F.lit(0)).cast("long").alias("bytes_written"))


def merged_results(results: DataFrame, count_skipped: bool) -> DataFrame:
    """Totals of upload results; the small path counts skipped rows' bytes too, the cold path does not."""
    counted = F.when(F.lit(count_skipped) | ~F.col("skipped"), F.col("bytes_written"))
    return results.agg(
        F.count_if(F.col("accepted") & ~F.col("skipped")).alias("transferred"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("accepted")).alias("rejected"),
        F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias("bytes"),
    )


def xor_digest(values: DataFrame, column: str = "value") -> DataFrame:
    return values.agg(F.coalesce(F.bit_xor(column), F.lit(0)).alias("digest"))


def medians(runs: DataFrame, spread: float = 0.002) -> DataFrame:
    """Exact median of each (transport, key) over runs; the mean of the two middle values where their number is even. Null values are left out.

    Sketches bracket the middle by ranks (their error is a tenth of ``spread``), so only values inside
    the bracket are sorted, and what lies below is counted: no group's values meet in one task."""
    by = ["transport", "key"]
    known = runs.filter(F.col("value").isNotNull())
    marks = F.percentile_approx("value", F.array(F.lit(0.5 - spread), F.lit(0.5 + spread)), F.lit(int(10 / spread)))
    ends = known.groupBy(*by).agg(marks.alias("m")).select(*by, F.col("m")[0].alias("low"), F.col("m")[1].alias("high"))
    df = known.join(F.broadcast(ends), by)  # a row for each group; groups are named in the gate's thresholds
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("low")).alias("below"))
    same = df.filter(F.col("value").between(F.col("low"), F.col("high"))).groupBy(*by, "value").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*by).orderBy("value"))
    ranked = same.withColumn("upto", upto).join(F.broadcast(counts), by).withColumn("last", F.col("below") + F.col("upto"))
    first = F.col("last") - F.col("times")  # ranks first ... last - 1 hold this value
    holds = lambda rank: (first <= rank) & (rank < F.col("last"))
    half = F.call_function("div", F.col("n"), F.lit(2))
    low, high = F.max(F.when(holds(F.call_function("div", F.col("n") - 1, F.lit(2))), F.col("value"))), F.max(F.when(holds(half), F.col("value")))
    return ranked.groupBy(*by).agg(((low + high) / 2).alias("median"))


def gate(medians_: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Of each threshold (transport, metric, ours, theirs, max_ratio): the ratio of two medians and whether it passes; a missing or zero median fails."""
    value = lambda name: medians_.select("transport", F.col("key").alias(name), F.col("median").alias(f"{name}_median"))
    df = thresholds.join(value("ours"), ["transport", "ours"], "left").join(value("theirs"), ["transport", "theirs"], "left")
    ratio = F.when(F.col("theirs_median") > 0, F.col("ours_median") / F.col("theirs_median"))
    return df.select("transport", "metric", "max_ratio", ratio.alias("ratio"), F.coalesce(ratio <= F.col("max_ratio"), F.lit(False)).alias("passed"))


def observed(df: DataFrame, name: str = "transfer") -> tuple[DataFrame, object]:
    """df that counts rows and bytes while a query runs, and the observation to read them from afterwards."""
    from pyspark.sql import Observation

    counters = Observation(name)
    return df.observe(counters, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), counters
