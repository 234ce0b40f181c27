"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and get the fractional rank
(rank + 1/2) / rows of the source. All rows are sorted by it and cut into runs
whose lengths differ by one at most (the ``rows`` law), so every shard holds
the corpus's mixture of sources within one row or so of each source.

Both ranks come in two levels, so no source and no shard is one task's work:
counts of buckets are summed up first, then rows are numbered inside buckets
of a few thousand rows. Buckets of the first level are prefixes of the
shuffling digest (of id and text), which is uniform, so a hot source fills its
buckets evenly.

Defined cases: null sources form one stratum of their own; null texts have no
bytes and crc32 0; repeated rows keep their number and take consecutive ranks;
ties of the digest (equal ids and texts) take any order among themselves; shards beyond the number
of rows stay empty; other input columns are carried along, and one that has a
result's name is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .names import with_plain_names

SEED = 20240607
BUCKET_ROWS = 4096
LAW = "rows"
FIELDS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", stratum: str = "source", seed: int = SEED) -> DataFrame:
    """``df`` without the text, with size, text_crc32, law, shard, slot and grown_shard (null under this law).

    A row's place depends on seed, key, text and the set of rows, not on partitions.
    """
    return with_plain_names(df, lambda d, n: _placed(d, shards, n[key], n[text], n[stratum], seed), (key, text, stratum), FIELDS)


def _placed(df: DataFrame, shards: int, key: str, text: str, stratum: str, seed: int) -> DataFrame:
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in df.columns if c not in FIELDS and c not in (text, key, stratum)]
    rows = df.select(
        F.col(key).alias("_key"),
        F.col(stratum).alias("_stratum"),
        F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("string").alias("_rest"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.xxhash64(body).cast("string")).cast("binary")).alias("_digest"),
    )
    rows = stored(rows, "sharding")
    total = rows.count()
    digits = max(1, math.ceil(math.log(max(total, 1) / BUCKET_ROWS, 16))) if total > BUCKET_ROWS else 0
    rows = rows.withColumn("_bucket", F.substring("_digest", 1, digits))
    by_bucket = rows.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
    # running sums over a stratum's buckets in two levels, by prefixes of half the digits
    by_bucket = by_bucket.withColumn("_prefix", F.substring("_bucket", 1, digits // 2))
    upto = lambda *keys: Window.partitionBy("_stratum", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_prefix = by_bucket.groupBy("_stratum", "_prefix").agg(F.sum("_n").alias("_pn"))
    by_prefix = by_prefix.select(
        F.col("_stratum").alias("_ps"), F.col("_prefix").alias("_pp"), F.coalesce(F.sum("_pn").over(upto("_prefix")), F.lit(0)).alias("_pbase"), F.sum("_pn").over(Window.partitionBy("_stratum")).alias("_of")
    )
    base = by_bucket.withColumn("_in", F.coalesce(F.sum("_n").over(upto("_prefix", "_bucket")), F.lit(0)))
    base = base.join(by_prefix, F.col("_stratum").eqNullSafe(F.col("_ps")) & (F.col("_prefix") == F.col("_pp")))
    base = base.select(F.col("_stratum").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_pbase") + F.col("_in")).alias("_base"), "_of")
    inside = Window.partitionBy("_stratum", "_bucket").orderBy("_digest", "text_crc32", "size")
    ranked = rows.withColumn("_rn", F.row_number().over(inside))
    ranked = ranked.join(base, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    # (rank + 1/2) / n as an exact fraction of 2^40ths: ties go by stratum and digest
    fraction = F.floor((2 * (F.col("_base") + F.col("_rn") - 1) + 1) * F.lit(float(1 << 39)) / F.col("_of")).cast("long")
    slots = max(1, total // BUCKET_ROWS)
    ranked = ranked.withColumn("_fraction", fraction).withColumn("_slot", F.floor(F.col("_fraction") / F.lit(float(1 << 40)) * slots).cast("long"))
    keep = ["_key", "_stratum", "_rest", "size", "text_crc32", "_digest", "_fraction", "_rn", "_slot"]
    ranked = stored(ranked.select(*keep), "sharding-ranked")
    by_slot = ranked.groupBy("_slot").agg(F.count("*").alias("_n"))
    # every BUCKET_ROWS rows make one row here; its running sum in two levels keeps even that off one task
    group = F.floor(F.col("_slot") / 4096)
    by_slot = by_slot.withColumn("_group", group)
    groups = by_slot.groupBy("_group").agg(F.sum("_n").alias("_gn")).withColumn("_gbase", F.coalesce(F.sum("_gn").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_group = Window.partitionBy("_group").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slot.withColumn("_in", F.coalesce(F.sum("_n").over(in_group), F.lit(0))).join(groups.select("_group", "_gbase"), "_group")
    starts = starts.select(F.col("_slot").alias("_at"), (F.col("_gbase") + F.col("_in")).alias("_start"))
    order = Window.partitionBy("_slot").orderBy("_fraction", "_stratum", "_digest", "text_crc32", "size", "_rn")
    placed = ranked.withColumn("_pos", F.row_number().over(order)).join(starts, F.col("_slot") == F.col("_at"))
    position = F.col("_start") + F.col("_pos") - 1
    short, longer = divmod(total, shards)
    edge = longer * (short + 1)
    which = F.when(position < edge, F.floor(position / (short + 1))).otherwise(longer + F.floor((position - edge) / max(short, 1)))
    first = F.when(F.col("shard") < longer, F.col("shard") * (short + 1)).otherwise(edge + (F.col("shard") - longer) * short)
    placed = placed.withColumn("_position", position).withColumn("shard", which.cast("int")).withColumn("slot", (F.col("_position") - first).cast("long"))
    return placed.select(
        F.col("_key").alias(key), F.col("_stratum").alias(stratum), *([f"_rest.`{c}`" for c in rest]),
        "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df`` as one folder for each shard, each file in slot order.

    ``key`` must identify rows. Rows are dealt by (shard, part of 65,536 slots), so a large shard is several files and tasks.
    """
    part = F.floor(F.col("slot") / 65536)
    joined = df.join(placed.select(key, "shard", "slot"), key).withColumn("part", part)
    joined.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.partitionBy("shard").parquet(path)
