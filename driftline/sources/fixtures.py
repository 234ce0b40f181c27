"""Snapshot views over the star-schema tables: manifests, ledgers, caches, frames, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import total_chunks
from ..session import ship

CHUNK = 4096


class Tables:
    """The tables of one folder, and views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def manifest(self, content: bool = False) -> DataFrame:
        """Documents as files."""
        size = F.octet_length("text").cast("long")
        doc = F.col("doc_id")
        df = self.documents.select(
            doc.alias("k"), F.concat_ws("/", "source", "lang", F.concat(doc.cast("string"), F.lit(".txt"))).alias("relative_path"), size.alias("size"), F.lit(33188).cast("long").alias("mode"),
            (F.lit(1700000000) + doc * 60).cast("long").alias("mtime_sec"), (F.lit(1000) + doc % 3).cast("long").alias("uid"), F.lit(1000).cast("long").alias("gid"),
            F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), total_chunks(size, CHUNK).alias("total_chunks"), *([F.col("text").cast("binary").alias("content")] if content else []),
        )
        return df

    def source(self) -> DataFrame:
        return self.manifest().withColumn("xattr_sig", F.lit(None).cast("string"))

    def destination(self) -> DataFrame:
        """The manifest with one kind of difference for each last digit of the id, and files of its own."""
        k = F.col("k") % 10
        changed = self.manifest().filter(k != 0).select(
            "relative_path", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 4, 33261).otherwise(F.col("mode")).cast("long").alias("mode"),
            F.when(k == 2, F.col("mtime_sec") - 5).when(k == 3, F.col("mtime_sec") + 5).otherwise(F.col("mtime_sec")).alias("mtime_sec"),
        )
        extra = self.pages.select(F.format_string("extra/%d.html", "page_id").alias("relative_path"), F.octet_length("html").cast("long").alias("size"), F.lit(33188).cast("long").alias("mode"), (F.lit(1700000000) + F.col("page_id")).cast("long").alias("mtime_sec"))
        return changed.unionByName(extra)

    def complete(self) -> DataFrame:
        k = F.col("k") % 10
        return self.manifest().filter(k >= 4).select("relative_path", "file_hash", "size", "mode", "mtime_sec", F.when(k == 6, F.lit("00000000000000aa")).alias("xattr_sig"), "total_chunks", F.lit(1700000000).cast("long").alias("updated_at_sec"))

    def partial(self) -> DataFrame:
        k = F.col("k") % 10
        return self.manifest().filter(k.between(1, 3)).select(
            "relative_path", F.when(k == 3, F.lit("other")).otherwise(F.col("file_hash")).alias("file_hash"), "size", F.lit(CHUNK).cast("long").alias("chunk_size"), "total_chunks",
            F.call_function("div", F.col("total_chunks"), F.lit(2)).cast("long").alias("completed_chunks"), F.lit(1700000000).cast("long").alias("updated_at_sec"),
        )

    def on_disk(self) -> DataFrame:
        k = F.col("k") % 10
        return self.manifest().filter(k.between(1, 3)).select("relative_path", F.when(k == 2, F.col("size") + 10).otherwise(F.col("size") - F.col("size") % 7).cast("long").alias("size"))

    def cache(self) -> DataFrame:
        return self.manifest().filter("k % 10 < 8").select("relative_path", "size", F.when(F.col("k") % 10 == 2, F.col("mtime_sec") - 1).otherwise(F.col("mtime_sec")).alias("mtime_sec"), "file_hash", "total_chunks", F.lit(CHUNK).cast("long").alias("chunk_size"))

    def symlinks(self, at_destination: bool = False) -> DataFrame:
        n = F.col("n_nationkey")
        df = self.nation.select(
            n.alias("n"), F.concat(F.lit("links/"), "n_name").alias("relative_path"), F.format_string("../src%d", "n_regionkey").alias("target"), (F.lit(1700000000) + n).cast("long").alias("mtime_sec"),
            F.lit(41471).cast("long").alias("mode"), F.lit(1000).cast("long").alias("uid"), F.lit(1000).cast("long").alias("gid"), F.lit("Symlink").alias("kind"), F.lit(0).cast("long").alias("size"),
        )
        if at_destination:
            df = df.filter("n % 4 != 0").withColumn("target", F.when(F.col("n") % 4 == 1, F.lit("elsewhere")).otherwise(F.col("target"))).withColumn("mtime_sec", F.when(F.col("n") % 4 == 2, F.col("mtime_sec") + 1).otherwise(F.col("mtime_sec")))
        return df.drop("n")

    def policy(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_name").alias("client_id"), F.sha2(F.col("s_name").cast("binary"), 256).alias("fingerprint_sha256"), F.array(F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string"))).alias("allowed_prefixes"),
            (F.col("s_acctbal") < 0).alias("revoked"),
        )

    def upload_events(self) -> DataFrame:
        """Uploads by user in order of time: an init for each user's first event, then chunks in, before and out of turn."""
        from pyspark.sql import Window

        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(
            F.col("user_id").cast("string").alias("key"), F.row_number().over(order).cast("long").alias("seq"), F.when(F.row_number().over(order) == 1, "init").otherwise("chunk").alias("event"),
            F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("event_id") % 4).cast("long").alias("start_chunk"), F.lit(1).cast("long").alias("sent_chunks"), F.lit(4).cast("long").alias("total_chunks"),
            (F.col("event_id") % 4 == 3).alias("finalize"), F.lit(100).cast("long").alias("bytes"),
        )


#: The same views for DuckDB, as common table expressions.
SQL = """manifest AS (
  SELECT doc_id AS k, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path, strlen(text)::BIGINT AS size, 33188::BIGINT AS mode,
    (1700000000 + doc_id * 60)::BIGINT AS mtime_sec, (1000 + doc_id % 3)::BIGINT AS uid, 1000::BIGINT AS gid, sha256(text) AS file_hash,
    ((strlen(text) + 4095) // 4096)::BIGINT AS total_chunks, NULL::VARCHAR AS xattr_sig, text FROM documents
), destination AS (
  SELECT relative_path, CASE WHEN k % 10 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN k % 10 = 4 THEN 33261 ELSE mode END::BIGINT AS mode,
    CASE k % 10 WHEN 2 THEN mtime_sec - 5 WHEN 3 THEN mtime_sec + 5 ELSE mtime_sec END AS mtime_sec FROM manifest WHERE k % 10 <> 0
  UNION ALL SELECT 'extra/' || page_id || '.html', strlen(html)::BIGINT, 33188::BIGINT, (1700000000 + page_id)::BIGINT FROM pages
), complete AS (
  SELECT relative_path, file_hash, size, mode, mtime_sec, CASE WHEN k % 10 = 6 THEN '00000000000000aa' END AS xattr_sig, total_chunks, 1700000000::BIGINT AS updated_at_sec FROM manifest WHERE k % 10 >= 4
), partial AS (
  SELECT relative_path, CASE WHEN k % 10 = 3 THEN 'other' ELSE file_hash END AS file_hash, size, 4096::BIGINT AS chunk_size, total_chunks, total_chunks // 2 AS completed_chunks, 1700000000::BIGINT AS updated_at_sec
  FROM manifest WHERE k % 10 BETWEEN 1 AND 3
), on_disk AS (
  SELECT relative_path, CASE WHEN k % 10 = 2 THEN size + 10 ELSE size - size % 7 END AS size FROM manifest WHERE k % 10 BETWEEN 1 AND 3
), cache AS (
  SELECT relative_path, size, CASE WHEN k % 10 = 2 THEN mtime_sec - 1 ELSE mtime_sec END AS mtime_sec, file_hash, total_chunks, 4096::BIGINT AS chunk_size FROM manifest WHERE k % 10 < 8
), symlinks AS (
  SELECT n_nationkey AS n, 'links/' || n_name AS relative_path, '../src' || n_regionkey AS target, (1700000000 + n_nationkey)::BIGINT AS mtime_sec, 41471::BIGINT AS mode, 1000::BIGINT AS uid, 1000::BIGINT AS gid, 'Symlink' AS kind, 0::BIGINT AS size FROM nation
), dst_links AS (
  SELECT relative_path, CASE WHEN n % 4 = 1 THEN 'elsewhere' ELSE target END AS target, CASE WHEN n % 4 = 2 THEN mtime_sec + 1 ELSE mtime_sec END AS mtime_sec FROM symlinks WHERE n % 4 <> 0
), policy AS (
  SELECT s_name AS client_id, sha256(s_name) AS fingerprint_sha256, ['src' || (s_suppkey % 20)] AS allowed_prefixes, s_acctbal < 0 AS revoked FROM supplier
)"""
