"""Readers of manifests, ledgers, caches, policies, profiles and keep lists, and their writers."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import sanitized
from ..plans.ledger import upsert

MANIFEST = "relative_path string, size long, mode long, mtime_sec long, uid long, gid long, file_hash string, total_chunks long"
COMPLETE = "relative_path string, file_hash string, size long, mode long, mtime_sec long, xattr_sig string, total_chunks long, updated_at_sec long"
PARTIAL = "relative_path string, file_hash string, size long, chunk_size long, total_chunks long, completed_chunks long, updated_at_sec long"
CACHE = "relative_path string, size long, mtime_sec long, file_hash string, total_chunks long, chunk_size long"
POLICY = "client_id string, fingerprint_sha256 string, allowed_prefixes array<string>, revoked boolean"
PROFILE = "name string, server string, server_name string, ca string, client_cert string, client_key string, ssh_target string, destination string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """Rows of JSON lines; a missing file is empty, a damaged one fails unless ``lenient``, which makes it empty too."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not lenient:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    try:  # a query on the column of bad rows alone is not allowed, so the others are counted along
        damaged = whole.agg(F.count("_bad"), *(F.count(F.col(f"`{c}`")) for c in whole.columns if c != "_bad")).first()[0]
    except PySparkException:
        damaged = 1
    return spark.createDataFrame([], schema) if damaged else whole.drop("_bad")


def read_document(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of one JSON document, from its array ``field``; a missing file is empty, a damaged one fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode(F.col(field)).alias("e")).select("e.*")


def write_document(df: DataFrame, path: str, field: str) -> None:
    """``df`` as one JSON document with the array ``field``, for stores that fit one row (policies, profiles)."""
    df.coalesce(1).agg(F.collect_list(F.struct(*df.columns)).alias(field)).write.mode("overwrite").json(path)


def upsert_profiles(store: DataFrame, rows: DataFrame) -> DataFrame:
    """A profile store after an upsert by name; an empty name fails the query."""
    named = F.when(F.trim("name") == "", F.raise_error(F.lit("profile name cannot be empty")).cast("string")).otherwise(F.col("name"))
    return upsert(store, rows.withColumn("name", named), key="name")


def cache_location(root: Column, override: Column, xdg: Column, home: Column) -> Column:
    """Where the hash cache of a tree lies: the override's folder, else XDG's, else the home folder's, else /tmp's; named by the root's digest."""
    base = F.coalesce(override, xdg, F.concat(home, F.lit("/.cache")), F.lit("/tmp/.cache"))
    return F.concat(base, F.lit("/driftline/"), F.sha2(root.cast("binary"), 256), F.lit("/hash-cache.json"))


def read_cache(spark: SparkSession, path: str, chunk_size: int) -> DataFrame:
    """The hash cache of one chunk size; unreadable or of another chunk size, it is empty."""
    return read_json(spark, path, CACHE, lenient=True).filter(F.col("chunk_size") == chunk_size)


def keep_list(lines: DataFrame, safe: bool = True, column: str = "value") -> DataFrame:
    """Paths of a text list: trimmed, blanks left out, and with ``safe`` sanitised; an unsafe line fails the query."""
    df = lines.select(F.trim(column).alias("line")).filter("line != ''")
    if not safe:
        return df.select(F.col("line").alias("relative_path")).distinct()
    path = F.coalesce(sanitized(F.col("line")), F.raise_error(F.concat(F.lit("unsafe path: "), F.col("line"))).cast("string"))
    return df.select(path.alias("relative_path")).distinct()


def write_manifest(df: DataFrame, path: str, cold: bool = False) -> None:
    """A manifest as JSON lines; ``cold`` keeps path, size, mode and time only, and says so."""
    if cold:
        df = df.select("relative_path", "size", "mode", "mtime_sec", F.lit(True).alias("cold_start"))
    df.write.mode("overwrite").json(path)


def manifest_document(df: DataFrame, root: str, chunk_size: int) -> DataFrame:
    """The whole manifest as one JSON document, for manifests that fit one row."""
    files = F.array_sort(F.collect_list(F.struct(*df.columns)))
    return df.agg(F.to_json(F.struct(F.lit(root).alias("root"), F.lit(chunk_size).alias("chunk_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), files.alias("files"))).alias("document"))


def write_cache(manifest: DataFrame, path: str, chunk_size: int) -> None:
    """The hash cache of a scan, in place of the one before: one row for each path, of several the last as they come."""
    rows = manifest.select("relative_path", "size", "mtime_sec", "file_hash", "total_chunks", F.lit(chunk_size).cast("long").alias("chunk_size"))
    upsert(rows.limit(0), rows).write.mode("overwrite").json(path)


def synthetic_paths(spark: SparkSession, n: int) -> DataFrame:
    """Paths of the benchmark tree, by number."""
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), F.format_string("root/%04d/group/%08d.bin", F.pmod(i, F.lit(10000)), i).alias("relative_path"))


def file_list(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files and symlinks by path, in byte order."""
    return files.unionByName(links, allowMissingColumns=True).orderBy("relative_path")


def applied_paths(df: DataFrame, column: str = "target") -> DataFrame:
    """Symlink rows; a missing target fails the query."""
    checked = F.coalesce(F.col(column), F.raise_error(F.lit("symlink without a target")).cast("string"))
    return df.filter("kind = 'Symlink'").withColumn(column, checked)
