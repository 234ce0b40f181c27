"""Full-hash scans: a listing, what the cache knows of it, and digests of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import digest
from ..functions.expr import total_chunks
from .reconcile import KEY, cached_hashes


def hashed_scan(listing: DataFrame, cache: DataFrame, contents: DataFrame, chunk_size: int, workers: int | None = None, algorithm: str = "sha256", content: str = "content") -> DataFrame:
    """``listing``'s files with file_hash, total_chunks and cached (whether the cache had it).

    Only contents (relative_path, ``content``) of misses are read and digested, in ``workers`` partitions if given, so no
    more than that are in work at once. Symlinks of the listing (kind) stay without a digest; other kinds go."""
    files = listing.filter("kind = 'File'")
    found = cached_hashes(files, cache, chunk_size)
    misses = found.filter("cached_hash is null").select(KEY)
    read = contents.join(misses, KEY, "left_semi")
    if workers:
        read = read.repartition(workers)
    made = read.select(KEY, digest(F.col(content), algorithm).alias("_made"))
    names = [F.col(f"`{c}`") for c in listing.columns if c not in ("file_hash", "total_chunks", "cached")]
    hashed = found.join(made, KEY, "left").select(
        *names, F.coalesce("cached_hash", "_made").alias("file_hash"), total_chunks(F.col("size"), chunk_size).alias("total_chunks"), F.col("cached_hash").isNotNull().alias("cached")
    )
    links = listing.filter("kind = 'Symlink'").select(*names, F.lit(None).cast("string").alias("file_hash"), F.lit(0).cast("long").alias("total_chunks"), F.lit(False).alias("cached"))
    return hashed.unionByName(links)


def scan_stats(scan: DataFrame) -> DataFrame:
    """One row: files, links, bytes of files, and how many digests came from the cache and how many were made."""
    file = F.col("kind") == "File"
    return scan.agg(
        F.count_if(file).alias("files"), F.count_if(~file).alias("links"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.count_if(file & F.col("cached")).alias("from_cache"), F.count_if(file & ~F.col("cached")).alias("hashed"),
    )
