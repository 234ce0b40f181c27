"""Reconciliation plans: what to do with every path of two keyed snapshots.

All are equi-joins on the path followed by one CASE; the engine picks broadcast
or sort-merge by size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import is_quick_token, parsed_token
from ..names import column, fresh

KEY = "relative_path"


def _side(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """A join side whose other columns carry a prefix, so that names never clash."""
    return df.select(KEY, *(F.col(c).alias(f"{prefix}_{c}") for c in columns), F.lit(True).alias(f"in_{prefix}"))


def complete_match(token: Column, size: Column, done_hash: Column, done_size: Column, done_mtime: Column) -> Column:
    """Whether a ledger row proves a file up to date: by token size and time, else by digest and size."""
    parsed = parsed_token(token)
    by_token = (done_size == size) & (parsed["size"] == size) & (done_mtime == parsed["mtime"])
    return F.coalesce(F.when(parsed.isNotNull(), by_token).otherwise((done_hash == token) & (done_size == size)), F.lit(False))


def push_plan(
    manifest: DataFrame, complete: DataFrame, partial: DataFrame | None = None, on_disk: DataFrame | None = None, destination: DataFrame | None = None,
    chunk_size: int = 1 << 20, resume: bool = True, update_only: bool = False, compat: bool = False,
) -> DataFrame:
    """manifest + action (SKIP, UPLOAD), next_chunk, metadata_sync_required, message.

    manifest: relative_path, size, mode, mtime_sec, file_hash, total_chunks, xattr_sig.
    The ledger decides, not the destination; ``update_only`` looks at the destination first.
    ``compat`` resumes from chunks on disk even where the partial row is of other content;
    by default they count only if it is the same.
    """
    df = manifest.join(_side(complete, "done", "file_hash", "size", "mode", "mtime_sec", "xattr_sig"), KEY, "left")
    if partial is not None:
        df = df.join(_side(partial, "part", "file_hash", "size", "chunk_size", "completed_chunks"), KEY, "left")
    if on_disk is not None:
        df = df.join(_side(on_disk, "disk", "size"), KEY, "left")
    newer = F.lit(False)
    if update_only and destination is not None:
        df = df.join(_side(destination, "dst", "mtime_sec"), KEY, "left")
        newer = F.coalesce(F.col("dst_mtime_sec") > F.col("mtime_sec"), F.lit(False))
    matches = F.col("in_done").isNotNull() & complete_match(F.col("file_hash"), F.col("size"), F.col("done_file_hash"), F.col("done_size"), F.col("done_mtime_sec"))
    none = F.lit(0).cast("long")
    same = none.isNull()
    if partial is not None:
        same = F.coalesce((F.col("part_file_hash") == F.col("file_hash")) & (F.col("part_size") == F.col("size")) & (F.col("part_chunk_size") == chunk_size), F.lit(False))
        recorded = F.when(same, F.least("part_completed_chunks", "total_chunks")).otherwise(none)
    else:
        recorded = none
    if on_disk is not None:
        kept = F.when(F.col("disk_size") <= F.col("size"), F.least(F.call_function("div", F.col("disk_size"), F.lit(chunk_size)), F.col("total_chunks")))
        if not compat:
            kept = F.when(same, kept)
        recorded = F.greatest(recorded, F.coalesce(kept, none))
    next_chunk = recorded if resume else none
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"done_{c}"))
    action = F.when(newer | matches, "SKIP").otherwise("UPLOAD")
    out = df.withColumn("action", action)
    chunk = F.when(F.col("action") == "SKIP", F.col("total_chunks")).otherwise(next_chunk).cast("long")
    message = (
        F.when(newer, F.concat(F.lit("destination is newer (dst_mtime="), F.col("dst_mtime_sec") if update_only and destination is not None else F.lit(""), F.lit(" src_mtime="), F.col("mtime_sec"), F.lit(")")))
        .when(matches, "already up to date").when(chunk > 0, F.concat(F.lit("resuming at chunk "), chunk)).otherwise("starting upload")
    )
    sync = F.when(newer, False).when(matches, differs("mode") | differs("mtime_sec") | differs("xattr_sig")).otherwise(False)
    return out.select(*[F.col(c) for c in manifest.columns], "action", chunk.alias("next_chunk"), sync.alias("metadata_sync_required"), message.alias("message"))


def compare_plan(source: DataFrame, destination: DataFrame, update_only: bool = False) -> DataFrame:
    """Local copy and pull: source + action (COPY, SKIP) against what really is at the destination."""
    df = source.join(_side(destination, "dst", "size", "mtime_sec"), KEY, "left")
    if update_only:
        skip = F.col("dst_mtime_sec") >= F.col("mtime_sec")
    else:
        skip = (F.col("dst_size") == F.col("size")) & (F.col("dst_mtime_sec") == F.col("mtime_sec"))
    return df.select(*[F.col(c) for c in source.columns], F.when(skip, "SKIP").otherwise("COPY").alias("action"))


def symlink_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Symlinks: skipped if the link is there with the same target and time, else replaced or created."""
    df = source.join(_side(destination, "dst", "target", "mtime_sec"), KEY, "left")
    same = (F.col("dst_target") == F.col("target")) & (F.col("dst_mtime_sec") == F.col("mtime_sec"))
    action = F.when(same, "SKIP").when(F.col("in_dst").isNotNull(), "REPLACE_LINK").otherwise("CREATE_LINK")
    return df.select(*[F.col(c) for c in source.columns], action.alias("action"))


def five_way_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """One full outer join: NEW, UPLOAD (size or time), META (mode), SKIP, DELETE for every path of either side."""
    df = _side(source, "src", "size", "mtime_sec", "mode").join(_side(destination, "dst", "size", "mtime_sec", "mode"), KEY, "full_outer")
    action = (
        F.when(F.col("in_dst").isNull(), "NEW").when(F.col("in_src").isNull(), "DELETE")
        .when((F.col("src_size") != F.col("dst_size")) | (F.col("src_mtime_sec") != F.col("dst_mtime_sec")), "UPLOAD")
        .when(F.col("src_mode") != F.col("dst_mode"), "META").otherwise("SKIP")
    )
    return df.select(KEY, action.alias("action"), F.col("src_size").alias("src_size"), F.col("dst_size").alias("dst_size"))


def metadata_plan(entries: DataFrame, complete: DataFrame, destination: DataFrame, preserve: bool = True) -> DataFrame:
    """Whether metadata alone may be set: entries + accepted, skipped, message, by checks in a fixed order.

    destination: relative_path, size, mtime_sec, is_file."""
    df = entries.join(_side(complete, "done", "file_hash", "size", "mtime_sec"), KEY, "left").join(_side(destination, "dst", "size", "mtime_sec", "is_file"), KEY, "left")
    matches = F.col("in_done").isNotNull() & complete_match(F.col("file_hash"), F.col("size"), F.col("done_file_hash"), F.col("done_size"), F.col("done_mtime_sec"))
    quick = is_quick_token(F.col("file_hash"))
    say = lambda what, a, b: F.concat(F.lit(f"destination {what} mismatch: expected "), a, F.lit(" got "), b)
    refused = (
        F.when(F.col("in_dst").isNull(), "destination missing").when(~F.col("dst_is_file"), "destination is not a regular file")
        .when(~matches & ~quick, "state mismatch; file no longer complete for hash/size")
        .when(F.col("dst_size") != F.col("size"), say("size", F.col("size"), F.col("dst_size")))
        .when(quick & (F.col("dst_mtime_sec") != F.col("mtime_sec")), say("mtime", F.col("mtime_sec"), F.col("dst_mtime_sec")))
    )
    done = F.lit("metadata updated" if preserve else "metadata preservation disabled")
    return df.select(*[F.col(c) for c in entries.columns], refused.isNull().alias("accepted"), (refused.isNull() & F.lit(not preserve)).alias("skipped"), F.coalesce(refused, done).alias("message"))


def delete_plan(destination: DataFrame, keep: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Destination paths to delete: allowed by filter and rights, and not kept. Paths filtered out are protected."""
    df = destination if allowed is None else destination.filter(allowed)
    return df.join(keep.select(KEY), KEY, "left_anti")


def cached_hashes(manifest: DataFrame, cache: DataFrame, chunk_size: int) -> DataFrame:
    """manifest + cached_hash where the cache has the path with equal size and time; a cache of another chunk size is ignored."""
    side = _side(cache.filter(F.col("chunk_size") == chunk_size), "hit", "size", "mtime_sec", "file_hash")
    hit = (F.col("hit_size") == F.col("size")) & (F.col("hit_mtime_sec") == F.col("mtime_sec"))
    return manifest.join(side, KEY, "left").select(*[F.col(c) for c in manifest.columns], F.when(hit, F.col("hit_file_hash")).alias("cached_hash"))


def first_of(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key, in the order in which ``df`` comes."""
    rest, (at, r) = [column(c) for c in df.columns if c != key], fresh(df, "at", "r")
    return df.withColumn(at, F.monotonically_increasing_id()).groupBy(column(key)).agg(F.min_by(F.struct(*rest), at).alias(r)).select(column(key), f"{r}.*")


def authorized(connections: DataFrame, policy: DataFrame) -> DataFrame:
    """connections (fingerprint_sha256) + client_id, allowed_prefixes, accepted, reason; of several policy rows of a fingerprint the first counts."""
    side = first_of(policy.select("fingerprint_sha256", "client_id", "allowed_prefixes", "revoked"), "fingerprint_sha256").withColumn("_known", F.lit(True))
    reason = F.when(F.col("fingerprint_sha256").isNull(), "no certificate").when(F.col("_known").isNull(), "unknown certificate").when(F.col("revoked"), "revoked")
    return connections.join(side, "fingerprint_sha256", "left").withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_known", "revoked")


def named_profiles(asked: DataFrame, store: DataFrame, strict: bool = True) -> DataFrame:
    """Profiles by name: ``asked`` (name) with the columns of the first such row of ``store``; a name without one
    fails the query, or with ``strict=False`` has an error."""
    found = asked.join(first_of(store, "name").withColumn("_known", F.lit(True)), "name", "left")
    missing = F.when(F.col("_known").isNull(), F.concat(F.lit("profile '"), F.col("name"), F.lit("' not found")))
    if not strict:
        return found.withColumn("error", missing).drop("_known")
    return found.filter(F.when(missing.isNotNull(), F.raise_error(missing).cast("boolean")).otherwise(True)).drop("_known")


def stale_xattrs(files: DataFrame, current: str = "current", desired: str = "desired") -> DataFrame:
    """``files`` + stale: names of attributes (arrays of struct with a name) that are there and no longer wanted, in order."""
    names = lambda c: F.transform(c, lambda x: x["name"])
    return files.withColumn("stale", F.array_sort(F.array_except(names(F.col(current)), names(F.col(desired)))))


def init_requests(manifest: DataFrame, chunk_size: int, update_only: bool = False, resume: bool = True, xattrs: bool = False) -> DataFrame:
    """What a sender tells of each file before sending: identity, chunks, and the attributes' signature if these are kept."""
    sig = F.col("xattr_sig") if xattrs else F.lit(None).cast("string")
    return manifest.select(
        KEY, "size", "mode", "mtime_sec", sig.alias("xattr_sig"), F.lit(update_only).alias("update_only"), "file_hash", F.lit(chunk_size).cast("long").alias("chunk_size"), "total_chunks", F.lit(resume).alias("resume")
    )


NO_XATTRS = "array<struct<name:string,value:binary>>"


def metadata_entries(plan: DataFrame, xattrs: bool = False) -> DataFrame:
    """The metadata alone of files whose plan asks for it (metadata_sync_required)."""
    kept = F.col("xattrs") if xattrs else F.array().cast(NO_XATTRS)
    return plan.filter("metadata_sync_required").select(KEY, "size", "file_hash", "mode", "mtime_sec", "uid", "gid", kept.alias("xattrs"))


def late_digests(plan: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """``plan`` with quick tokens of the files to be uploaded replaced by digests: only their contents (relative_path, ``content``) are read."""
    pending = (F.col("action") == "UPLOAD") & is_quick_token(F.col("file_hash"))
    names = [F.when(F.col("_hash").isNotNull(), F.col("_hash")).otherwise(F.col("file_hash")).alias("file_hash") if c == "file_hash" else F.col(f"`{c}`") for c in plan.columns]
    made = contents.join(plan.filter(pending).select(KEY), KEY, "left_semi").select(KEY, F.sha2(content, 256).alias("_hash"))
    return plan.join(made, KEY, "left").select(*names)


def zipped(requests: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("batch_id", "pos")) -> DataFrame:
    """Requests with their results by position; a row without its counterpart fails the query."""
    both = requests.withColumn("_r", F.lit(1)).join(results.withColumn("_s", F.lit(1)), list(keys), "full_outer")
    checked = F.when(F.col("_r").isNull() | F.col("_s").isNull(), F.raise_error(F.lit("request and result counts differ")).cast("int")).otherwise(1)
    return both.withColumn("_ok", checked).filter("_ok = 1").drop("_r", "_s", "_ok")
