"""Chunks of files, offsets in payloads, ordered digests, size classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import compressed, decoded
from ..functions.expr import total_chunks
from ..functions.frames import ChunkPackets, packet
from ..scratch import stored


def chunk_ranges(df: DataFrame, chunk: int, size: str = "size", first: Column | None = None) -> DataFrame:
    """A row for each chunk: df + chunk_index, offset, length; the last one is short, an empty file has none."""
    n = total_chunks(F.col(size), chunk)
    start = F.lit(0).cast("long") if first is None else first
    index = F.when(start < n, F.sequence(start, n - 1)).otherwise(F.array().cast("array<long>"))
    out = df.withColumn("chunk_index", F.explode(index))
    offset = F.col("chunk_index") * chunk
    return out.withColumn("offset", offset).withColumn("length", F.least(F.lit(chunk).cast("long"), F.col(size) - offset))


def chunk_contents(df: DataFrame, chunk: int, content: str = "content", size: str = "size") -> DataFrame:
    """chunk_ranges with the chunk's bytes as ``data`` and its digest."""
    out = chunk_ranges(df, chunk, size)
    data = F.substring(content, (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return out.withColumn("data", data).drop(content).withColumn("digest", F.sha2("data", 256))


def ordered_digest(chunks: DataFrame, key: str = "relative_path", index: str = "chunk_index", data: str = "data") -> DataFrame:
    """Digest of each file from its chunks in order: (key, file_hash)."""
    parts = F.array_sort(F.collect_list(F.struct(index, data)))
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x[data]))
    return chunks.groupBy(key).agg(F.sha2(whole, 256).alias("file_hash"))


def tree_digest(chunks: DataFrame, key: str = "relative_path", index: str = "chunk_index", data: str = "data", fanout: int = 1024) -> DataFrame:
    """Digest of each file as the root of a tree over its chunks: (key, tree_hash).

    A leaf is SHA-256 of a zero byte and the chunk, a node that of a one byte and its children's digests, up to ``fanout`` of
    them in order; a level of one node is the root, so a file's digest depends on its own chunks alone. Leaves are digested
    where the chunks are and stored; each level is one aggregation of 64 characters a child by (key, node), so a file of any
    length is many tasks' work and no row holds more than ``fanout`` digests. Chunks may come in any order; one that is
    missing between others or comes twice fails the query. A file without chunks has no row."""
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.col(data)), 256)
    at, one = F.col(index).cast("long"), F.lit(1).cast("long")
    level = stored(chunks.select(F.col(key).alias("key"), at.alias("at"), leaf.alias("digest"), one.alias("leaves"), at.alias("last")), "leaves")
    most = level.agg(F.max("at")).first()[0] or 0
    failed = F.raise_error(F.lit("a chunk is missing or comes twice"))
    while True:
        node = F.call_function("div", F.col("at"), F.lit(fanout).cast("long")).alias("node")
        parts = level.groupBy("key", node).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("parts"), F.sum("leaves").alias("leaves"), F.max("last").alias("last"))
        first, n = F.col("node") * fanout, F.size("parts")
        whole = F.transform("parts", lambda p: p["at"]) == F.sequence(first, first + n - 1)
        joined = F.sha2(F.unhex(F.concat(F.lit("01"), F.array_join(F.transform("parts", lambda p: p["digest"]), ""))), 256)
        made = F.when(~whole, failed).when((first == 0) & (n == 1), F.col("parts")[0]["digest"]).otherwise(joined)
        level = parts.select("key", F.col("node").alias("at"), made.alias("digest"), "leaves", "last")
        if most < fanout:
            break
        most //= fanout
    level = level.withColumn("digest", F.when(F.col("leaves") == F.col("last") + 1, F.col("digest")).otherwise(failed))
    return level.select(F.col("key").alias(key), F.col("digest").alias("tree_hash"))


def payload_offsets(df: DataFrame, batch: str = "batch_id", pos: str = "pos", length: str = "data_len") -> DataFrame:
    """df + data_offset: where each row's bytes begin in its batch's payload."""
    before = Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("data_offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def split_payload(df: DataFrame, payload: str = "payload", length: str = "data_len", **keys: str) -> DataFrame:
    """payload_offsets with each row's bytes as ``data``; a payload of another length fails the query."""
    batch, pos = keys.get("batch", "batch_id"), keys.get("pos", "pos")
    out = payload_offsets(df, batch, pos, length)
    whole = F.sum(length).over(Window.partitionBy(batch))
    data = F.substring(payload, (F.col("data_offset") + 1).cast("int"), F.col(length).cast("int"))
    return out.withColumn("data", F.when(whole == F.octet_length(payload), data).otherwise(F.raise_error(F.lit("payload length differs from its parts")).cast("binary"))).drop(payload)


def is_small(size: Column, chunks: Column, small_max: int, chunk: int) -> Column:
    """One chunk, and within both limits; an empty file has no chunk and is not small."""
    return (chunks == 1) & (size <= small_max) & (size <= chunk)


def is_direct(size: Column, next_chunk: Column, direct_max: int) -> Column:
    return (next_chunk == 0) & (size <= direct_max)


def routed(df: DataFrame, small_max: int, direct_max: int, chunk: int) -> DataFrame:
    """df + route: small, direct or streamed."""
    small = is_small(F.col("size"), F.col("total_chunks"), small_max, chunk) & (F.col("next_chunk") == 0)
    route = F.when(small, "small").when(is_direct(F.col("size"), F.col("next_chunk"), direct_max), "direct").otherwise("streamed")
    return df.withColumn("route", route)


def size_checked(df: DataFrame, read: str = "read_len", size: str = "size") -> DataFrame:
    """df + size_changed, for files whose length on reading is not the manifest's."""
    return df.withColumn("size_changed", F.col(read) != F.col(size))


def packet_batches(pieces: DataFrame, level: int, key: str = "relative_path") -> DataFrame:
    """Of each file its chunks (chunk_index, length, data) as one batch of packets, compressed where that saves something: (key, batch, n)."""
    made = pieces.select(key, "chunk_index", "length", compressed(F.col("data"), level).alias("z"))
    one = F.struct("chunk_index", packet(F.col("length"), F.col("z.compressed"), F.col("z.data")).alias("p"))
    whole = F.aggregate(F.array_sort(F.collect_list(one)), F.lit(b""), lambda a, x: F.concat(a, x["p"]))
    return made.groupBy(key).agg(whole.alias("batch"), F.count("*").cast("int").alias("n"))


def packet_contents(batches: DataFrame, key: str = "relative_path") -> DataFrame:
    """The chunks of packet batches (key, chunk_index, raw_len, content), checked: no byte is left over, no packet lacks, lengths are as told."""
    out = batches.lateralJoin(ChunkPackets(F.col("batch").outer(), F.col("n").outer()))
    return out.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "raw_len", decoded(F.col("data"), F.col("compressed"), F.col("raw_len")).alias("content"))
