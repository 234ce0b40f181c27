"""A folder's files as one ordered stream of frames: start, chunks, end for each file, and done at last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import prefix_allowed
from ..functions.frames import encoded
from ..operators.ordering import running


def source_frames(files: DataFrame, chunk: int, allowed: Column | None = None, prefixes: Column | None = None, metadata_only: bool = False) -> DataFrame:
    """Frames (seq, frame_type, relative_path, kind, target, size, mode, mtime_sec, chunk_index, chunk_len, files, bytes) of ``files`` in byte order of paths.

    ``allowed``: the filter's verdict; ``prefixes``: what the asking client may see. Symlinks have size 0 and no chunks, and
    with ``metadata_only`` no file has; done tells how many files and bytes were sent."""
    sent = files if allowed is None else files.filter(allowed)
    sent = sent if prefixes is None else sent.filter(prefix_allowed(prefixes, F.col("relative_path")))
    sent = sent.filter(F.col("kind").isin("File", "Symlink"))
    link = F.col("kind") == "Symlink"
    size = F.when(link, 0).otherwise(F.col("size")).cast("long")
    n = F.when(link | F.lit(metadata_only), 0).otherwise(F.ceil(size / chunk)).cast("long")
    part = F.explode(F.sequence(F.lit(-1).cast("long"), n))
    rows = sent.select("relative_path", "kind", "target", size.alias("size"), "mode", "mtime_sec", n.alias("_n"), part.alias("_part"))
    kind = F.when(F.col("_part") < 0, "start").when(F.col("_part") < F.col("_n"), "chunk").otherwise("end")
    at_start = lambda c: F.when(F.col("_part") < 0, F.col(c)).alias(c)
    at_chunk = lambda c, name: F.when((F.col("_part") >= 0) & (F.col("_part") < F.col("_n")), c).alias(name)
    frames = rows.select(
        "relative_path", "_part", kind.alias("frame_type"), *map(at_start, ("kind", "target", "size", "mode", "mtime_sec")),
        at_chunk(F.col("_part"), "chunk_index"), at_chunk(F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("_part") * chunk), "chunk_len"),
    )
    numbered = running(frames, ["relative_path", "_part"], "seq").drop("_part")
    whole = F.lit(None).cast("long")
    last = numbered.agg(F.count("*").alias("seq"), F.count_if(F.col("frame_type") == "end").alias("files"), F.coalesce(F.sum("chunk_len"), F.lit(0)).cast("long").alias("bytes")).withColumn("frame_type", F.lit("done"))
    return numbered.withColumns({"files": whole, "bytes": whole}).unionByName(last, allowMissingColumns=True)


def encoded_frames(frames: DataFrame, contents: DataFrame | None = None, chunk: int = 1 << 20) -> DataFrame:
    """The stream as bytes: (seq, frame), each frame's header its row as JSON, a chunk's payload its part of the content (relative_path, content)."""
    header = F.to_json(F.struct(*[c for c in frames.columns if c != "seq"])).cast("binary")
    if contents is None:
        return frames.select("seq", encoded(header, F.lit(b"")).alias("frame"))
    body = F.substring("content", (F.col("chunk_index") * chunk + 1).cast("int"), F.col("chunk_len").cast("int"))
    df = frames.join(contents, "relative_path", "left")
    return df.select("seq", encoded(header, F.when(F.col("frame_type") == "chunk", body).otherwise(F.lit(b""))).alias("frame"))
