"""Uploads against the ledger's state: small files, cold files, ordered batches, the window of unanswered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import KEY, _side

#: Columns of an answer.
ANSWER = ("accepted", "skipped", "message", "bytes_written")


def _answered(df: DataFrame, columns: list[str], skipped: Column, skip_message: str, refused: Column) -> DataFrame:
    """The answer of each request: skipped, refused for a reason, or written."""
    written = ~skipped & refused.isNull()
    message = F.when(skipped, skip_message).otherwise(F.coalesce(refused, F.lit("file finalized")))
    return df.select(
        *[F.col(f"`{c}`") for c in columns], (skipped | refused.isNull()).alias("accepted"), skipped.alias("skipped"), message.alias("message"), F.when(written, F.col("size")).otherwise(0).cast("long").alias("bytes_written")
    )


def _length_checks() -> Column:
    """Why the decoded bytes are not the file's, or null."""
    say = lambda what, want, got: F.concat(F.lit(f"{what} mismatch: expected "), want, F.lit(" got "), got)
    raw, size, got = (F.col(c).cast("string") for c in ("raw_len", "size", "decoded_len"))
    return F.when(F.col("decoded_len") != F.col("raw_len"), say("raw length", raw, got)).when(F.col("decoded_len") != F.col("size"), say("size", size, got))


def small_uploads(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Answers to small uploads (relative_path, size, total_chunks, raw_len, decoded_len) against ``state`` (relative_path, next_chunk).

    In order: without an init refused; complete files are skipped; half-done ones refused, as are lengths that differ."""
    df = requests.join(_side(state, "at", "next_chunk"), KEY, "left")
    at = F.col("at_next_chunk")
    done = F.coalesce((F.col("total_chunks") > 0) & (at >= F.col("total_chunks")), F.lit(False))
    early = F.when(at.isNull(), "small-file upload received before init").when(at > 0, F.concat(F.lit("cannot apply small-file batch to resumed state (next_chunk="), at.cast("string"), F.lit(")")))
    return _answered(df, requests.columns, done, "already completed", F.coalesce(early, _length_checks()))


def cold_uploads(requests: DataFrame, complete: DataFrame, allow_skip: bool = False) -> DataFrame:
    """Answers to cold uploads (as above, with file_hash): a complete file of the same digest and size is skipped if
    ``allow_skip``; others are written over whatever is there."""
    df = requests.join(_side(complete, "done", "file_hash", "size"), KEY, "left")
    same = F.coalesce((F.col("done_file_hash") == F.col("file_hash")) & (F.col("done_size") == F.col("size")), F.lit(False)) & F.lit(allow_skip)
    return _answered(df, requests.columns, same, "already completed; metadata reconciled", _length_checks())


def completions(answers: DataFrame) -> DataFrame:
    """What goes into the ledger of complete files: the rows written, not those skipped or refused."""
    return answers.filter("accepted and not skipped").select(*[c for c in answers.columns if c not in ANSWER])


def ordered_results(answers: DataFrame, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """One row for each batch: its answers in the order of the requests, whatever the order in which they were worked out."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *ANSWER)))
    return answers.groupBy(batch).agg(rows.alias("results"))


def checked_acks(batches: DataFrame, window: int = 4) -> DataFrame:
    """The first broken rule of each file's upload (error null: none), and how many batches were answered before it.

    batches: relative_path, n (order of sending, from 0), start_chunk, end_chunk, finalize, and the answer accepted, completed,
    next_chunk, message. Sending runs ``window`` batches ahead of the answers, so when answer n is read, min(window, batches - n) - 1
    later ones are on their way."""
    total = batches.groupBy(KEY).agg(F.count("*").alias("_total"))
    df = batches.join(total, KEY)
    ahead = F.least(F.lit(window), F.col("_total") - F.col("n")) - 1
    text = lambda c: F.col(c).cast("string")
    error = (
        F.when(~F.col("accepted"), F.concat(F.lit("rejected at chunk "), text("start_chunk"), F.lit(": "), F.col("message")))
        .when(F.col("completed") & (ahead > 0), F.concat(F.lit("completed with "), ahead.cast("string"), F.lit(" requests in flight")))
        .when(F.col("completed") & ~F.col("finalize"), "completed before the last batch")
        .when(F.col("completed"), None)
        .when(F.col("next_chunk") <= F.col("start_chunk"), F.concat(F.lit("no progress: start="), text("start_chunk"), F.lit(" next="), text("next_chunk")))
        .when(F.col("next_chunk") != F.col("end_chunk"), F.concat(F.lit("unexpected progress: expected "), text("end_chunk"), F.lit(" got "), text("next_chunk")))
        .when(F.col("n") == F.col("_total") - 1, "no batch completed the file")
    )
    ends = F.col("completed") & error.isNull()
    stop = F.min(F.when(error.isNotNull() | ends, F.struct(F.col("n").alias("n"), error.alias("error"))))
    return df.groupBy(KEY).agg(stop.alias("s")).select(KEY, F.col("s.n").cast("long").alias("answered"), F.col("s.error").alias("error"))
