"""Counters of a transfer, its summary and progress lines, and the summary of a gate as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.expr import human_bytes, megabits_per_second

#: Counters by name: (stage of the log, what is added up).
CLIENT = {
    "connections": ("connect", "events"), "control_frames": ("control", "events"), "streams_opened": ("stream", "events"), "request_bytes": ("request", "bytes"), "response_bytes": ("response", "bytes"), "disk_read_bytes": ("read", "bytes"),
    "encoded_bytes": ("encode", "bytes"), "connect_ns": ("connect", "ns"), "disk_read_ns": ("read", "ns"), "encode_ns": ("encode", "ns"), "roundtrip_ns": ("response", "ns"),
}
SERVER = {
    "streams": ("stream", "events"), "request_bytes": ("request", "bytes"), "response_bytes": ("response", "bytes"), "read_ns": ("read", "ns"), "decode_ns": ("decode", "ns"), "process_ns": ("process", "ns"), "encode_ns": ("encode", "ns"),
    "write_ns": ("write", "ns"), "batch_split_ns": ("batch_split", "ns"), "batch_write_ns": ("batch_write", "ns"), "state_commit_ns": ("state_commit", "ns"),
}


def counters(log: DataFrame, names: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """Counters over a log (stage, bytes, ns), in all or for each ``by``: one pass, pre-aggregated."""
    total = lambda stage, what: F.count_if(F.col("stage") == stage) if what == "events" else F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col(what))), F.lit(0)).cast("long")
    made = [total(*of).alias(name) for name, of in names.items()]
    return log.groupBy(*by).agg(*made) if by else log.agg(*made)


class Counted:
    """Counters of a plan that it fills in while it runs, with no pass of its own: after an action on ``rows``, ``values`` has them."""

    def __init__(self, df: DataFrame, **made: Column):
        self._seen = Observation()
        self.rows = df.observe(self._seen, *(c.alias(name) for name, c in made.items()))

    @property
    def values(self) -> dict:
        return dict(self._seen.get)


class StreamCounters(StreamingQueryListener):
    """Running totals of a stream's observed counters (``rows.observe(name, ...)``), batch by batch; add it to ``spark.streams``."""

    def __init__(self, name: str):
        self.name, self.totals, self.batches = name, {}, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches += 1
            for counter, n in seen.asDict().items():
                self.totals[counter] = self.totals.get(counter, 0) + (n or 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def summary_line(prefix: str, files: Column, skipped: Column, sent: Column, raw: Column, millis: Column, human: bool = False) -> Column:
    """The closing line of a push: counts, bytes, time and throughput."""
    size = lambda c: F.concat(c.cast("string"), F.lit(" ("), human_bytes(c), F.lit(")")) if human else c.cast("string")
    rate = F.format_string("%.2f", F.bround(megabits_per_second(sent, millis / 1000.0), 2))
    parts = {"files": files.cast("string"), "skipped": skipped.cast("string"), "bytes_sent": size(sent), "bytes_raw": size(raw), "elapsed_ms": millis.cast("string"), "throughput_mbps": rate}
    return F.concat(F.lit(prefix), *(x for name, value in parts.items() for x in (F.lit(f" {name}="), value)))


def progress_lines(results: DataFrame, by: str, order: str) -> DataFrame:
    """``results`` (bytes) + line: files done of all and bytes so far, for each transfer ``by`` in ``order``."""
    whole, so_far = Window.partitionBy(by), Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(F.lit("progress files="), F.count("*").over(so_far).cast("string"), F.lit("/"), F.count("*").over(whole).cast("string"), F.lit(" bytes_sent="), F.sum("bytes").over(so_far).cast("string"))
    return results.withColumn("line", line)


def gate_summary(gates: DataFrame) -> DataFrame:
    """One row for each transport: its ratios as JSON by metric, in order (three decimals), and whether all passed."""
    ratio = F.coalesce(F.format_string("%.3f", F.bround("ratio", 3)), F.lit("none"))
    entries = F.array_sort(F.collect_list(F.struct("metric", ratio.alias("ratio"))))
    return gates.groupBy("transport").agg(F.to_json(F.map_from_entries(entries)).alias("summary"), F.bool_and("passed").alias("passed"))
