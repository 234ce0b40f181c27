"""Registered queries over stored state: the ledger as a log, co-located tables, keyed state on streams, batches behind plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import _GREEDY, _PLACES, _PUSH, _SAME, BATCH, CHUNK, REPLAY_SQL, SESSIONS_SQL, query, session_events, source_streams
from .catalog_state import _EVENTS
from .functions import rules
from .operators import batching, chunks, counters
from .plans import digest_tree, reconcile, rights
from .plans.colocated import CoLocated
from .plans.log import LedgerLog
from .scratch import new_path, stored
from .streaming import keyed

_PLAN = ("relative_path", "action", "next_chunk", "metadata_sync_required", "message")


@query("w1_push_plan_batches", ", plan AS (" + _PUSH.format(newer="false", same=_SAME, guard=f"AND {_SAME}") + """), manifest2 AS (SELECT m.relative_path, m.size, p.next_chunk FROM manifest m JOIN plan p USING (relative_path) WHERE p.action = 'UPLOAD')"""
       + _GREEDY.replace("FROM manifest)", "FROM manifest2)").format(size="greatest(size - next_chunk * 4096, 0)", close='g.pos + 1 >= 64 OR g."offset" + g.size + o.size > 20000', select=_PLACES))
def push_plan_batches(t):
    """What is left to upload, batched straight behind the plan's joins."""
    plan = reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), chunk_size=CHUNK).filter("action = 'UPLOAD'")
    left = F.greatest(F.col("size") - F.col("next_chunk") * CHUNK, F.lit(0))
    return batching.greedy_batches(plan, ["relative_path"], left, BATCH).select("relative_path", "batch_id", "pos", "offset")


@query("k5_ledger_log", """SELECT relative_path, CASE WHEN k % 10 IN (5, 6) THEN 'newer' WHEN k % 10 = 4 THEN 'new' ELSE file_hash END AS file_hash, size FROM manifest WHERE k % 10 >= 4 AND k % 10 <> 7
  UNION ALL SELECT relative_path, 'new', size + 1 FROM manifest WHERE k % 10 = 0""")
def ledger_log(t):
    """The ledger by four writes: rows, newer rows and new ones, deleted rows, and newer rows again."""
    log = LedgerLog(t.spark, new_path(t.spark, "log"), "relative_path string, file_hash string, size long", every=256)
    k = F.col("k") % 10
    log.write(t.complete())
    log.write(t.manifest().filter(k.isin(4, 5, 0)).select("relative_path", F.lit("new").alias("file_hash"), (F.col("size") + F.when(k == 0, 1).otherwise(0)).alias("size")))
    log.write(t.manifest().filter("false"), deleted=t.manifest().filter(k == 7))
    log.write(t.manifest().filter(k.isin(5, 6)).withColumn("file_hash", F.lit("newer")))
    return log.read()


@query("k5_ledger_changes", """SELECT relative_path, CASE WHEN k % 10 <> 8 THEN 'new' END AS file_hash, k % 10 = 8 AS gone FROM manifest WHERE k % 10 IN (5, 6, 8)""")
def ledger_changes(t):
    """What two writes have changed since the first version, as a second site would fetch it."""
    log = LedgerLog(t.spark, new_path(t.spark, "log"), "relative_path string, file_hash string")
    first = log.write(t.complete())
    k = F.col("k") % 10
    log.write(t.manifest().filter(k.isin(5, 8)).withColumn("file_hash", F.lit("new")))
    log.write(t.manifest().filter(k == 6).withColumn("file_hash", F.lit("new")), deleted=t.manifest().filter(k == 8))
    return log.changes(first)


@query("j1_colocated_plan", _PUSH.format(newer="false", same=_SAME, guard=f"AND {_SAME}"))
def colocated_plan(t):
    """A push plan over co-located tables: manifest, ledger and sizes on disk in the same buckets."""
    store = CoLocated(t.spark, new_path(t.spark, "store"), 8)
    made = [store.save(df, name) for df, name in ((t.source(), "manifest"), (t.complete(), "complete"), (t.partial(), "partial"), (t.on_disk(), "disk"))]
    return reconcile.push_plan(*made, chunk_size=CHUNK).select(*_PLAN)


def streamed(t, rows: DataFrame, first: Column, answers) -> DataFrame:
    """The answers of a keyed stream to ``rows``: those for which ``first`` holds come in a run of their own, the others after a restart from its checkpoint."""
    arrived, path, checkpoint = (new_path(t.spark, n) for n in ("arrived", "answers", "checkpoint"))
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(arrived)
        keyed.run_available(answers(t.spark.readStream.schema(rows.schema).parquet(arrived)), path, checkpoint)
    return t.spark.read.parquet(path)


@query("t9_session_stream", SESSIONS_SQL)
def session_stream(t):
    """Delete sessions on a stream, with a restart among the adds."""
    return streamed(t, session_events(t), F.col("seq") <= 40, keyed.keyed_sessions)


@query("t2_replay_stream", REPLAY_SQL)
def replay_stream(t):
    """Replay on a stream whose frames come in any order: about half of them before a restart, the others after it."""
    answers = streamed(t, source_streams(t), F.pmod(F.xxhash64("stream_id", "seq"), F.lit(2)) == 0, keyed.keyed_replay)
    return answers.select("stream_id", "relative_path", "bytes", "error")


@query("t3_progress_stream", f", {_EVENTS} SELECT * FROM p")
def progress_stream(t):
    """Upload progress on a stream, with a restart after each path's fourth event."""
    return streamed(t, t.upload_events(), F.col("seq") <= 4, keyed.keyed_progress)


@query("f4_many_prefixes", """, p AS (SELECT k % 25 AS client_id, CASE WHEN k % 7 = 0 THEN source || '/' || lang ELSE relative_path END AS prefix FROM manifest JOIN documents ON doc_id = k WHERE k % 7 = 0 OR k % 3 = 0 UNION ALL SELECT 3, '/')
  SELECT k * 7 % 25 AS client_id, relative_path, k FROM manifest m WHERE EXISTS (SELECT 1 FROM p WHERE p.client_id = m.k * 7 % 25 AND (prefix = '/' OR prefix = relative_path OR starts_with(relative_path, prefix || '/')))""")
def many_prefixes(t):
    """What clients may see by rights on folders, single files and the root."""
    m, k = t.manifest(), F.col("k")
    folder = F.when(k % 7 == 0, F.substring_index("relative_path", "/", 2)).otherwise(F.col("relative_path"))
    listed = m.filter((k % 7 == 0) | (k % 3 == 0)).select((k % 25).alias("client_id"), folder.alias("prefix"))
    every = listed.unionByName(m.limit(1).select(F.lit(3).cast("long").alias("client_id"), F.lit("/").alias("prefix")))
    return rights.permitted(m.select((k * 7 % 25).alias("client_id"), "relative_path", "k"), every)


@query("o5_digest_tree_sync", """SELECT relative_path, CASE WHEN d.relative_path IS NULL THEN 'COPY' WHEN m.relative_path IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action
  FROM manifest m FULL JOIN destination d USING (relative_path) WHERE m.size IS DISTINCT FROM d.size OR m.mtime_sec IS DISTINCT FROM d.mtime_sec OR m.mode IS DISTINCT FROM d.mode""")
def digest_tree_sync(t):
    """The differences of source and destination by their trees of digests."""
    return _by_tree(t.destination(), t.manifest()).rows


@query("o5_digest_tree_churn", "SELECT relative_path, 'UPDATE' AS action FROM manifest WHERE k % 100 = 0")
def digest_tree_churn(t):
    """One file of a hundred has changed: most blocks are never read again."""
    before = t.manifest().withColumn("size", F.col("size") - F.when(F.col("k") % 100 == 0, 8).otherwise(0))
    return _by_tree(before, t.manifest()).rows


def _by_tree(old: DataFrame, new: DataFrame) -> digest_tree.Changes:
    used, blocks = ["size", "mtime_sec", "mode"], digest_tree.blocks_for(new.count(), 16)
    made = [digest_tree.snapshot(df.select("relative_path", *used), used, blocks) for df in (old, new)]
    return digest_tree.changes(*made)


@query("a13_observed_plan", """, plan AS (""" + _PUSH.format(newer="false", same=_SAME, guard=f"AND {_SAME}") + """)
  SELECT count(*) AS files, count(*) FILTER (action = 'SKIP') AS skipped, count(*) FILTER (next_chunk > 0 AND action = 'UPLOAD') AS resumed, count(*) FILTER (metadata_sync_required) AS metadata, sum(CASE WHEN action = 'UPLOAD' THEN size ELSE 0 END)::BIGINT AS upload_bytes
  FROM plan JOIN manifest USING (relative_path)""")
def observed_plan(t):
    """Counters that a push plan fills in while its rows are written."""
    plan = reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), chunk_size=CHUNK)
    upload = F.col("action") == "UPLOAD"
    made = counters.Counted(
        plan, files=F.count(F.lit(1)), skipped=F.count_if(~upload), resumed=F.count_if(upload & (F.col("next_chunk") > 0)), metadata=F.count_if(F.col("metadata_sync_required")),
        upload_bytes=F.sum(F.when(upload, F.col("size")).otherwise(0)),
    )
    stored(made.rows.select(*_PLAN), "plan")
    return t.spark.createDataFrame([made.values], "files long, skipped long, resumed long, metadata long, upload_bytes long")


#: Ten thousand rules: names, endings, folders and whole paths in turn, and one that only its expression tells.
MANY_RULES = [(f"{i}.txt", f"*7{i}.txt", f"src{i}/", f"src{i % 20}/en/{i}.txt")[i % 4] for i in range(10_000)] + ["src1?/*/*3.txt"]


@query("f1_first_of_many_rules", """, rules AS (SELECT range AS rule FROM range(10001)),
  hits AS (SELECT relative_path, min(rule) AS rule FROM manifest JOIN rules ON CASE WHEN rule = 10000 THEN regexp_full_match(relative_path, 'src1./.*/.*3[.]txt') WHEN rule % 4 = 0 THEN ends_with('/' || relative_path, '/' || rule || '.txt')
    WHEN rule % 4 = 1 THEN ends_with(relative_path, '7' || rule || '.txt') WHEN rule % 4 = 2 THEN starts_with(relative_path, 'src' || rule || '/') ELSE relative_path = 'src' || (rule % 20) || '/en/' || rule || '.txt' END GROUP BY 1)
  SELECT relative_path, rule::INTEGER AS rule FROM manifest LEFT JOIN hits USING (relative_path)""")
def first_of_many_rules(t):
    """The first of 10,001 rules that matches each path."""
    return t.manifest().select("relative_path", rules.first_rule(F.col("relative_path"), MANY_RULES).alias("rule"))



def _level(i: int) -> str:
    """One level of a digest tree in SQL; a level of one node stays as it is, so more levels than needed change nothing."""
    return f"""l{i + 1} AS (SELECT relative_path, node AS i, CASE WHEN node = 0 AND count(*) = 1 THEN min(digest) ELSE sha256(unhex('01' || string_agg(digest, '' ORDER BY i))) END AS digest
  FROM (SELECT relative_path, i // 8 AS node, i, digest FROM l{i}) GROUP BY relative_path, node)"""


@query("p7_tree_digest", ", l0 AS (SELECT relative_path, i, sha256(unhex('00' || substr(hex(encode(text)), 1 + 128 * i, 128))) AS digest FROM (SELECT relative_path, text, unnest(range((size + 63) // 64)) AS i FROM manifest)), "
       + ", ".join(_level(i) for i in range(7)) + " SELECT relative_path, digest AS tree_hash FROM l7")
def tree_digest(t):
    """Digests of files as trees over chunks of 64 bytes, eight to a node."""
    return chunks.tree_digest(chunks.chunk_contents(t.manifest(content=True).select("relative_path", "size", "content"), 64), fanout=8)
