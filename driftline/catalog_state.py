"""Registered queries on scans, stores, uploads, streams and effects, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import _ALLOWED, _GREEDY, _PLACES, _PUSH, _SAME, EXCLUDE, INCLUDE, query
from .functions import expr, frames, globs
from .operators import batching, chunks, counters, ordering, reports, throttle
from .plans import ledger, reconcile, scan, uploads
from .scratch import new_path
from .sources import effects
from .sources import tables as sources
from .sources import filetree
from .sources.filetree import FileTree
from .sources.fixtures import CHUNK, Tables
from .streaming import frames as streams
from .streaming import source


def run(df: DataFrame) -> None:
    """Take an effect now, whatever its answers."""
    df.write.format("noop").mode("overwrite").save()


def folder(t: Tables, name: str) -> str:
    """A fresh folder of the shared file system, as a plain path."""
    return new_path(t.spark, name).removeprefix("file://").removeprefix("file:")


# --- scans and stores ---------------------------------------------------------------------------


def listing(t: Tables) -> DataFrame:
    used = ["relative_path", "kind", "target", "size", "mode", "mtime_sec"]
    return t.manifest().withColumn("kind", F.lit("File")).withColumn("target", F.lit(None).cast("string")).select(*used).unionByName(t.symlinks().select(*used))


def scanned(t: Tables) -> DataFrame:
    return scan.hashed_scan(listing(t), t.cache(), t.manifest(content=True).select("relative_path", "content"), CHUNK, workers=4)


_SCANNED = """SELECT m.relative_path, 'File' AS kind, m.size, m.file_hash, m.total_chunks, c.relative_path IS NOT NULL AS cached
  FROM manifest m LEFT JOIN cache c ON c.relative_path = m.relative_path AND c.size = m.size AND c.mtime_sec = m.mtime_sec
  UNION ALL SELECT relative_path, 'Symlink', 0, NULL, 0, false FROM symlinks"""


@query("s4_s5_s9_hashed_scan", _SCANNED)
def hashed_scan(t):
    return scanned(t).select("relative_path", "kind", "size", "file_hash", "total_chunks", "cached")


@query("s4_scan_stats", f"""SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind <> 'File') AS links, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(*) FILTER (kind = 'File' AND cached) AS from_cache, count(*) FILTER (kind = 'File' AND NOT cached) AS hashed FROM ({_SCANNED})""")
def scan_stats(t):
    return scan.scan_stats(scanned(t))


@query("k4_persisted_cache", "SELECT relative_path, size, mtime_sec, file_hash, total_chunks, 4096::BIGINT AS chunk_size FROM manifest")
def persisted_cache(t):
    path = new_path(t.spark, "cache")
    sources.write_cache(t.manifest(), path, CHUNK)
    return sources.read_cache(t.spark, path, CHUNK)


@query("s11_cache_location", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/o' WHEN 1 THEN '/x' WHEN 2 THEN '/h/.cache' ELSE '/tmp/.cache' END || '/driftline/' || sha256(p_name) || '/hash-cache.json' AS location FROM part""")
def cache_location(t):
    k = F.col("p_partkey") % 4
    return t.part.select("p_partkey", sources.cache_location(F.col("p_name"), F.when(k == 0, "/o"), F.when(k <= 1, "/x"), F.when(k <= 2, "/h")).alias("location"))


@query("s10_s12_json_tables", "SELECT relative_path, file_hash, size, mode, mtime_sec, xattr_sig, total_chunks, updated_at_sec, 0::BIGINT AS unreadable FROM complete")
def json_tables(t):
    path = new_path(t.spark, "ledger")
    t.complete().write.json(path)
    bad = new_path(t.spark, "damaged")
    t.spark.createDataFrame([("{not json",)], "value string").write.text(bad)
    lost = sources.read_cache(t.spark, bad, CHUNK).agg(F.count("*").alias("unreadable"))  # one row
    return sources.read_json(t.spark, path, sources.COMPLETE).crossJoin(F.broadcast(lost))


@query("s16_raw_keep_list", "SELECT DISTINCT '../' || c_nationkey AS relative_path FROM customer")
def raw_keep_list(t):
    return sources.keep_list(t.customer.select(F.concat(F.lit(" ../"), F.col("c_nationkey").cast("string")).alias("value")), safe=False)


@query("s19_policy_document", "SELECT client_id, fingerprint_sha256, allowed_prefixes[1] AS prefix, revoked FROM policy")
def policy_document(t):
    path = new_path(t.spark, "policy")
    sources.write_document(t.policy(), path, "entries")
    return sources.read_document(t.spark, path, "entries", sources.POLICY).select("client_id", "fingerprint_sha256", F.col("allowed_prefixes")[0].alias("prefix"), "revoked")


def profiles(t: Tables) -> DataFrame:
    made = {"server": F.concat("s_name", F.lit(".example:70")), "destination": F.concat(F.lit("/d/"), "s_nationkey")}
    return t.supplier.select(F.col("s_name").alias("name"), *((made[c] if c in made else F.lit(None).cast("string")).alias(c) for c in ("server", "server_name", "ca", "client_cert", "client_key", "ssh_target", "destination")))


@query("k15_s20_profile_store", """SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE s_name || '.example:70' END AS server FROM supplier
  UNION ALL SELECT 'new' || n_nationkey, 'second' FROM nation""")
def profile_store(t):
    path, after = new_path(t.spark, "profiles"), new_path(t.spark, "profiles")
    store = profiles(t)
    sources.write_document(store, path, "profiles")
    names = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_name").alias("name")).unionByName(t.nation.select(F.concat(F.lit("new"), "n_nationkey").alias("name")))
    news = names.select("name", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("server"))
    news = news.select(*(F.col(c) if c in news.columns else F.lit(None).cast("string").alias(c) for c in store.columns))
    sources.write_document(sources.upsert_profiles(sources.read_document(t.spark, path, "profiles", sources.PROFILE), news), after, "profiles")
    return sources.read_document(t.spark, after, "profiles", sources.PROFILE).select("name", "server")


@query("j14_o4_profile_lookup", """SELECT c_custkey, 'Supplier#' || lpad((c_custkey % 20)::VARCHAR, 9, '0') AS name, s_name || '.example:70' AS server,
  CASE WHEN s_name IS NULL THEN 'profile ''Supplier#' || lpad((c_custkey % 20)::VARCHAR, 9, '0') || ''' not found' END AS error
  FROM customer LEFT JOIN supplier ON s_name = 'Supplier#' || lpad((c_custkey % 20)::VARCHAR, 9, '0')""")
def profile_lookup(t):
    asked = t.customer.select("c_custkey", F.format_string("Supplier#%09d", F.col("c_custkey") % 20).alias("name"))
    twice = profiles(t).unionByName(profiles(t).withColumn("server", F.lit("a later one")))
    return reconcile.named_profiles(asked, twice, strict=False).select("c_custkey", "name", "server", "error")


@query("k1_k2_manifest_files", "SELECT relative_path, size, mode, mtime_sec, uid, gid, file_hash, total_chunks FROM manifest")
def manifest_files(t):
    path = new_path(t.spark, "manifest")
    sources.write_manifest(t.manifest(), path)
    return sources.read_json(t.spark, path, sources.MANIFEST)


@query("k5_t13_snapshots", "SELECT relative_path, CASE WHEN k % 10 = 5 THEN 'new' ELSE file_hash END AS file_hash, 2::INTEGER AS version FROM manifest WHERE k % 10 >= 4")
def snapshots(t):
    where, schema = new_path(t.spark, "ledger"), "relative_path string, file_hash string"
    ledger.save_snapshot(t.complete().select("relative_path", "file_hash"), where)
    news = t.manifest().filter("k % 10 = 5").select("relative_path", F.lit("new").alias("file_hash"))
    ledger.save_snapshot(ledger.upsert(ledger.load_snapshot(t.spark, where, schema), news), where)
    return ledger.load_snapshot(t.spark, where, schema).withColumn("version", F.lit(ledger.current_version(t.spark, where)))


# --- plans and projections ----------------------------------------------------------------------


@query("p8_late_digests", """SELECT m.relative_path, CASE WHEN c.size = m.size AND c.mtime_sec = m.mtime_sec THEN 'SKIP' ELSE 'UPLOAD' END AS action,
  CASE WHEN c.size = m.size AND c.mtime_sec = m.mtime_sec THEN 'qc:' || m.size || ':' || m.mtime_sec ELSE m.file_hash END AS file_hash FROM manifest m LEFT JOIN complete c USING (relative_path)""")
def late_digests(t):
    plan = reconcile.push_plan(t.source().withColumn("file_hash", expr.quick_token(F.col("size"), F.col("mtime_sec"))), t.complete())
    return reconcile.late_digests(plan, t.manifest(content=True).select("relative_path", "content")).select("relative_path", "action", "file_hash")


@query("p9_size_changed", "SELECT relative_path, k % 7 = 0 AS size_changed FROM manifest")
def size_changed(t):
    return chunks.size_checked(t.manifest().withColumn("read_len", F.col("size") + F.when(F.col("k") % 7 == 0, 1).otherwise(0))).select("relative_path", "size_changed")


@query("p23_init_requests", "SELECT relative_path, size, mode, mtime_sec, NULL::VARCHAR AS xattr_sig, true AS update_only, file_hash, 4096::BIGINT AS chunk_size, total_chunks, true AS resume FROM manifest")
def init_requests(t):
    return reconcile.init_requests(t.source(), CHUNK, update_only=True)


@query("p24_metadata_entries", f"""SELECT m.relative_path, m.size, m.file_hash, m.mode, m.mtime_sec, m.uid, m.gid, 0::INTEGER AS attributes FROM ({_PUSH.format(newer="false", same=_SAME, guard=f"AND {_SAME}")}) p
  JOIN manifest m USING (relative_path) WHERE metadata_sync_required""")
def metadata_entries(t):
    plan = reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), chunk_size=CHUNK)
    return reconcile.metadata_entries(plan).withColumn("attributes", F.size("xattrs")).drop("xattrs")


@query("w5_framed_batches", _GREEDY.format(size="96 + strlen(relative_path)", close='g."offset" + g.size + o.size > 4032', select=_PLACES))
def framed_batches(t):
    size = F.lit(96) + F.octet_length("relative_path")
    return batching.greedy_batches(t.manifest().select("relative_path"), ["relative_path"], size, batching.framed_limit(4096, 64), strict=True).select("relative_path", "batch_id", "pos", "offset")


# --- uploads ------------------------------------------------------------------------------------


def requests(t: Tables) -> DataFrame:
    k, size = F.col("k"), F.col("size")
    raw = F.when(k % 11 == 0, size + 1).otherwise(size)
    return t.manifest().select("k", "relative_path", "file_hash", "size", "total_chunks", raw.alias("raw_len"), F.when(k % 11 == 0, size).when(k % 13 == 0, size + 2).otherwise(raw).alias("decoded_len"), (k % 8).alias("batch_id"), F.call_function("div", k, F.lit(8)).alias("pos"))


#: Lengths are never both wrong in the same way: a wrong raw length is told first, and 13 alone gives raw length, too.
_LENGTHS = """CASE WHEN k % 11 = 0 THEN 'raw length mismatch: expected ' || (size + 1) || ' got ' || size WHEN k % 13 = 0 THEN 'raw length mismatch: expected ' || size || ' got ' || (size + 2) END"""
_ANSWERED = """SELECT k, relative_path, skipped OR refused IS NULL AS accepted, skipped, CASE WHEN skipped THEN '{skip}' ELSE coalesce(refused, 'file finalized') END AS message,
  CASE WHEN skipped OR refused IS NOT NULL THEN 0 ELSE size END::BIGINT AS bytes_written"""
_SMALL = f"""{_ANSWERED.format(skip="already completed")} FROM (SELECT *, coalesce(total_chunks > 0 AND nxt >= total_chunks, false) AS skipped,
  CASE WHEN nxt IS NULL THEN 'small-file upload received before init' WHEN nxt > 0 THEN 'cannot apply small-file batch to resumed state (next_chunk=' || nxt || ')' ELSE {_LENGTHS} END AS refused
  FROM (SELECT *, CASE WHEN k % 10 >= 7 THEN total_chunks WHEN k % 10 >= 4 THEN total_chunks // 2 WHEN k % 10 >= 1 THEN 0 END AS nxt FROM manifest))"""
_COLD = f"""{_ANSWERED.format(skip="already completed; metadata reconciled")} FROM (SELECT *, k % 10 >= 4 AS skipped, {_LENGTHS} AS refused FROM manifest)"""


@query("t6_small_uploads", _SMALL)
def small_uploads(t):
    k, n = F.col("k") % 10, F.col("total_chunks")
    state = t.manifest().filter(k >= 1).select("relative_path", F.when(k >= 7, n).when(k >= 4, F.call_function("div", n, F.lit(2))).otherwise(0).cast("long").alias("next_chunk"))
    return uploads.small_uploads(requests(t), state).select("k", "relative_path", *uploads.ANSWER)


@query("t7_cold_uploads", _COLD)
def cold_uploads(t):
    return uploads.cold_uploads(requests(t), t.complete(), allow_skip=True).select("k", "relative_path", *uploads.ANSWER)


@query("t7_cold_overwrites", f"SELECT count(*) AS completed, sum(bytes_written)::BIGINT AS bytes FROM ({_ANSWERED.format(skip='')} FROM (SELECT *, false AS skipped, {_LENGTHS} AS refused FROM manifest)) WHERE accepted")
def cold_overwrites(t):
    done = uploads.completions(uploads.cold_uploads(requests(t), t.complete()))
    return done.agg(F.count("*").alias("completed"), F.sum("size").cast("long").alias("bytes"))


@query("t8_ordered_results", f"SELECT k % 8 AS batch_id, string_agg((k // 8) || ' ' || message, '; ' ORDER BY k // 8) AS answers, count(*)::INTEGER AS n FROM ({_COLD}) GROUP BY 1")
def ordered_results(t):
    done = uploads.ordered_results(uploads.cold_uploads(requests(t), t.complete(), allow_skip=True).repartition("k"))
    told = F.array_join(F.transform("results", lambda r: F.concat(r["pos"].cast("string"), F.lit(" "), r["message"])), "; ")
    return done.select("batch_id", told.alias("answers"), F.size("results").alias("n"))


_BATCHES = """b AS (SELECT user_id::VARCHAR AS relative_path, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total, event_id AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  c AS (SELECT *, 2 * n AS start_chunk, 2 * n + 2 AS end_chunk, n = total - 1 AND e % 5 > 0 AS finalize, e % 37 > 0 AS accepted, n = total - 1 OR e % 101 = 0 AS completed,
    CASE WHEN e % 41 = 0 THEN 2 * n WHEN e % 43 = 0 THEN 2 * n + 3 ELSE 2 * n + 2 END AS next_chunk, least(4, total - n) - 1 AS ahead FROM b),
  d AS (SELECT *, CASE WHEN NOT accepted THEN 'rejected at chunk ' || start_chunk || ': no' WHEN completed AND ahead > 0 THEN 'completed with ' || ahead || ' requests in flight' WHEN completed AND NOT finalize THEN 'completed before the last batch'
    WHEN completed THEN NULL WHEN next_chunk <= start_chunk THEN 'no progress: start=' || start_chunk || ' next=' || next_chunk
    WHEN next_chunk <> end_chunk THEN 'unexpected progress: expected ' || end_chunk || ' got ' || next_chunk WHEN n = total - 1 THEN 'no batch completed the file' END AS error FROM c)"""


@query("t10_checked_acks", f", {_BATCHES} SELECT relative_path, min(n) AS answered, (list(error ORDER BY n))[1] AS error FROM d WHERE error IS NOT NULL OR completed GROUP BY relative_path")
def checked_acks(t):
    e, n = F.col("event_id"), F.col("n")
    order = Window.partitionBy("user_id").orderBy("event_id")
    b = t.events.select(F.col("user_id").cast("string").alias("relative_path"), "event_id", (F.row_number().over(order) - 1).cast("long").alias("n"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    last = n == F.col("total") - 1
    sent = b.select(
        "relative_path", "n", (2 * n).alias("start_chunk"), (2 * n + 2).alias("end_chunk"), (last & (e % 5 > 0)).alias("finalize"), (e % 37 > 0).alias("accepted"), (last | (e % 101 == 0)).alias("completed"),
        F.when(e % 41 == 0, 2 * n).when(e % 43 == 0, 2 * n + 3).otherwise(2 * n + 2).alias("next_chunk"), F.lit("no").alias("message"),
    )
    return uploads.checked_acks(sent)


# --- streams ------------------------------------------------------------------------------------

_SEEN = f"""seen AS (SELECT relative_path, 'File' AS kind, size FROM manifest WHERE {_ALLOWED} UNION ALL SELECT relative_path, 'Symlink', 0 FROM symlinks),
  parts AS (SELECT relative_path, kind, size, (size + 4095) // 4096 AS n, unnest(range(-1, (size + 4095) // 4096 + 1)) AS part FROM seen WHERE relative_path LIKE 'src1/%' OR relative_path LIKE 'src9/%' OR relative_path LIKE 'links/%'),
  sent AS (SELECT row_number() OVER (ORDER BY relative_path, part) - 1 AS seq, CASE WHEN part < 0 THEN 'start' WHEN part < n THEN 'chunk' ELSE 'end' END AS frame_type, relative_path, CASE WHEN part < 0 THEN size END AS size,
    CASE WHEN part >= 0 AND part < n THEN least(4096, size - part * 4096) END AS chunk_len FROM parts),
  every AS (SELECT seq, frame_type, relative_path, size, chunk_len, NULL::BIGINT AS files, NULL::BIGINT AS bytes FROM sent
    UNION ALL SELECT count(*), 'done', NULL, NULL, NULL, count(*) FILTER (frame_type = 'end'), coalesce(sum(chunk_len), 0)::BIGINT FROM sent)"""


def sent_frames(t: Tables, **options) -> DataFrame:
    allowed = globs.allows(F.col("relative_path"), [*INCLUDE, "links/**"], EXCLUDE)
    return source.source_frames(listing(t), CHUNK, allowed, F.array(F.lit("src1"), F.lit("src9"), F.lit("links")), **options)


@query("s13_source_frames", f", {_SEEN} SELECT * FROM every")
def source_frames(t):
    return sent_frames(t).select("seq", "frame_type", "relative_path", "size", "chunk_len", "files", "bytes")


@query("s13_metadata_only", f", {_SEEN} SELECT frame_type, count(*) AS frames, coalesce(max(files), 0) AS files FROM every WHERE frame_type <> 'chunk' GROUP BY 1")
def metadata_only(t):
    return sent_frames(t, metadata_only=True).groupBy("frame_type").agg(F.count("*").alias("frames"), F.coalesce(F.max("files"), F.lit(0)).alias("files"))


@query("s14_encoded_frames", f", {_SEEN} SELECT seq, frame_type, coalesce(chunk_len, 0)::BIGINT AS payload_len, NULL::VARCHAR AS error FROM every")
def encoded_frames(t):
    made = source.encoded_frames(sent_frames(t), t.manifest(content=True).select("relative_path", "content"), CHUNK)
    f = made.select("seq", frames.decoded(F.col("frame")).alias("f"))
    return f.select("seq", F.get_json_object(F.col("f.header").cast("string"), "$.frame_type").alias("frame_type"), F.octet_length("f.payload").cast("long").alias("payload_len"), "f.error")


@query("t2_replay_errors", """, f AS (SELECT c_custkey AS k, 'c' || c_custkey AS stream_id, 'f' || c_custkey AS path FROM customer)
  SELECT stream_id, path AS relative_path, 10::BIGINT AS bytes, NULL::VARCHAR AS error FROM f WHERE k % 7 IN (0, 5) UNION ALL SELECT stream_id, NULL, NULL, 'file count differs' FROM f WHERE k % 7 = 5
  UNION ALL SELECT stream_id, CASE WHEN k % 7 = 4 THEN 'other' WHEN k % 7 < 3 THEN path END, NULL, CASE k % 7 WHEN 1 THEN 'size differs' WHEN 2 THEN 'start within a file' WHEN 3 THEN 'chunk for a symlink' WHEN 4 THEN 'end of another file' ELSE 'more bytes than announced' END
  FROM f WHERE k % 7 NOT IN (0, 5)""")
def replay_errors(t):
    """One file a stream; most streams break a rule, each its own."""
    k, path, n = F.col("c_custkey") % 7, F.concat(F.lit("f"), F.col("c_custkey").cast("string")), F.lit(None).cast("long")
    size = F.lit(10).cast("long")

    def frame(kind, name, chunk=n, files=n):
        return F.struct(F.lit(kind).alias("frame_type"), name.alias("relative_path"), F.when(k == 3, "Symlink").otherwise("File").alias("kind"), size.alias("size"), chunk.cast("long").alias("chunk_len"), files.cast("long").alias("files"))

    chunk = frame("chunk", F.lit(None).cast("string"), F.when(k == 1, 7).when(k == 6, 12).otherwise(10))
    second = F.when(k == 2, frame("start", path)).otherwise(chunk)
    whole = F.array(frame("start", path), second, frame("end", F.when(k == 4, "other").otherwise(path)), frame("done", F.lit(None).cast("string"), files=F.when(k == 5, 2).otherwise(1)))
    rows = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("stream_id"), F.posexplode(whole).alias("seq", "f")).select("stream_id", F.col("seq").cast("long").alias("seq"), "f.*")
    return streams.replay(rows).select("stream_id", "relative_path", "bytes", "error")


@query("t1_framed_reads", """, f AS (SELECT user_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, 16 + strlen(event_type) + strlen(props) AS size, user_id AS u FROM events)
  SELECT stream_id, frame_no, size::BIGINT AS size, NULL::VARCHAR AS error FROM f WHERE u % 5 <> 1 UNION ALL SELECT stream_id, count(*), NULL, 'stream ends within a frame' FROM f WHERE u % 5 = 0 GROUP BY stream_id
  UNION ALL SELECT DISTINCT stream_id, 0, NULL, 'protocol mismatch: 9' FROM f WHERE u % 5 = 1""")
def framed_reads(t):
    """Frames of each user one after another, cut into reads of 50 bytes; some streams are cut off, some speak another protocol."""
    one = frames.encoded(F.col("event_type").cast("binary"), F.col("props").cast("binary"))
    whole = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("f")))).alias("fs"))
    data = F.aggregate("fs", F.lit(b""), lambda a, x: F.concat(a, x["f"]))
    k = F.col("user_id") % 5
    data = F.when(k == 0, F.concat(data, F.lit(b"SPS1"))).when(k == 1, F.concat(F.lit(b"SPS1\x00\x09\x01\x01" + bytes(8)), data)).otherwise(data)
    cut = whole.select(F.col("user_id").cast("string").alias("stream_id"), data.alias("data")).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("data") - 1) / 50))))
    reads = cut.select("stream_id", "seq", F.substring("data", (F.col("seq") * 50 + 1).cast("int"), F.lit(50)).alias("data"))
    return streams.framed(reads, 1 << 16).select("stream_id", "frame_no", F.octet_length("frame").cast("long").alias("size"), "error")


@query("t11_idle_connections", """SELECT user_id::VARCHAR AS connection, run, count(*) AS events, max(t) + 600000000 AS closed_at FROM (
  SELECT user_id, t, count(*) FILTER (gap > 600000000) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, epoch_us(ts::TIMESTAMP) AS t, epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, run""")
def idle_connections(t):
    e = t.events.select(F.col("user_id").cast("string").alias("connection"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return streams.idle_connections(e, 600_000_000)


_EVENTS = """u AS (SELECT user_id::VARCHAR AS key, row_number() OVER w AS seq, CASE WHEN row_number() OVER w = 1 THEN 'init' ELSE 'chunk' END AS event, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE event_id % 4 END AS start_chunk,
    event_id % 4 = 3 AS finalize FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  p AS (SELECT key, seq, true AS accepted, 'ready' AS message, 0::BIGINT AS next_chunk, 0::BIGINT AS written FROM u WHERE seq = 1
    UNION ALL SELECT u.key, u.seq, CASE WHEN start_chunk < nxt THEN true WHEN start_chunk > nxt THEN false ELSE NOT finalize OR moved = 4 END,
      CASE WHEN start_chunk < nxt THEN 'already applied' WHEN start_chunk > nxt THEN 'expected chunk ' || nxt WHEN NOT finalize THEN 'applied' WHEN moved = 4 THEN 'completed' ELSE 'incomplete' END,
      CASE WHEN start_chunk = nxt THEN moved ELSE nxt END, CASE WHEN start_chunk = nxt THEN 100 ELSE 0 END
    FROM (SELECT key AS k, seq AS s, next_chunk AS nxt, greatest(next_chunk, least(4, next_chunk + 1)) AS moved FROM p) JOIN u ON u.key = k AND u.seq = s + 1)"""


@query("t3_t4_progress", f", {_EVENTS} SELECT * FROM p")
def progress(t):
    return streams.progress(t.upload_events())


_BUCKET = """, e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts::TIMESTAMP) AS ts, trunc(value * 1000)::BIGINT AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  b AS (SELECT key, seq, ts, bytes, i, ts + wait AS sent_at, least({cap}::DOUBLE, {cap}::DOUBLE + wait * 2000 / 1e6::DOUBLE) - bytes AS tokens
    FROM (SELECT *, CASE WHEN {cap}::DOUBLE >= least(bytes::DOUBLE, {cap}::DOUBLE) THEN 0 ELSE ceil((least(bytes::DOUBLE, {cap}::DOUBLE) - {cap}::DOUBLE) * 1e6::DOUBLE / 2000)::BIGINT END AS wait FROM e WHERE i = 1)
    UNION ALL SELECT key, seq, ts, bytes, i, start + wait, least({cap}::DOUBLE, had + wait * 2000 / 1e6::DOUBLE) - bytes
    FROM (SELECT *, CASE WHEN had >= need THEN 0 ELSE ceil((need - had) * 1e6::DOUBLE / 2000)::BIGINT END AS wait FROM (
      SELECT e.*, greatest(e.ts, b.sent_at) AS start, least({cap}::DOUBLE, b.tokens + (greatest(e.ts, b.sent_at) - b.sent_at) * 2000 / 1e6::DOUBLE) AS had, least(e.bytes::DOUBLE, {cap}::DOUBLE) AS need FROM b JOIN e ON e.key = b.key AND e.i = b.i + 1)))
  SELECT key, seq, ts, bytes, sent_at FROM b"""


def copied(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("value") * 1000).cast("long").alias("bytes"))


@query("w7_throttled", _BUCKET.format(cap=65536))
def throttled(t):
    return throttle.throttled(copied(t), rate=2_000)


@query("w8_local_throttled", _BUCKET.format(cap=2000))
def local_throttled(t):
    return throttle.throttled(copied(t), rate=2_000, burst=2_000)


# --- reports ------------------------------------------------------------------------------------


@query("a10_keep_count", "SELECT count(DISTINCT 'n' || (c_custkey % 1000)) AS keep_paths FROM customer")
def keep_count(t):
    return reports.keep_count(t.customer.select(F.concat(F.lit("n"), F.col("c_custkey") % 1000).alias("relative_path")))


def log(t: Tables, names: dict) -> DataFrame:
    """Events as a log that goes through a profile's stages."""
    stages = sorted({stage for stage, _ in names.values()})
    of = F.element_at(F.array(*map(F.lit, stages)), (F.col("event_id") % len(stages) + 1).cast("int"))
    return t.events.select("user_id", of.alias("stage"), (F.col("event_id") % 1000).alias("bytes"), (F.col("event_id") * 7).alias("ns"))


def _counted(names: dict) -> str:
    stages = sorted({stage for stage, _ in names.values()})
    what = {"events": "count(*) FILTER ({0})", "bytes": "coalesce(sum(event_id % 1000) FILTER ({0}), 0)::BIGINT", "ns": "coalesce(sum(event_id * 7) FILTER ({0}), 0)::BIGINT"}
    return ", ".join(f"{what[w].format(f'event_id % {len(stages)} = {stages.index(stage)}')} AS {name}" for name, (stage, w) in names.items())


@query("a13_client_counters", f"SELECT {_counted(counters.CLIENT)} FROM events")
def client_counters(t):
    return counters.counters(log(t, counters.CLIENT), counters.CLIENT)


@query("a14_server_counters", f"SELECT user_id, {_counted(counters.SERVER)} FROM events GROUP BY user_id")
def server_counters(t):
    return counters.counters(log(t, counters.SERVER), counters.SERVER, "user_id")


_HUMAN = "CASE WHEN {0} >= 1048576 THEN printf('%.2f MiB', {0} / 1048576.0) WHEN {0} >= 1024 THEN printf('%.2f KiB', {0} / 1024.0) ELSE {0} || ' B' END"


@query("k13_summary_lines", f"""SELECT source, 'push files=' || files || ' skipped=' || skipped || ' bytes_sent=' || sent || ' (' || {_HUMAN.format("sent")} || ') bytes_raw=' || raw || ' (' || {_HUMAN.format("raw")} || ') elapsed_ms=' || (files * 250)
  || ' throughput_mbps=' || printf('%.2f', sent * 8.0::DOUBLE / (files * 250 / 1000.0::DOUBLE) / 1e6::DOUBLE) AS line FROM (SELECT split_part(relative_path, '/', 1) AS source, count(*) AS files, count(*) FILTER (k % 3 = 0) AS skipped,
    coalesce(sum(size) FILTER (k % 3 <> 0), 0)::BIGINT AS sent, sum(size)::BIGINT AS raw FROM manifest GROUP BY 1)""")
def summary_lines(t):
    c = F.col
    by = t.manifest().groupBy(F.split("relative_path", "/")[0].alias("source")).agg(F.count("*").alias("files"), F.count_if(c("k") % 3 == 0).alias("skipped"), F.coalesce(F.sum(F.when(c("k") % 3 != 0, c("size"))), F.lit(0)).cast("long").alias("sent"), F.sum("size").cast("long").alias("raw"))
    return by.select("source", counters.summary_line("push", c("files"), c("skipped"), c("sent"), c("raw"), c("files") * 250, human=True).alias("line"))


@query("k14_progress_lines", """SELECT relative_path, 'progress files=' || count(*) OVER w || '/' || count(*) OVER (PARTITION BY k % 50) || ' bytes_sent=' || sum(size) OVER w AS line
  FROM manifest WINDOW w AS (PARTITION BY k % 50 ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def progress_lines(t):
    return counters.progress_lines(t.manifest().select("relative_path", "k", (F.col("k") % 50).alias("transfer"), F.col("size").alias("bytes")), "transfer", "k").select("relative_path", "line")


@query("k16_gate_summary", """, g(transport, metric, ratio, passed) AS (SELECT l_returnflag, 'q' || l_linenumber, count(*)::DOUBLE / 64, count(*) % 2 = 0 FROM lineitem GROUP BY 1, 2)
  SELECT transport, '{' || string_agg('"' || metric || '":"' || printf('%.3f', ratio) || '"', ',' ORDER BY metric) || '}' AS summary, bool_and(passed) AS passed FROM g GROUP BY transport""")
def gate_summary(t):
    n = F.count("*")
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("transport"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("metric")).agg((n / 64).alias("ratio"), (n % 2 == 0).alias("passed"))
    return counters.gate_summary(g)


@query("o1_running_offsets", """SELECT relative_path, row_number() OVER (ORDER BY relative_path) - 1 AS row, coalesce(sum(size) OVER (ORDER BY relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM manifest""")
def running_offsets(t):
    return ordering.running(t.manifest().select("relative_path", "size"), ["relative_path"], "row", start=F.col("size")).select("relative_path", "row", "start")


# --- effects on folders -------------------------------------------------------------------------


@query("k7_k9_written_and_copied", "SELECT relative_path, true AS accepted, 'copied' AS message, size AS bytes_written FROM manifest")
def written_and_copied(t):
    a, b = folder(t, "written"), folder(t, "copied")
    run(effects.write_files(effects.spread(t.manifest(content=True).select("relative_path", "content")), a))
    return effects.copy_files(effects.spread(t.manifest().select("relative_path")), a, b)


@query("k8_finalized", """SELECT relative_path, k % 3 <> 1 AND k % 3 <> 2 AS accepted, CASE k % 3 WHEN 0 THEN 'file finalized' WHEN 1 THEN 'size mismatch: expected ' || (size + 1) || ' got ' || size ELSE 'no partial file' END AS message,
  CASE k % 3 WHEN 0 THEN size ELSE 0 END AS bytes_written FROM manifest""")
def finalized(t):
    where, k = folder(t, "partial"), F.col("k") % 3
    run(effects.write_files(effects.spread(t.manifest(content=True).filter(k < 2).select(expr.partial_name(F.col("relative_path")).alias("relative_path"), "content")), where))
    return effects.finalize_partials(effects.spread(t.manifest().select("relative_path", (F.col("size") + F.when(k == 1, 1).otherwise(0)).alias("size"))), where)


@query("k10_links_made", "SELECT relative_path, CASE n % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'already there' ELSE 'replaced' END AS message FROM symlinks")
def links_made(t):
    where, links = folder(t, "links"), t.symlinks().select("relative_path", "target", "mtime_sec")
    n = F.col("mtime_sec") % 3  # 1700000000 + n: two more than a multiple of three
    run(effects.make_links(links.filter(n == 0), where))
    run(effects.write_files(links.filter(n == 1).select("relative_path", F.lit(b"in the way").alias("content")), where))
    return effects.make_links(links, where).select("relative_path", "message")


@query("k11_s8_metadata_applied", "SELECT relative_path, 'File' AS kind, size, CASE WHEN k % 2 = 0 THEN 33152 ELSE 33188 END::BIGINT AS mode, mtime_sec FROM manifest")
def metadata_applied(t):
    where = folder(t, "metadata")
    files = t.manifest(content=True).select("relative_path", "content", F.when(F.col("k") % 2 == 0, 0o100600).otherwise(F.col("mode")).cast("long").alias("mode"), "mtime_sec")
    run(effects.write_files(effects.spread(files.select("relative_path", "content")), where))
    run(effects.apply_metadata(effects.spread(files.drop("content")), where))
    return effects.stat_paths(effects.spread(files.select("relative_path")), where).select("relative_path", "kind", "size", "mode", "mtime_sec")


@query("s1_s2_s3_s18_file_tree", "SELECT relative_path, 'File' AS kind, NULL::VARCHAR AS target, size, 0::BIGINT AS missing FROM manifest UNION ALL SELECT relative_path, 'Symlink', target, NULL, 0 FROM symlinks")
def file_tree(t):
    where = folder(t, "tree")
    run(effects.write_files(effects.spread(t.manifest(content=True).select("relative_path", "content")), where))
    run(effects.make_links(t.symlinks().select("relative_path", "target"), where))
    t.spark.dataSource.register(FileTree)
    read = lambda root: t.spark.read.format("filetree").option("root", root).load()
    none = read(f"{where}/none").agg(F.count("*").alias("missing"))  # one row
    return read(where).select("relative_path", "kind", "target", F.when(F.col("kind") == "File", F.col("size")).alias("size")).crossJoin(F.broadcast(none))


@query("s1_pushed_tree", "SELECT relative_path, size FROM manifest WHERE relative_path LIKE 'src1/%' AND size > 500 AND NOT relative_path LIKE '%7.txt'")
def pushed_tree(t):
    """Files below one folder and above a size: the scan opens no other folder."""
    where = folder(t, "tree")
    run(effects.write_files(effects.spread(t.manifest(content=True).select("relative_path", "content")), where))
    run(effects.make_links(t.symlinks().select("relative_path", "target"), where))
    kept = filetree.file_tree(t.spark, where).filter("relative_path like 'src1/%' and size > 500 and kind = 'File' and not relative_path like '%7.txt'")
    return kept.select("relative_path", "size")


@query("k12_deleted", "SELECT relative_path, CASE WHEN k % 2 = 0 THEN 'deleted' ELSE 'already gone' END AS message FROM manifest")
def deleted(t):
    where = folder(t, "deleted")
    run(effects.write_files(effects.spread(t.manifest(content=True).filter("k % 2 = 0").select("relative_path", "content")), where))
    return effects.delete_paths(effects.spread(t.manifest().select("relative_path")), where).select("relative_path", "message")
