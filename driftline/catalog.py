"""Registered queries over the snapshot views, each with its DuckDB SQL where SQL can say it.

Names begin with the ids of the operators that they exercise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests, expr, frames, globs
from .operators import batching, chunks, reports
from .plans import ledger, reconcile
from .sources import tables as sources
from .sources.fixtures import CHUNK, SQL, Tables
from .streaming import frames as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rules and literals that queries run over.
INCLUDE, EXCLUDE = ["src1/**", "*9.txt"], ["**/de/", "src1?/**"]
BATCH = batching.Limit(20_000, 64)
THRESHOLDS = [("ssh", "first", "ours_first", "theirs_first", 1.30), ("ssh", "second", "ours_second", "theirs_second", 1.20), ("daemon", "first", "ours_first", "theirs_first", 3.00), ("daemon", "missing", "ours_none", "theirs_none", 1.0)]
ENDPOINTS = ["/data/in", "host:dir/x", "user@host.org:/srv", "ssh://u@h:22/p/q", "sync://h:7000/data", "sync://host/a", "C:/tmp", "plain", "a/b:c", ":x", "host:"]


def query(name: str, sql: str | None = None):
    def keep(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {SQL} {sql}"
        return make

    return keep


@query("five_way_plan", """SELECT relative_path, CASE WHEN d.size IS NULL THEN 'NEW' WHEN s.size IS NULL THEN 'DELETE' WHEN s.size <> d.size OR s.mtime_sec <> d.mtime_sec THEN 'UPLOAD' WHEN s.mode <> d.mode THEN 'META' ELSE 'SKIP' END AS action,
  s.size AS src_size, d.size AS dst_size FROM manifest s FULL JOIN destination d USING (relative_path)""")
def five_way_plan(t):
    return reconcile.five_way_plan(t.source(), t.destination())


@query("s4_a1_manifest_totals", "SELECT count(*) AS files, sum(size)::BIGINT AS total_bytes FROM manifest")
def manifest_totals(t):
    return reports.manifest_totals(t.manifest())


@query("s6_p2_p3_quick_manifest", """SELECT relative_path, 'qc:' || size || ':' || mtime_sec || CASE k % 5 WHEN 1 THEN 'x' WHEN 2 THEN ':1' ELSE '' END AS file_hash, CASE WHEN k % 5 NOT IN (1, 2) THEN size END AS token_size,
  CASE WHEN k % 5 NOT IN (1, 2) THEN mtime_sec END AS token_mtime, total_chunks FROM manifest""")
def quick_manifest(t):
    more = F.when(F.col("k") % 5 == 1, "x").when(F.col("k") % 5 == 2, ":1").otherwise("")
    df = t.manifest().withColumn("file_hash", F.concat(expr.quick_token(F.col("size"), F.col("mtime_sec")), more))
    parsed = expr.parsed_token(F.col("file_hash"))
    return df.select("relative_path", "file_hash", parsed["size"].alias("token_size"), parsed["mtime"].alias("token_mtime"), "total_chunks")


@query("s7_u1_o1_file_list", "SELECT relative_path, size, mtime_sec, NULL::VARCHAR AS target FROM manifest UNION ALL SELECT relative_path, size, mtime_sec, target FROM symlinks")
def file_list(t):
    files = t.manifest().select("relative_path", "size", "mtime_sec", F.lit(None).cast("string").alias("target"))
    return sources.file_list(files, t.symlinks().select("relative_path", "size", "mtime_sec", "target"))


@query("s15_keep_list", "SELECT DISTINCT 'a/' || c_custkey AS relative_path FROM customer")
def keep_list(t):
    return sources.keep_list(t.customer.select(F.concat(F.lit("  ./a//"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("value")))


@query("s21_a12_synthetic_paths", "SELECT bit_xor(range)::BIGINT AS digest, count(*) AS paths, min('root/' || lpad((range % 10000)::VARCHAR, 4, '0') || '/group/' || lpad(range::VARCHAR, 8, '0') || '.bin') AS first FROM range(100000)")
def synthetic(t):
    paths = sources.synthetic_paths(t.spark, 100_000)
    return reports.xor_digest(paths, "i").crossJoin(F.broadcast(paths.agg(F.count("*").alias("paths"), F.min("relative_path").alias("first"))))  # one row each


@query("k3_cold_manifest", "SELECT relative_path, size, mode, mtime_sec, true AS cold_start FROM manifest")
def cold_manifest(t):
    return t.manifest().select("relative_path", "size", "mode", "mtime_sec", F.lit(True).alias("cold_start"))


_ALLOWED = r"""(CASE WHEN regexp_full_match(relative_path, 'src1/.*') OR regexp_full_match(relative_path, '(.*/)?.*9\.txt') THEN true
  WHEN regexp_full_match(relative_path, '(.*/)?de/.*') OR regexp_full_match(relative_path, 'src1./.*') THEN false ELSE false END)"""


@query("f1_f2_f3_filter", f"SELECT relative_path, {_ALLOWED} AS kept FROM manifest")
def path_filter(t):
    return t.manifest().select("relative_path", globs.allows(F.col("relative_path"), INCLUDE, EXCLUDE).alias("kept"))


@query("a2_a3_filter_report", f"""SELECT * FROM (SELECT count(*) FILTER ({_ALLOWED}) AS files_kept, count(*) FILTER (NOT {_ALLOWED}) AS files_dropped, coalesce(sum(size) FILTER ({_ALLOWED}), 0)::BIGINT AS bytes_kept FROM manifest),
  (SELECT count(*) AS would_delete FROM destination d WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.relative_path = d.relative_path))""")
def filter_report(t):
    allowed = globs.allows(F.col("relative_path"), INCLUDE, EXCLUDE)
    return reports.filter_report(t.manifest(), allowed, reconcile.delete_plan(t.destination(), t.manifest()))


@query("f4_f9_j13_authorized_paths", """SELECT client_id, relative_path, len(list_filter(allowed_prefixes, lambda p: p = '/' OR relative_path = p OR starts_with(relative_path, p || '/'))) > 0 AS allowed
  FROM manifest JOIN policy ON client_id = 'Supplier#' || lpad((k % 50)::VARCHAR, 9, '0') OR fingerprint_sha256 = sha256('Supplier#' || lpad((k % 50)::VARCHAR, 9, '0')) WHERE NOT revoked""")
def authorized_paths(t):
    name = F.format_string("Supplier#%09d", F.col("k") % 50)
    asked = t.manifest().select("relative_path", F.sha2(name.cast("binary"), 256).alias("fingerprint_sha256"))
    df = reconcile.authorized(asked, t.policy()).filter("accepted")
    return df.select("client_id", "relative_path", expr.prefix_allowed(F.col("allowed_prefixes"), F.col("relative_path")).alias("allowed"))


@query("f9_connections", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'no certificate' WHEN client_id IS NULL THEN 'unknown certificate' WHEN revoked THEN 'revoked' END AS reason, c_custkey % 7 <> 0 AND client_id IS NOT NULL AND NOT revoked AS accepted
  FROM customer LEFT JOIN policy ON c_custkey % 7 <> 0 AND fingerprint_sha256 = sha256('Supplier#' || lpad(c_custkey::VARCHAR, 9, '0'))""")
def connections(t):
    made = F.when(F.col("c_custkey") % 7 != 0, F.sha2(F.format_string("Supplier#%09d", "c_custkey").cast("binary"), 256))
    twice = t.policy().unionByName(t.policy().withColumn("revoked", ~F.col("revoked")))  # the first one counts
    return reconcile.authorized(t.customer.select("c_custkey", made.alias("fingerprint_sha256")), twice).select("c_custkey", "reason", F.coalesce("accepted", F.lit(False)).alias("accepted"))


_DIRTY = "CASE p_partkey % 5 WHEN 0 THEN '/abs/' || p_partkey WHEN 1 THEN './a//b/./' || p_partkey WHEN 2 THEN 'a/../' || p_partkey WHEN 3 THEN './' ELSE 'x/' || p_name END"


@query("f5_sanitized", f"""SELECT p_partkey, CASE WHEN starts_with(p, '/') OR list_contains(string_split(p, '/'), '..') OR len(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.'))) = 0 THEN NULL
  ELSE array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), '/') END AS clean FROM (SELECT p_partkey, {_DIRTY} AS p FROM part)""")
def sanitized(t):
    k = F.col("p_partkey")
    dirty = F.when(k % 5 == 0, F.concat(F.lit("/abs/"), k)).when(k % 5 == 1, F.concat(F.lit("./a//b/./"), k)).when(k % 5 == 2, F.concat(F.lit("a/../"), k)).when(k % 5 == 3, "./").otherwise(F.concat(F.lit("x/"), "p_name"))
    return t.part.select("p_partkey", expr.sanitized(dirty).alias("clean"))


@query("f6_p25_symlinks", "SELECT relative_path, target, mode, mtime_sec, uid, gid FROM symlinks")
def symlinks(t):
    rows = t.symlinks().unionByName(t.manifest().withColumn("kind", F.lit("File")).select("relative_path", "mtime_sec", "mode", "uid", "gid", "kind", "size"), allowMissingColumns=True)
    return sources.applied_paths(rows).select("relative_path", "target", "mode", "mtime_sec", "uid", "gid")


@query("f7_f8_w9_routes", "SELECT relative_path, CASE WHEN total_chunks = 1 AND size <= 2000 THEN 'small' WHEN size <= 8000 THEN 'direct' ELSE 'streamed' END AS route FROM manifest")
def routes(t):
    return chunks.routed(t.manifest().withColumn("next_chunk", F.lit(0)), 2000, 8000, CHUNK).select("relative_path", "route")


@query("f10_private_mode", "SELECT relative_path, (mode & 63) = 0 AS private, mode & 4095 AS permissions FROM manifest")
def private(t):
    return t.manifest().select("relative_path", expr.private_mode(F.col("mode")).alias("private"), expr.permission_bits(F.col("mode")).alias("permissions"))


@query("p1_p5_paths", "SELECT relative_path AS relative, relative_path || '.part' AS partial, regexp_replace(relative_path, '/?[^/]*$', '') AS parent FROM manifest")
def paths(t):
    path = F.concat(F.lit("/data/in//"), F.col("relative_path"))
    return t.manifest().select(expr.relative_path(F.lit("/data/in/"), F.regexp_replace(path, "//", "/")).alias("relative"), expr.partial_name(F.col("relative_path")).alias("partial"), expr.parent(F.col("relative_path")).alias("parent"))


@query("p4_p29_chunk_ranges", "SELECT relative_path, c AS chunk_index, c * 4096 AS \"offset\", least(4096, size - c * 4096) AS length FROM (SELECT relative_path, size, unnest(range(total_chunks)) AS c FROM manifest)")
def chunk_ranges(t):
    return chunks.chunk_ranges(t.manifest(), CHUNK).select("relative_path", "chunk_index", "offset", "length")


@query("p7_a16_ordered_digest", "SELECT relative_path, file_hash FROM manifest")
def ordered_digest(t):
    return chunks.ordered_digest(chunks.chunk_contents(t.manifest(content=True), CHUNK))


@query("p12_human_bytes", """SELECT l_orderkey, l_linenumber, CASE WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0) ELSE b || ' B' END AS size
  FROM (SELECT *, (l_partkey * l_linenumber * l_linenumber)::BIGINT AS b FROM lineitem)""")
def human(t):
    b = (F.col("l_partkey") * F.col("l_linenumber") * F.col("l_linenumber")).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", expr.human_bytes(b).alias("size"))


@query("p13_bandwidth", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN NULL WHEN 6 THEN 9223372036854775807 ELSE (o_custkey * CASE o_orderkey % 7 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 WHEN 5 THEN 1024 ELSE 1 END)::BIGINT END AS kib FROM orders""")
def bandwidth(t):
    forms = [F.concat(F.lit(" "), "o_custkey"), F.concat("o_custkey", F.lit("k")), F.concat("o_custkey", F.lit("M")), F.concat("o_custkey", F.lit("g")), F.concat("o_custkey", F.lit("x")), F.concat("o_custkey", F.lit(" m ")), F.lit("9223372036854775807g")]
    return t.orders.select("o_orderkey", expr.bandwidth_kib(F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("kib"))


@query("p14_p15_p30_rates", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 1e-12 THEN l_partkey::DOUBLE * 8.0 / l_discount / 1e6 ELSE 0.0 END AS mbit, CASE WHEN l_discount > 1e-12 THEN l_partkey::DOUBLE / l_discount ELSE l_partkey::DOUBLE END AS per_second, CASE WHEN l_tax = 0 THEN 'inf' ELSE printf('%.2f', l_quantity / l_tax) || 'x' END AS ratio FROM lineitem")
def rates(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", expr.megabits_per_second(c("l_partkey"), c("l_discount")).alias("mbit"), expr.rate(c("l_partkey"), c("l_discount")).alias("per_second"), expr.ratio_text(c("l_quantity"), c("l_tax")).alias("ratio"))


_ENDPOINTS = """e(page_id, text, kind, host, path, error) AS (SELECT page_id, url, 'local', NULL, url, NULL FROM pages WHERE url NOT LIKE '%:%'
  UNION ALL SELECT page_id, 'sync://' || page_id || '.example:70/p/' || page_id, 'quic', page_id || '.example', '/p/' || page_id, NULL FROM pages UNION ALL SELECT page_id, 'me@h' || page_id || ':d', 'ssh', 'h' || page_id, 'd', NULL FROM pages
  UNION ALL SELECT page_id, 'u@h:d' || page_id, 'ssh', 'h', 'd' || page_id, NULL FROM pages UNION ALL SELECT page_id, page_id || ':d', 'ssh', page_id::VARCHAR, 'd', NULL FROM pages UNION ALL SELECT page_id, 'h' || page_id || ':', 'local', NULL, 'h' || page_id || ':', NULL FROM pages
  UNION ALL SELECT page_id, 'sync://h' || page_id, NULL, NULL, NULL, 'missing path' FROM pages UNION ALL SELECT page_id, 'ssh://h' || page_id || '/', NULL, NULL, NULL, 'remote path is empty' FROM pages
  UNION ALL SELECT page_id, 'ssh://h:' || (65536 + page_id) || '/p', NULL, NULL, NULL, 'invalid remote port' FROM pages)"""


@query("p16_p17_endpoints", f""", {_ENDPOINTS} SELECT text, kind, host, path, error, CASE WHEN error IS NOT NULL THEN 'local' ELSE kind END AS automatic, CASE page_id % 3 WHEN 0 THEN 'ssh' WHEN 1 THEN 'local' END AS chosen FROM e""")
def endpoints(t):
    n = F.col("page_id").cast("string")
    made = [F.concat(F.lit("sync://"), n, F.lit(".example:70/p/"), n), F.concat(F.lit("me@h"), n, F.lit(":d")), F.concat(F.lit("u@h:d"), n), F.concat(n, F.lit(":d")), F.concat(F.lit("h"), n, F.lit(":")), F.concat(F.lit("sync://h"), n), F.concat(F.lit("ssh://h"), n, F.lit("/"))]
    made.append(F.concat(F.lit("ssh://h:"), (F.col("page_id") + 65536).cast("string"), F.lit("/p")))
    texts = t.pages.select("page_id", F.explode(F.concat(F.array(*made), F.when(~F.contains("url", F.lit(":")), F.array("url")).otherwise(F.array().cast("array<string>")))).alias("text"))
    e, k = expr.endpoint(F.col("text")), F.col("page_id") % 3
    chosen = expr.transport(F.when(k == 0, "ssh").when(k == 1, "local").otherwise("tcp"), e["kind"])
    return texts.select("text", *(e[c].alias(c) for c in ("kind", "host", "path", "error")), expr.transport(F.lit("auto"), e["kind"]).alias("automatic"), chosen.alias("chosen"))


@query("p18_p19_p20_p21_names", r"""SELECT c_custkey, sha256(c_name) AS fingerprint, regexp_replace(c_name, '[^A-Za-z0-9\-_.]', '_', 'g') AS profile, regexp_replace(c_name, '[^A-Za-z0-9\-_]', '-', 'g') AS client, '''' || c_name || '''' AS quoted,
  CASE c_custkey % 5 WHEN 0 THEN ['/'] WHEN 1 THEN ['a/b', 'c'] WHEN 2 THEN ['/'] WHEN 3 THEN NULL ELSE ['/'] END::VARCHAR[] AS prefixes, c_custkey % 5 <> 3 AND (c_custkey % 5 <> 1 OR c_custkey % 2 = 0) AS may_read FROM customer""")
def names(t):
    name, k = F.col("c_name"), F.col("c_custkey") % 5
    of = lambda *p: F.array(*map(F.lit, p)).cast("array<string>")
    raw = F.when(k == 0, of("a", "/")).when(k == 1, of("/a/b/", "c", "a//b")).when(k == 2, of()).when(k == 3, of("../x", "/")).otherwise(of("b", "", "../x"))
    allowed = expr.normalized_prefixes(raw)
    path = F.when(F.col("c_custkey") % 2 == 0, "a/b/c").otherwise("ab/c")
    return t.customer.select("c_custkey", expr.fingerprint(name.cast("binary")).alias("fingerprint"), expr.profile_component(name).alias("profile"), expr.client_component(name).alias("client"), expr.shell_quoted(name).alias("quoted"), allowed.alias("prefixes"), expr.prefix_allowed(allowed, path).alias("may_read"))


@query("p6_o3_xattr_signatures", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN substr(sha256(CASE WHEN event_id % 3 = 2 THEN unhex('00000006') || encode('user.a') || unhex('00000001') || encode('1') ELSE ''::BLOB END
  || unhex('00000006') || encode('user.t') || unhex(lpad(printf('%x', strlen(event_type)), 8, '0')) || encode(event_type)), 1, 16) END AS sig FROM events""")
def signatures(t):
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("binary").alias("value"))
    k = F.col("event_id") % 3
    xattrs = F.when(k == 1, F.array(one("user.t", F.col("event_type")))).when(k == 2, F.array(one("user.t", F.col("event_type")), one("user.a", F.lit("1")))).otherwise(F.array().cast("array<struct<name:string,value:binary>>"))
    return t.events.select("event_id", digests.xattr_signature(xattrs).alias("sig"))


_PUSH = """SELECT m.relative_path, CASE WHEN u.newer OR u.done THEN 'SKIP' ELSE 'UPLOAD' END AS action,
  CASE WHEN u.newer OR u.done THEN m.total_chunks ELSE u.nxt END AS next_chunk,
  CASE WHEN u.newer OR NOT u.done THEN false ELSE c.mode <> m.mode OR c.mtime_sec <> m.mtime_sec OR c.xattr_sig IS DISTINCT FROM m.xattr_sig END AS metadata_sync_required,
  CASE WHEN u.newer THEN 'destination is newer (dst_mtime=' || d.mtime_sec || ' src_mtime=' || m.mtime_sec || ')' WHEN u.done THEN 'already up to date' WHEN u.nxt > 0 THEN 'resuming at chunk ' || u.nxt ELSE 'starting upload' END AS message
  FROM manifest m LEFT JOIN complete c USING (relative_path) LEFT JOIN partial p USING (relative_path) LEFT JOIN on_disk o USING (relative_path) LEFT JOIN destination d USING (relative_path),
  LATERAL (SELECT {newer} AS newer, coalesce(c.file_hash = m.file_hash AND c.size = m.size, false) AS done,
    greatest(CASE WHEN {same} THEN least(p.completed_chunks, m.total_chunks) ELSE 0 END, coalesce(CASE WHEN o.size <= m.size {guard} THEN least(o.size // 4096, m.total_chunks) END, 0))::BIGINT AS nxt) u"""
_SAME = "coalesce(p.file_hash = m.file_hash AND p.size = m.size AND p.chunk_size = 4096, false)"


@query("j1_j2_j3_j4_push_plan", _PUSH.format(newer="false", same=_SAME, guard=f"AND {_SAME}"))
def push_plan(t):
    return reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), chunk_size=CHUNK).select("relative_path", "action", "next_chunk", "metadata_sync_required", "message")


@query("j4_push_plan_compat", _PUSH.format(newer="false", same=_SAME, guard=""))
def push_plan_compat(t):
    return reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), chunk_size=CHUNK, compat=True).select("relative_path", "action", "next_chunk", "metadata_sync_required", "message")


@query("j5_push_plan_update_only", _PUSH.format(newer="coalesce(d.mtime_sec > m.mtime_sec, false)", same=_SAME, guard=f"AND {_SAME}"))
def push_plan_update(t):
    return reconcile.push_plan(t.source(), t.complete(), t.partial(), t.on_disk(), t.destination(), chunk_size=CHUNK, update_only=True).select("relative_path", "action", "next_chunk", "metadata_sync_required", "message")


@query("j1_quick_token_plan", "SELECT m.relative_path, CASE WHEN c.size = m.size AND c.mtime_sec = m.mtime_sec THEN 'SKIP' ELSE 'UPLOAD' END AS action FROM manifest m LEFT JOIN complete c USING (relative_path)")
def quick_plan(t):
    df = t.source().withColumn("file_hash", expr.quick_token(F.col("size"), F.col("mtime_sec")))
    return reconcile.push_plan(df, t.complete()).select("relative_path", "action")


@query("j6_j7_compare", "SELECT m.relative_path, CASE WHEN d.size = m.size AND d.mtime_sec = m.mtime_sec THEN 'SKIP' ELSE 'COPY' END AS action FROM manifest m LEFT JOIN destination d USING (relative_path)")
def compare(t):
    return reconcile.compare_plan(t.source(), t.destination()).select("relative_path", "action")


@query("j6_j7_compare_update", "SELECT m.relative_path, CASE WHEN d.mtime_sec >= m.mtime_sec THEN 'SKIP' ELSE 'COPY' END AS action FROM manifest m LEFT JOIN destination d USING (relative_path)")
def compare_update(t):
    return reconcile.compare_plan(t.source(), t.destination(), update_only=True).select("relative_path", "action")


@query("j8_a4_a13_zipped_results", """SELECT count(*) FILTER (size % 5 <> 0 AND size % 3 <> 0) AS transferred, count(*) FILTER (size % 3 = 0) AS skipped, count(*) FILTER (size % 5 = 0) AS rejected, coalesce(sum(size) FILTER (size % 3 <> 0), 0)::BIGINT AS bytes FROM manifest""")
def zipped(t):
    rows = t.manifest().select((F.col("k") % 10).alias("batch_id"), F.call_function("div", F.col("k"), F.lit(10)).alias("pos"), "relative_path", "size")
    results = rows.select("batch_id", "pos", (F.col("size") % 5 != 0).alias("accepted"), (F.col("size") % 3 == 0).alias("skipped"), F.col("size").alias("bytes_written"))
    return reports.merged_results(reconcile.zipped(rows, results), count_skipped=False)


@query("j9_u2_delete_plan", f"SELECT relative_path FROM destination d WHERE NOT {_ALLOWED.replace('src1/', 'zzz/')} AND starts_with(relative_path, 'extra/') AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.relative_path = d.relative_path)")
def delete_plan(t):
    allowed = globs.allows(F.col("relative_path"), ["extra/**"], ["*"]) & ~F.col("relative_path").rlike(r"9\.txt$")
    return reconcile.delete_plan(t.destination(), t.manifest(), allowed).select("relative_path")


@query("j10_k4_hash_cache", "SELECT m.relative_path, c.file_hash AS cached_hash, coalesce(c.file_hash, m.file_hash) AS file_hash FROM manifest m LEFT JOIN cache c ON c.relative_path = m.relative_path AND c.size = m.size AND c.mtime_sec = m.mtime_sec")
def hash_cache(t):
    found = reconcile.cached_hashes(t.manifest().withColumnRenamed("file_hash", "real"), t.cache(), CHUNK)
    return found.select("relative_path", "cached_hash", F.coalesce("cached_hash", "real").alias("file_hash"))


@query("j11_p24_metadata_plan", """SELECT m.relative_path, msg IS NULL AS accepted, coalesce(msg, 'metadata updated') AS message FROM manifest m LEFT JOIN complete c USING (relative_path) LEFT JOIN destination d USING (relative_path),
  LATERAL (SELECT CASE WHEN d.size IS NULL THEN 'destination missing' WHEN NOT coalesce(c.file_hash = m.file_hash AND c.size = m.size, false) THEN 'state mismatch; file no longer complete for hash/size' WHEN d.size <> m.size THEN 'destination size mismatch: expected ' || m.size || ' got ' || d.size END AS msg)""")
def metadata_plan(t):
    return reconcile.metadata_plan(t.source(), t.complete(), t.destination().withColumn("is_file", F.lit(True))).select("relative_path", "accepted", "message")


@query("j12_symlink_plan", "SELECT s.relative_path, CASE WHEN d.target = s.target AND d.mtime_sec = s.mtime_sec THEN 'SKIP' WHEN d.target IS NOT NULL THEN 'REPLACE_LINK' ELSE 'CREATE_LINK' END AS action FROM symlinks s LEFT JOIN dst_links d USING (relative_path)")
def symlink_plan(t):
    return reconcile.symlink_plan(t.symlinks(), t.symlinks(at_destination=True)).select("relative_path", "action")


@query("j15_stale_xattrs", "SELECT user_id, list_sort(list_filter(list_distinct(list(event_type)), lambda x: x <> 'click')) AS stale FROM events GROUP BY user_id")
def stale(t):
    named = lambda *values: F.transform(F.array(*values) if len(values) > 1 else values[0], lambda v: F.struct(v.alias("name")))
    have = t.events.groupBy("user_id").agg(named(F.collect_set("event_type")).alias("current")).withColumn("desired", named(F.lit("click"), F.lit("other")))
    return reconcile.stale_xattrs(have).select("user_id", "stale")


@query("a5_action_summary", """SELECT action, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT m.size, CASE WHEN c.file_hash = m.file_hash AND c.size = m.size THEN 'SKIP' ELSE 'UPLOAD' END AS action FROM manifest m LEFT JOIN complete c USING (relative_path)) GROUP BY action""")
def action_summary(t):
    return reports.action_summary(reconcile.push_plan(t.source(), t.complete()))


@query("a6_client_status", "SELECT count(*) AS total, count(*) FILTER (NOT revoked) AS active, count(*) FILTER (revoked) AS revoked FROM policy")
def client_status(t):
    return reports.client_status(t.policy())


@query("a8_a10_parents", "SELECT DISTINCT regexp_replace(relative_path, '/?[^/]*$', '') AS parent FROM destination")
def parents(t):
    return reports.parents(t.destination())


@query("a9_written_by", "SELECT user_id AS connection, sum(event_id)::BIGINT AS bytes_written FROM events GROUP BY user_id")
def written_by(t):
    return reports.written_by(t.events.select(F.col("user_id").alias("connection"), F.col("event_id").alias("bytes_written")))


@query("a15_f11_gate", """, runs AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ssh' ELSE 'daemon' END AS transport, CASE o_orderkey % 3 WHEN 0 THEN 'ours_first' WHEN 1 THEN 'theirs_first' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'ours_second' ELSE 'theirs_second' END END AS key, o_totalprice AS value FROM orders),
  med AS (SELECT transport, key, median(value) AS m FROM runs GROUP BY ALL), th(transport, metric, ours, theirs, max_ratio) AS (VALUES ('ssh', 'first', 'ours_first', 'theirs_first', 1.30::DOUBLE), ('ssh', 'second', 'ours_second', 'theirs_second', 1.20), ('daemon', 'first', 'ours_first', 'theirs_first', 3.00), ('daemon', 'missing', 'ours_none', 'theirs_none', 1.0))
  SELECT th.transport, metric, max_ratio, CASE WHEN b.m > 0 THEN a.m / b.m END AS ratio, coalesce(a.m / b.m <= max_ratio, false) AS passed FROM th LEFT JOIN med a ON a.transport = th.transport AND a.key = ours LEFT JOIN med b ON b.transport = th.transport AND b.key = theirs""")
def gate(t):
    k = F.col("o_orderkey")
    key = F.when(k % 3 == 0, "ours_first").when(k % 3 == 1, "theirs_first").otherwise(F.when(F.col("o_custkey") % 2 == 0, "ours_second").otherwise("theirs_second"))
    runs = t.orders.select(F.when(k % 2 == 0, "ssh").otherwise("daemon").alias("transport"), key.alias("key"), F.col("o_totalprice").alias("value"))
    limits = t.spark.createDataFrame(THRESHOLDS, "transport string, metric string, ours string, theirs string, max_ratio double")
    return reports.gate(reports.medians(runs), limits)


_GREEDY = """, o AS (SELECT relative_path, {size} AS size, row_number() OVER (ORDER BY relative_path) AS i FROM manifest),
  g(i, relative_path, size, batch_id, pos, "offset") AS (SELECT i, relative_path, size, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o WHERE i = 1 UNION ALL
  SELECT o.i, o.relative_path, o.size, CASE WHEN {close} THEN g.batch_id + 1 ELSE g.batch_id END, CASE WHEN {close} THEN 0 ELSE g.pos + 1 END, CASE WHEN {close} THEN 0 ELSE g."offset" + g.size END FROM g JOIN o ON o.i = g.i + 1)
  {select}"""
_PLACES = 'SELECT relative_path, batch_id, pos, "offset" FROM g'


@query("w1_small_batches", _GREEDY.format(size="size", close='g.pos + 1 >= 64 OR g."offset" + g.size + o.size > 20000', select=_PLACES))
def small_batches(t):
    return batching.greedy_batches(t.manifest().select("relative_path", "size"), ["relative_path"], F.col("size"), BATCH).select("relative_path", "batch_id", "pos", "offset")


@query("w2_init_batches", _GREEDY.format(size="128 + strlen(relative_path)", close='g.pos + 1 >= 64 OR g."offset" + g.size + o.size > 4000', select=_PLACES))
def init_batches(t):
    return batching.greedy_batches(t.manifest().select("relative_path"), ["relative_path"], F.lit(128) + F.octet_length("relative_path"), batching.Limit(4000, 64)).select("relative_path", "batch_id", "pos", "offset")


@query("w3_direct_batches", _GREEDY.format(size="size", close='g."offset" + g.size + o.size > 30000', select='SELECT relative_path, batch_id, batch_id % 4 AS connection, "offset" FROM g'))
def direct_batches(t):
    out = batching.greedy_batches(t.manifest().select("relative_path", "size"), ["relative_path"], F.col("size"), batching.Limit(30_000, 1 << 62))
    return out.select("relative_path", "batch_id", (F.col("batch_id") % 4).alias("connection"), "offset")


@query("w4_w5_keep_chunks", _GREEDY.format(size="strlen(relative_path) + 1", close='g."offset" + g.size + o.size > 8192', select="SELECT batch_id, count(*) AS lines, sum(size)::BIGINT AS bytes FROM g GROUP BY batch_id"))
def keep_chunks(t):
    size = F.octet_length("relative_path") + 1
    out = batching.greedy_batches(t.manifest().select("relative_path"), ["relative_path"], size, batching.keep_limit(64 << 10))
    return out.groupBy("batch_id").agg(F.count("*").alias("lines"), F.sum(size).cast("long").alias("bytes"))


@query("w6_chunk_batches", _GREEDY.format(size="size", close='g.pos + 1 >= 32 OR g."offset" + g.size >= 16000', select=_PLACES))
def chunk_batches(t):
    return batching.greedy_batches(t.manifest().select("relative_path", "size"), ["relative_path"], F.col("size"), batching.Limit(1 << 62, 32, 16_000)).select("relative_path", "batch_id", "pos", "offset")


@query("a7_p22_batch_report", _GREEDY.format(size="size", close='g.pos + 1 >= 64 OR g."offset" + g.size + o.size > 20000', select="""SELECT batch_id, count(*) AS files, sum(size)::BIGINT AS bytes, (sum(size) // count(*))::BIGINT AS mean_bytes,
  CASE WHEN sum(size) // count(*) <= 8192 THEN 24 WHEN sum(size) // count(*) <= 65536 THEN 48 WHEN sum(size) // count(*) <= 524288 THEN 64 ELSE 96 END::BIGINT AS concurrency FROM g GROUP BY batch_id"""))
def batch_report(t):
    return reports.batch_report(batching.greedy_batches(t.manifest().select("relative_path", "size"), ["relative_path"], F.col("size"), BATCH))


@query("p28_w10_payload_offsets", "SELECT relative_path, coalesce(sum(size) OVER (PARTITION BY k % 10 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM manifest")
def payload_offsets(t):
    df = t.manifest().select("relative_path", (F.col("k") % 10).alias("batch_id"), F.col("k").alias("pos"), F.col("size").alias("data_len"))
    return chunks.payload_offsets(df).select("relative_path", "data_offset")


@query("o2_component_order", "SELECT relative_path, row_number() OVER (PARTITION BY string_split(relative_path, '/')[1] ORDER BY string_split(relative_path, '/')) AS place FROM destination")
def component_order(t):
    from pyspark.sql import Window

    parts = expr.by_components(F.col("relative_path"))
    return t.destination().select("relative_path", F.row_number().over(Window.partitionBy(parts[0]).orderBy(parts)).cast("long").alias("place"))


@query("o5_churn", "SELECT relative_path, size + 8 AS size FROM manifest ORDER BY relative_path LIMIT 100")
def churn(t):
    return t.manifest().orderBy("relative_path").limit(100).select("relative_path", (F.col("size") + 8).alias("size"))


_SYNCED = "SELECT {action} AS action, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM manifest GROUP BY 1"


@query("o5_full_sync", _SYNCED.format(action="'COPY'"))
def full_sync(t):
    return reports.action_summary(reconcile.compare_plan(t.manifest(), t.manifest().limit(0)))


@query("o5_no_change_sync", _SYNCED.format(action="'SKIP'"))
def no_change_sync(t):
    return reports.action_summary(reconcile.compare_plan(t.manifest(), t.manifest()))


@query("o5_churn_sync", _SYNCED.format(action="CASE WHEN k % 10 = 0 THEN 'COPY' ELSE 'SKIP' END"))
def churn_sync(t):
    """A tenth of the files has grown since."""
    before = t.manifest().withColumn("size", F.col("size") - F.when(F.col("k") % 10 == 0, 8).otherwise(0))
    return reports.action_summary(reconcile.compare_plan(t.manifest(), before))


@query("k6_u4_upsert", """SELECT relative_path, file_hash, size FROM complete WHERE relative_path NOT IN (SELECT relative_path FROM manifest WHERE k % 10 IN (1, 5)) UNION ALL SELECT relative_path, 'new', size + 1 FROM manifest WHERE k % 10 IN (1, 5)""")
def upsert(t):
    twice = F.explode(F.array(F.lit("old"), F.lit("new")))  # the last one counts
    news = t.manifest().filter("k % 10 in (1, 5)").select("relative_path", twice.alias("file_hash"), (F.col("size") + 1).alias("size"))
    return ledger.upsert(t.complete().select("relative_path", "file_hash", "size"), news)


@query("k6_completed_partial", "SELECT relative_path, completed_chunks FROM partial WHERE relative_path NOT IN (SELECT relative_path FROM manifest WHERE k % 10 = 2)")
def completed(t):
    done = t.manifest().filter("k % 10 = 2").select("relative_path", "file_hash", "size")
    return ledger.completed(t.complete().select("relative_path", "file_hash", "size"), t.partial(), done)[1].select("relative_path", "completed_chunks")


@query("t5_partial_progress", "SELECT relative_path, least(total_chunks, greatest(completed_chunks, CASE WHEN relative_path LIKE '%1.txt' THEN 3 ELSE 0 END))::BIGINT AS completed_chunks FROM partial")
def partial_progress(t):
    news = t.partial().filter("relative_path like '%1.txt'").select("relative_path", F.lit(3).alias("completed_chunks"))
    return ledger.progressed(t.partial(), news).select("relative_path", "completed_chunks")


@query("p26_frames", """SELECT event_id, CASE WHEN error IS NULL THEN strlen(event_type) END::BIGINT AS header_len, CASE WHEN error IS NULL THEN strlen(props) END::BIGINT AS payload_len, error, CASE WHEN error IS NULL THEN event_type END AS header
  FROM (SELECT *, CASE event_id % 9 WHEN 1 THEN 'short prefix' WHEN 2 THEN 'magic' WHEN 3 THEN 'protocol' WHEN 4 THEN 'codec' WHEN 5 THEN 'endianness' WHEN 6 THEN 'length' END AS error FROM events)""")
def frame_round_trip(t):
    h, p, k = F.col("event_type").cast("binary"), F.col("props").cast("binary"), F.col("event_id") % 9
    frame = frames.encoded(h, p)
    bad = F.when(k == 1, F.substring(frame, 1, 15)).when(k == 2, F.concat(F.lit(b"XPS1"), F.substring(frame, 5, 1 << 30))).when(k == 3, frames.encoded(h, p, protocol=3)).when(k == 4, frames.encoded(h, p, codec=2))
    bad = bad.when(k == 5, frames.encoded(h, p, endianness=2)).when(k == 6, F.concat(frame, F.lit(b"x"))).otherwise(frame)
    out = t.events.select("event_id", frames.decoded(bad).alias("f"))
    return out.select("event_id", F.octet_length("f.header").cast("long").alias("header_len"), F.octet_length("f.payload").cast("long").alias("payload_len"), "f.error", F.col("f.header").cast("string").alias("header"))


@query("p10_p11_p27_chunk_packets", "SELECT relative_path, c AS chunk_index, least(4096, size - c * 4096)::BIGINT AS raw_len FROM (SELECT relative_path, size, unnest(range(total_chunks)) AS c FROM manifest)")
def chunk_packets(t):
    pieces = chunks.chunk_contents(t.manifest(content=True), CHUNK)
    checked = chunks.packet_contents(chunks.packet_batches(pieces, 3))
    return checked.select("relative_path", "chunk_index", F.octet_length("content").cast("long").alias("raw_len"))


@query("t12_handshake", """SELECT user_id, event_id, msg IS NULL AS accepted, coalesce(msg, 'ok') AS message FROM events, LATERAL (SELECT CASE WHEN event_id % 5 = 0 THEN 'protocol mismatch' WHEN event_id % 7 = 0 THEN 'codec mismatch' WHEN event_id % 11 = 0 THEN 'endianness mismatch' WHEN event_id % 13 = 0 THEN 'version mismatch' END AS msg)""")
def handshake(t):
    k = F.col("event_id")
    said = frames.hello(F.when(k % 13 == 0, "0.9").otherwise("1.0"), F.when(k % 5 == 0, 1).otherwise(2), F.when(k % 7 == 0, 9).otherwise(1), F.when(k % 11 == 0, 2).otherwise(1), ("1.0", 2, 1, 1))
    return t.events.select("user_id", "event_id", said["accepted"].alias("accepted"), said["message"].alias("message"))


def source_streams(t: Tables) -> DataFrame:
    """Each source's files as one framed stream."""
    from pyspark.sql import Window

    m = t.manifest().withColumn("stream_id", F.split("relative_path", "/")[0])
    chunk = chunks.chunk_ranges(m, CHUNK).select("stream_id", "relative_path", (F.col("chunk_index") + 1).alias("part"), F.lit("chunk").alias("frame_type"), F.col("length").alias("chunk_len"))
    edge = m.select("stream_id", "relative_path", "size", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit("start").alias("frame_type")), F.struct((F.col("total_chunks") + 1).alias("part"), F.lit("end").alias("frame_type")))).alias("e")).select("stream_id", "relative_path", "size", "e.*")
    done = m.groupBy("stream_id").agg(F.count("*").alias("files")).select("stream_id", "files", F.lit("done").alias("frame_type"), F.lit("\U0010ffff").alias("relative_path"), F.lit(0).cast("long").alias("part"))
    rows = edge.withColumn("kind", F.lit("File")).unionByName(chunk, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("stream_id").orderBy("relative_path", "part")).cast("long") - 1)


REPLAY_SQL = "SELECT source AS stream_id, relative_path, size AS bytes, NULL::VARCHAR AS error FROM manifest JOIN documents ON doc_id = k"


@query("s13_t2_j16_replay", REPLAY_SQL)
def replay(t):
    """The replay of each source's stream: every file back, no error."""
    return streams.replay(source_streams(t)).select("stream_id", "relative_path", "bytes", "error")


def session_events(t: Tables) -> DataFrame:
    """Sessions by nation: begin (every fourth has none, and is refused), adds, apply."""
    key = F.col("s_nationkey")
    adds = t.supplier.select(key.alias("k"), F.col("s_suppkey").alias("seq"), F.lit("add").alias("stage"), F.array("s_name", "s_name").alias("paths"))
    ends = F.array(F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("begin").alias("stage")), F.struct(F.lit(1 << 40).cast("long").alias("seq"), F.lit("apply").alias("stage")))
    edges = t.supplier.select(key.alias("k")).distinct().select("k", F.explode(ends).alias("e")).select("k", "e.seq", "e.stage", F.array().cast("array<string>").alias("paths"))
    rows = adds.unionByName(edges).filter("stage != 'begin' or k % 4 > 0")
    return rows.select(F.col("k").cast("string").alias("session"), "seq", "stage", "paths")


SESSIONS_SQL = """, a AS (SELECT s_nationkey AS k, s_suppkey AS seq, s_name FROM supplier)
  SELECT k::VARCHAR AS session, seq, k % 4 > 0 AS accepted, CASE WHEN k % 4 > 0 THEN 'added' ELSE 'no session' END AS message, CASE WHEN k % 4 > 0 THEN count(*) OVER (PARTITION BY k ORDER BY seq) ELSE 0 END AS keep_paths FROM a
  UNION ALL SELECT DISTINCT k::VARCHAR, -1, true, 'ready', 0 FROM a WHERE k % 4 > 0
  UNION ALL SELECT k::VARCHAR, 1099511627776, k % 4 > 0, CASE WHEN k % 4 > 0 THEN 'applied' ELSE 'no session' END, CASE WHEN k % 4 > 0 THEN count(*) ELSE 0 END FROM a GROUP BY k"""


@query("t9_delete_sessions", SESSIONS_SQL)
def delete_sessions(t):
    return streams.delete_sessions(session_events(t))
