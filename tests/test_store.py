"""The ledger as a log, co-located tables, and keyed state on streams."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from driftline.plans import log as logs
from driftline.operators import chunks
from driftline.operators.counters import Counted, StreamCounters
from driftline.plans import digest_tree, reconcile, rights
from driftline.plans.colocated import CoLocated, buckets_for
from driftline.plans.log import Entry, LedgerLog
from driftline.scratch import bytes_of
from driftline.streaming.frames import DeleteSession, delete_sessions
from driftline.streaming.keyed import keyed_progress, keyed_sessions, run_available

SCHEMA = "relative_path string, n long, `a.b` string"


def rows(spark, *given):
    return spark.createDataFrame([(k, n, "x") for k, n in given], SCHEMA)


def state(df):
    return {r[0]: r[1] for r in df.collect()}


def test_log_follows_a_dictionary(spark, tmp_path, monkeypatch):
    """Random writes, folds on the way, every version as it was."""
    monkeypatch.setattr(logs, "SHARE", 0.5)
    rng, model, seen = random.Random(4), {}, [{}]
    log = LedgerLog(spark, str(tmp_path / "log"), SCHEMA, every=12)
    assert log.read().collect() == [] and log.version() == 0
    folded = 0
    for step in range(6):
        up = {f"k{rng.randrange(30)}": step * 100 + i for i in range(7)}
        gone = [f"k{rng.randrange(30)}" for _ in range(3)]
        assert log.write(rows(spark, *up.items()), rows(spark, *((k, 0) for k in gone)).select("relative_path")) == step + 1
        model = {k: v for k, v in {**model, **up}.items() if k not in gone}
        seen.append(dict(model))
        assert state(log.read()) == model
        folded += log.entries()[0].kind == "base"
    assert folded and [state(log.read(v)) for v in (2, 4, 6)] == [seen[v] for v in (2, 4, 6)]
    some = [*list(model)[:2], "nothing"]
    assert state(log.lookup(*some)) == {k: model[k] for k in some[:2]}
    assert "PushedFilters: [In(relative_path" in log.lookup(*some)._jdf.queryExecution().toString()
    assert log.vacuum() and state(log.read()) == model


def test_a_write_costs_what_it_changes(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = LedgerLog(spark, folder, SCHEMA)
    big = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("relative_path"), F.col("id").alias("n"), F.lit("x").alias("a.b"))
    log.write(big)
    assert [e.kind for e in log.entries()] == ["base"]
    before = bytes_of(spark, folder)
    log.write(rows(spark, ("k", 1)))
    assert bytes_of(spark, folder) - before < before / 100
    assert log.read().count() == 50_001 and not log.due()


def test_readers_see_old_or_new(spark, tmp_path):
    """Rows without an entry are not there; a claim without an entry keeps a base from covering it until it is void."""
    folder = tmp_path / "log"
    log = LedgerLog(spark, str(folder), SCHEMA)
    log.write(rows(spark, ("a", 1)))
    rows(spark, ("b", 2)).withColumn("gone", F.lit(False)).write.parquet(str(folder / "late"))
    assert log._claim() == 2
    log.write(rows(spark, ("c", 3)))
    assert state(log.read()) == {"a": 1, "c": 3} and log._settled() == 1
    log.fold()
    assert [(e.version, e.kind) for e in log.entries()] == [(1, "base"), (3, "delta")]
    log._commit(Entry(2, "delta", 1, "late"))  # the slow writer comes through
    assert state(log.read()) == {"a": 1, "b": 2, "c": 3}
    log.fold()
    assert state(log.read()) == {"a": 1, "b": 2, "c": 3} and log._settled() == 3


def test_log_refuses_what_has_no_last_row(spark, tmp_path):
    log = LedgerLog(spark, str(tmp_path / "log"), SCHEMA)
    twice = rows(spark, ("a", 1), ("a", 2))
    with pytest.raises(Exception, match="several rows of one key"):
        log.write(twice)
    with pytest.raises(Exception, match="without a key"):
        log.write(rows(spark, (None, 1)))
    log.write(twice, order="n")
    assert state(log.read()) == {"a": 2}


def test_second_sync_has_no_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.range(500).select(F.concat(F.lit("p/"), "id").alias("relative_path"), "id", F.lit(5).cast("long").alias("size"), F.lit(1).cast("long").alias("mode"), F.lit(2).cast("long").alias("mtime_sec"), F.col("id").cast("string").alias("file_hash"), F.lit(1).cast("long").alias("total_chunks"), F.lit(None).cast("string").alias("xattr_sig"))
        schema = "relative_path string, id long, size long, mode long, mtime_sec long, file_hash string, total_chunks long, xattr_sig string"
        store = CoLocated(spark, str(tmp_path / "store"), 4)
        assert store.load("ledger", schema).count() == 0
        store.save(files.filter("id % 2 = 0"), "ledger")
        store.save(files, "manifest")
        again = CoLocated(spark, str(tmp_path / "store"), 4)  # as another session finds them
        plan = reconcile.push_plan(again.load("manifest", schema), again.load("ledger", schema))
        assert plan.groupBy("action").count().orderBy("action").collect() == [("SKIP", 250), ("UPLOAD", 250)]
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        fresh_scan = reconcile.push_plan(files.repartition(4, "relative_path"), again.load("ledger", schema))
        assert fresh_scan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # the new side only
        wider = again.rebucketed(8, {"ledger": schema})
        assert wider.load("ledger", schema).count() == 250
        store.save(files.filter("id < 3"), "ledger")
        assert again.load("ledger", schema).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert buckets_for(spark, str(tmp_path / "store")) == 1


def sessions(rng, n):
    return [(f"s{rng.randrange(3)}", i, rng.choice(["begin", "add", "add", "add", "apply"]), [rng.choice("abcdef") for _ in range(rng.randrange(4))]) for i in range(n)]


EVENTS = "session string, seq long, stage string, paths array<string>"


def test_keep_sets_at_rest_and_on_a_stream(spark, tmp_path):
    """Windows, the state machine, and RocksDB over three runs with restarts say the same."""
    events = sessions(random.Random(1), 120)
    machines, expected = {}, []
    for session, seq, stage, paths in events:
        said = machines.setdefault(session, DeleteSession()).step({"stage": stage, "paths": paths})
        expected.append((session, seq, *said.values()))
    assert sorted(map(tuple, delete_sessions(spark.createDataFrame(events, EVENTS).repartition(3)).collect())) == sorted(expected)
    where = lambda name: str(tmp_path / name)
    for lo in (0, 40, 80):
        spark.createDataFrame(events[lo : lo + 40], EVENTS).write.mode("append").parquet(where("in"))
        run_available(keyed_sessions(spark.readStream.schema(EVENTS).parquet(where("in"))), where("out"), where("at"))
    assert sorted(map(tuple, spark.read.parquet(where("out")).collect())) == sorted(expected)


def test_large_keep_set_streams_through_state(spark, tmp_path):
    """Twenty thousand paths of one session in several adds: the value holds a count, the paths are entries of their own."""
    adds = [("s", 1 + i, "add", [f"p/{i * 4000 + j}" for j in range(5000)]) for i in range(5)]
    events = [("s", 0, "begin", []), *adds, ("s", 9, "apply", [])]
    spark.createDataFrame(events, EVENTS).write.parquet(str(tmp_path / "in"))
    run_available(keyed_sessions(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "at"))
    assert sorted((r.seq, r.keep_paths) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), *((1 + i, 5000 + 4000 * i) for i in range(5)), (9, 21000)]


def test_idle_progress_ends_by_a_timer(spark, tmp_path):
    schema = "key string, seq long, event string, start_chunk long, sent_chunks long, total_chunks long, finalize boolean, bytes long"
    where = lambda name: str(tmp_path / name)
    def run(key, seq, event, start):
        spark.createDataFrame([(key, seq, event, start, 1, 4, False, 10)], schema).write.mode("append").parquet(where("in"))
        run_available(keyed_progress(spark.readStream.schema(schema).parquet(where("in")), idle_ms=2000), where("out"), where("at"), timed=True)

    run("k", 0, "init", 0)
    run("k", 1, "chunk", 0)
    time.sleep(2.2)
    run("other", 9, "init", 0)  # the batch in which the timer of k ends its state
    run("k", 2, "chunk", 1)
    said = {(r.key, r.seq): r.message for r in spark.read.parquet(where("out")).collect()}
    assert said == {("k", 0): "ready", ("k", 1): "applied", ("other", 9): "ready", ("k", 2): "no init"}


def test_rights_by_prefix_in_numbers(spark):
    """A hundred thousand prefixes, no nested loop, and the same as plain prefixes."""
    rng = random.Random(8)
    path = lambda: "/".join(rng.choice("abc") + rng.choice("xyz") for _ in range(rng.randrange(1, 5)))
    some = [(rng.randrange(6), path()) for _ in range(40)] + [(7, "/"), (None, "ax"), (2, None)]
    asked = [(rng.randrange(9), path(), i) for i in range(300)] + [(None, "ax", 1), (7, None, 2), (7, "q", 3), (7, "q", 3)]
    many = spark.range(100_000).select((F.col("id") + 100).alias("client_id"), F.concat(F.lit("p/"), "id").alias("prefix"))
    given = spark.createDataFrame(some, "client_id long, prefix string").unionByName(many)
    got = rights.permitted(spark.createDataFrame(asked, "client_id long, relative_path string, ancestor long"), given)
    ok = lambda c, p: c is not None and p is not None and any(c == k and q and (q == "/" or p == q or p.startswith(q + "/")) for k, q in some)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in asked if ok(r[0], r[1]))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_compared_go_with_the_change(spark):
    old = spark.range(20_000).select(F.concat(F.lit("p/"), "id").alias("relative_path"), F.col("id").alias("size"), F.lit(None).cast("long").alias("mode"))
    k = F.substring("relative_path", 3, 9).cast("long")
    new = old.filter(k != 17).withColumn("size", F.when(k == 5, -1).otherwise(F.col("size"))).unionByName(spark.createDataFrame([("p/new", 1, None)], old.schema))
    n = digest_tree.blocks_for(20_000, 100)
    a, b, same = (digest_tree.snapshot(df, ["size", "mode"], n) for df in (old, new, old.repartition(7)))
    found = digest_tree.changes(a, b)
    assert sorted(map(tuple, found.rows.collect())) == [("p/17", "DELETE"), ("p/5", "UPDATE"), ("p/new", "COPY")]
    assert found.rows_compared <= 3 * 250 and found.nodes_compared <= 1 + 3 * 16 * 2
    nothing = digest_tree.changes(a, same)
    assert nothing.rows.collect() == [] and nothing.rows_compared == 0 and nothing.nodes_compared == 1
    swapped = old.withColumns({"mode": F.col("size"), "size": F.lit(None).cast("long")})
    assert digest_tree.changes(a, digest_tree.snapshot(swapped, ["size", "mode"], n)).rows.count() == 20_000


def test_counters_while_running(spark, tmp_path):
    df = spark.range(1000).withColumn("bytes", F.col("id") * 3)
    made = Counted(df, files=F.count(F.lit(1)), bytes=F.sum("bytes"))
    made.rows.write.parquet(str(tmp_path / "in"))
    assert made.values == {"files": 1000, "bytes": 3 * 999 * 500}
    seen = StreamCounters("transfer")
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("transfer", F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        run_available(stream, str(tmp_path / "out"), str(tmp_path / "at"))
        for _ in range(100):
            if seen.totals.get("files") == 1000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.totals == {"files": 1000, "bytes": 3 * 999 * 500} and seen.batches > 1


def sequential_tree(parts: list[bytes], fanout: int) -> str:
    level = [hashlib.sha256(b"\0" + p).digest() for p in parts]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + fanout])).digest() for i in range(0, len(level), fanout)]
    return level[0].hex()


@pytest.mark.parametrize("fanout", [2, 3, 64])
def test_tree_digest_is_the_sequential_one(spark, fanout):
    files = {f"f{n}": [bytes([i % 251, n % 251]) * (1 + i % 5) for i in range(n)] for n in (1, 2, 3, 4, 8, 9, 27, 28, 64, 65, 300)}
    rows = [(path, i, data) for path, parts in files.items() for i, data in enumerate(parts)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "relative_path string, chunk_index int, data binary").repartition(7)
    got = {r["relative_path"]: r["tree_hash"] for r in chunks.tree_digest(df, fanout=fanout).collect()}
    assert got == {path: sequential_tree(parts, fanout) for path, parts in files.items()}
    assert chunks.tree_digest(df.filter("false")).collect() == []
    for broken in (df.filter("relative_path = 'f28' and chunk_index != 13"), df.filter("relative_path = 'f4'").unionByName(df.filter("relative_path = 'f4' and chunk_index = 1"))):
        with pytest.raises(Exception, match="missing or comes twice"):
            chunks.tree_digest(broken, fanout=fanout).collect()


def test_no_row_of_a_tree_digest_holds_a_file(spark):
    df = spark.range(5_000).select(F.lit("one").alias("relative_path"), F.col("id").alias("chunk_index"), F.encode(F.repeat(F.col("id").cast("string"), 200), "UTF-8").alias("data")).repartition(8)
    want = sequential_tree([str(i).encode() * 200 for i in range(5_000)], 16)
    made = chunks.tree_digest(df, fanout=16)
    assert made.first()["tree_hash"] == want
    assert "data" not in made._jdf.queryExecution().analyzed().toString()  # above the stored leaves there are digests only
