"""Plans, ledger, batches, chunks, streams and sources on small tables."""

import os
import random
import statistics
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.operators import batching, chunks, ordering, reports, throttle
from driftline.plans import ledger, reconcile
from driftline.sources import effects, tables
from driftline.sources.filetree import FileTree
from driftline.streaming.frames import DeleteSession, FrameBuffer, Progress, Replay, framed_stream, progress_stream, replay_stream, stop_when_idle

MANIFEST = "relative_path string, size long, mode long, mtime_sec long, file_hash string, total_chunks long, xattr_sig string"


def test_push_plan_traps(spark):
    src = spark.createDataFrame([("a", 10, 1, 5, "h", 3, None), ("b", 10, 1, 5, "h", 3, None), ("c", 0, 1, 5, "h0", 0, None), ("d", 10, 1, 5, "qc:10:5", 3, "s")], MANIFEST)
    done = spark.createDataFrame([("a", "h", 10, 2, 5, None), ("d", "other", 10, 1, 5, None)], "relative_path string, file_hash string, size long, mode long, mtime_sec long, xattr_sig string")
    part = spark.createDataFrame([("b", "wrong", 10, 4, 3, 1)], "relative_path string, file_hash string, size long, chunk_size long, total_chunks long, completed_chunks long")
    disk = spark.createDataFrame([("b", 8)], "relative_path string, size long")
    plan = lambda **k: {r["relative_path"]: (r["action"], r["next_chunk"], r["metadata_sync_required"]) for r in reconcile.push_plan(src, done, part, disk, chunk_size=4, **k).collect()}
    assert plan() == {"a": ("SKIP", 3, True), "b": ("UPLOAD", 0, False), "c": ("UPLOAD", 0, False), "d": ("SKIP", 3, True)}
    assert plan(compat=True)["b"] == ("UPLOAD", 2, False) and plan(compat=True, resume=False)["b"] == ("UPLOAD", 0, False)


def test_zipped_counts(spark):
    a = spark.createDataFrame([(0, 0, "x"), (0, 1, "y")], "batch_id long, pos long, p string")
    b = spark.createDataFrame([(0, 0, 1)], "batch_id long, pos long, n long")
    with pytest.raises(Exception, match="counts differ"):
        reconcile.zipped(a, b).collect()


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path)
    schema = "relative_path string, n long"
    assert ledger.load_snapshot(spark, folder, schema).collect() == []
    table = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    ledger.save_snapshot(table, folder)
    news = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "relative_path string, n long, at long")
    merged = ledger.upsert(ledger.load_snapshot(spark, folder, schema).withColumn("at", F.lit(0).cast("long")), news, order="at")
    ledger.save_snapshot(merged.select("relative_path", "n"), folder)
    assert sorted(map(tuple, ledger.load_snapshot(spark, folder, schema).collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert ledger.current_version(spark, folder) == 2
    twice = spark.createDataFrame([("b", 8), ("d", 1), ("b", 9)], schema).coalesce(1)
    assert sorted(map(tuple, ledger.upsert(merged.select("relative_path", "n"), twice).collect())) == [("a", 1), ("b", 9), ("c", 5), ("d", 1)]
    assert not ledger.due(1023) and ledger.due(1024) and ledger.due(1, force=True) and not ledger.due(0, force=True)


def naive(sizes, limit):
    out, batch, n, total = [], 0, 0, 0
    for s in sizes:
        if n and (n >= limit.max_count or total + s > limit.max_bytes or limit.close_after is not None and total >= limit.close_after):
            batch, n, total = batch + 1, 0, 0
        out.append((batch, n, total))
        n, total = n + 1, total + s
    return out


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40), st.integers(1, 6), st.one_of(st.none(), st.integers(1, 30)))
def test_next_starts(sizes, most, count, after):
    limit = batching.Limit(most, count, after)
    step = batching.next_starts(np.array(sizes, np.int64), limit)
    starts = [i for i, (_, n, _) in enumerate(naive(sizes, limit)) if n == 0]
    at, mine = 0, []
    while at < len(sizes):
        mine.append(at)
        at = int(step[at])
    assert mine == starts


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(5, 60), st.integers(1, 30), st.integers(1, 7))
def test_greedy_batches_do_not_depend_on_partitions(spark, sizes, most, count, parts):
    limit = batching.Limit(most, count)
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, size long")
    got = batching.greedy_batches(df, ["i"], F.col("size"), limit, parts).orderBy("i").collect()
    assert [(r["batch_id"], r["pos"], r["offset"]) for r in got] == naive(sizes, limit)


@pytest.mark.parametrize("after", [None, 4])
@pytest.mark.parametrize("count", [2, 3, batching.UNLIMITED])
def test_empty_rows_after_a_larger_row_in_the_range_before(count, after):
    """A row beyond the limit is a batch alone, also where rows without bytes begin the next range."""
    limit = batching.Limit(5, count, after)
    for ranges in ([[6], [0]], [[1, 9], [0, 0, 5], [0]], [[0], [7], [0], [0, 8], [0, 0]]):
        parts, state, got = [np.array(r, np.int64) for r in ranges], (0, 0, 0), []
        for part in parts:
            made, state = batching.cut(part, state, limit)
            got += zip(*(m.tolist() for m in made))
        assert got == naive([s for r in ranges for s in r], limit)
        assert batching.composed([batching.Jump.of(k, p, limit) for k, p in enumerate(parts)], 0, limit).after((0, 0, 0), limit) == state


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=9), st.integers(3, 40), st.sampled_from([1, 2, 7, 1 << 62]), st.one_of(st.none(), st.integers(1, 20)), st.integers(2, 4))
def test_jump_functions_compose(ranges, most, count, after, fan):
    """The batch open before each range is the same by composed jump functions as by walking all rows."""
    limit = batching.Limit(most, count, after)
    jumps = [batching.Jump.of(i, np.array(r, np.int64), limit) for i, r in enumerate(ranges)]
    state, states = (0, 0, 0), []
    for r in ranges:
        states.append(state)
        state = batching.cut(np.array(r, np.int64), state, limit)[1]
    for lo in range(0, len(jumps), fan):
        part = jumps[lo : lo + fan]
        one = batching.composed(part, 0, limit)
        after_it = states[lo + fan] if lo + fan < len(states) else state
        assert one.after(states[lo], limit) == after_it and one.rows == sum(j.rows for j in part)
        assert batching.composed([*part[:1], batching.composed(part[1:], 0, limit)] if part[1:] else part, 0, limit).after(states[lo], limit) == after_it


@pytest.mark.parametrize("limit", [batching.Limit(40, 9), batching.Limit(60, batching.UNLIMITED), batching.Limit(1 << 62, 7, 30)])
def test_batches_in_a_tree_of_many_ranges(spark, monkeypatch, limit):
    monkeypatch.setattr(batching, "FAN", 3)
    sizes = [(i * 7919) % 23 if i % 3 else 0 for i in range(500)]
    rows = [(i, s, "a", 5, "x") for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i long, size long, _part string, Batch_ID int, `a.b` string").withColumn("_size", F.lit(3))
    made = batching.greedy_batches(df, ["i"], F.col("size"), limit, 31)
    assert made.columns == ["i", "size", "_part", "a.b", "_size", "batch_id", "pos", "offset"]
    got = made.orderBy("i").collect()
    assert [(r["batch_id"], r["pos"], r["offset"]) for r in got] == naive(sizes, limit)
    assert {(r["_part"], r["a.b"], r["_size"]) for r in got} == {("a", "x", 3)}


def test_ranges_go_by_written_bytes(spark, monkeypatch):
    """A join without statistics gets as many ranges as its rows fill, and the same batches as its stored copy."""
    monkeypatch.setattr(ordering, "RANGE_BYTES", 2000)
    left = spark.range(2000).select("id", F.concat(F.lit("p/"), "id").alias("relative_path"), (F.col("id") % 50).alias("size"))
    joined = left.join(spark.range(0, 2000, 2).withColumnRenamed("id", "k"), F.col("id") == F.col("k"))
    counts = []
    monkeypatch.setattr(batching, "ordered", lambda *a: counts.append(made := ordering.ordered(*a)) or made)
    own = batching.greedy_batches(joined, ["relative_path"], F.col("size"), batching.Limit(300, 40)).select("id", "batch_id", "pos", "offset").orderBy("id").collect()
    assert 1 < counts[0].select(F.shiftright("at", 33)).distinct().count() < 100
    assert own == batching.greedy_batches(spark.createDataFrame(joined.collect(), joined.schema), ["relative_path"], F.col("size"), batching.Limit(300, 40), 3).select("id", "batch_id", "pos", "offset").orderBy("id").collect()


def test_running_sums_keep_other_columns(spark):
    df = spark.createDataFrame([(i, i % 5, 5, 7, "x") for i in range(50)], "k long, n long, _part int, row int, `a.b` string")
    got = ordering.running(df, ["k"], "row", start=F.col("n")).orderBy("k")
    assert got.columns == ["k", "n", "_part", "a.b", "row", "start"]
    assert [tuple(r)[2:] for r in got.collect()] == [(5, "x", i, sum(j % 5 for j in range(i))) for i in range(50)]


def test_chunks(spark):
    df = spark.createDataFrame([("a", 0, bytearray()), ("b", 4, b"abcd"), ("c", 9, b"abcdefghi")], "relative_path string, size long, content binary")
    made = chunks.chunk_contents(df, 4)
    assert sorted((r["relative_path"], r["length"]) for r in made.collect()) == [("b", 4), ("c", 1), ("c", 4), ("c", 4)]
    batch = spark.createDataFrame([(0, 0, 2, b"abcde"), (0, 1, 3, b"abcde")], "batch_id long, pos long, data_len long, payload binary")
    assert [bytes(r["data"]) for r in chunks.split_payload(batch).orderBy("pos").collect()] == [b"ab", b"cde"]
    with pytest.raises(Exception, match="payload length"):
        chunks.split_payload(batch.withColumn("payload", F.lit(b"abc"))).collect()


def frames_of(files):
    rows, seq = [], 0
    for path, size in files:
        for kind, n in [("start", 0), *[("chunk", min(4, size - k)) for k in range(0, size, 4)], ("end", 0)]:
            rows.append({"seq": seq, "frame_type": kind, "relative_path": path, "kind": "File", "size": size, "chunk_len": n, "files": 0})
            seq += 1
    return [*rows, {"seq": seq, "frame_type": "done", "relative_path": None, "kind": None, "size": 0, "chunk_len": 0, "files": len(files)}]


@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20)), max_size=6), st.randoms())
def test_replay_in_any_order(files, rng):
    rows = frames_of(files)
    shuffled = rows + rows[: len(rows) // 2]
    rng.shuffle(shuffled)
    assert [(r["relative_path"], r["bytes"]) for r in Replay().feed(shuffled)] == files


def test_replay_errors():
    rows = frames_of([("a", 9), ("b", 2)])
    for change, why in (((1, "chunk_len", 5), "size differs"), ((0, "kind", "Symlink"), "chunk for a symlink"), ((4, "relative_path", "x"), "end of another file"), ((-1, "files", 3), "file count differs"), ((1, "frame_type", "start"), "start within a file")):
        bad = [dict(r) for r in rows]
        bad[change[0]][change[1]] = change[2]
        found = Replay().feed(bad)
        assert found[-1]["error"] in (why, "more bytes than announced") and sum(r["error"] is not None for r in found) == 1


def test_progress_and_sessions():
    p = Progress()
    event = lambda kind, start, n=1, last=False: p.step({"event": kind, "start_chunk": start, "sent_chunks": n, "total_chunks": 4, "finalize": last, "bytes": 10})
    assert event("chunk", 0)["message"] == "no init"
    event("init", 0)
    assert [event("chunk", *a)["message"] for a in ((1,), (0,), (0,), (1, 2), (3, 1, True))] == ["expected chunk 0", "applied", "already applied", "applied", "completed"]
    s = DeleteSession()
    step = lambda stage, *paths: s.step({"stage": stage, "paths": list(paths)})
    assert not step("apply")["accepted"]
    step("begin"), step("add", "a", "b"), step("add", "b")
    assert step("apply")["keep_paths"] == 2 and not step("add", "c")["accepted"]


def test_streams(spark, tmp_path):
    schema = "stream_id string, seq long, frame_type string, relative_path string, kind string, size long, chunk_len long, files long"
    rows = [("s", *(r[k] for k in ("seq", "frame_type", "relative_path", "kind", "size", "chunk_len", "files"))) for r in frames_of([("a", 9), ("b", 2)])]
    for part in (rows[4:], rows[:6]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = replay_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["relative_path"], r["bytes"], r["error"]) for r in spark.sql("select * from replayed").collect()) == [("a", 9, None), ("b", 2, None)]
    events = "key string, seq long, event string, start_chunk long, sent_chunks long, total_chunks long, finalize boolean, bytes long"
    spark.createDataFrame([("k", 0, "init", 0, 0, 2, False, 0), ("k", 1, "chunk", 0, 2, 2, True, 8)], events).write.parquet(str(tmp_path / "ev"))
    q = progress_stream(spark.readStream.schema(events).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("moved").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["message"] for r in spark.sql("select * from moved order by seq").collect()] == ["ready", "completed"]


def test_frame_buffer():
    frame = b"SPS1" + b"\0\2\1\1" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"hhppp"
    data, buffer = frame * 3, FrameBuffer(64)
    assert [f for i in range(0, len(data), 5) for f in buffer.feed(data[i : i + 5])] == [frame] * 3
    buffer.close()
    buffer.feed(frame[:7])
    with pytest.raises(ValueError, match="ends within"):
        buffer.close()
    with pytest.raises(ValueError, match="limit"):
        FrameBuffer(16).feed(frame)
    for at, what in ((0, "magic"), (5, "protocol"), (6, "codec"), (7, "endianness")):
        with pytest.raises(ValueError, match=what):
            FrameBuffer(64).feed(frame[:at] + b"\x09" + frame[at + 1 :])


def test_throttle_lets_large_items_pass(spark):
    df = spark.createDataFrame([(1, 0, 0, 500), (1, 1, 0, 100), (1, 2, 10_000_000, 50)], "key long, seq long, ts long, bytes long")
    got = [r["sent_at"] for r in throttle.throttled(df, rate=100, burst=200).orderBy("seq").collect()]
    assert got == [0, 4_000_000, 10_000_000]


def test_file_tree(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.txt").write_text("abc")
    (tmp_path / "y").write_text("")
    os.symlink("y", tmp_path / "d" / "l")
    spark.dataSource.register(FileTree)
    read = lambda root, **o: sorted((r["relative_path"], r["kind"], r["target"], r["size"]) for r in spark.read.format("filetree").options(root=root, **o).load().collect())
    assert read(str(tmp_path)) == [("d/e/x.txt", "File", None, 3), ("d/l", "Symlink", "y", 1), ("y", "File", None, 0)]
    assert read(str(tmp_path), symlinks="false") == [("d/e/x.txt", "File", None, 3), ("y", "File", None, 0)]
    assert read(str(tmp_path / "none")) == [] and read(str(tmp_path / "y")) == []


def test_json_tables(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.read_cache(spark, path, 4).collect() == []
    spark.createDataFrame([("a", 1, 1, "h", 1, 4), ("b", 1, 1, "h", 1, 8)], tables.CACHE).write.json(path)
    assert [r["relative_path"] for r in tables.read_cache(spark, path, 4).collect()] == ["a"]
    (tmp_path / "bad.json").write_text("{not json\n")
    assert tables.read_json(spark, str(tmp_path / "bad.json"), tables.POLICY, lenient=True).collect() == []
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "bad.json"), tables.POLICY).collect()
    with pytest.raises(Exception, match="unsafe"):
        tables.keep_list(spark.createDataFrame([("../x",)], "value string")).collect()


def test_effects_stay_below_the_root(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    root.mkdir(), outside.mkdir()
    os.symlink(outside, root / "way")
    rows = [("../x", b"1"), ("/abs", b"2"), ("way/y", b"3"), ("a/b", b"4"), ("a/b/c", b"5"), ("e", None)]
    got = {r["relative_path"]: (r["accepted"], r["message"]) for r in effects.write_files(spark.createDataFrame(rows, "relative_path string, content binary").coalesce(1), str(root)).collect()}
    assert got["../x"] == got["/abs"] == got["way/y"] == (False, "unsafe path") and got["a/b"] == got["e"] == (True, "written")
    assert not got["a/b/c"][0] and list(outside.iterdir()) == [] and (root / "a" / "b").read_bytes() == b"4" and (root / "e").read_bytes() == b""
    with pytest.raises(Exception, match="is no File"):
        effects.stat_paths(spark.createDataFrame([("way",)], "relative_path string"), str(root)).collect()
    links = spark.createDataFrame([("a", "e"), ("new/l", "../e")], "relative_path string, target string")
    assert sorted(r["message"] for r in effects.make_links(links, str(root)).collect()) == ["created", "replaced"] and os.path.islink(root / "a")


def test_effects_are_spread_over_tasks(spark):
    """The table has one row group, so its scan is one task; the answers come from many, and none has most of them."""
    from driftline import catalog, catalog_state  # noqa: F401

    for name in ("k7_k9_written_and_copied", "k8_finalized", "k12_deleted"):
        tasks = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().toArrow().column("count").to_pylist()
        assert len(tasks) > 4 and max(tasks) < sum(tasks) / 2


def test_copies_are_flushed_together(spark, tmp_path, monkeypatch):
    """No file waits for the disk before the others of its group are written, and one that the disk refuses is not accepted."""
    n, group = 600, 256
    (tmp_path / "from").mkdir()
    for i in range(n):
        (tmp_path / "from" / f"{i}").write_bytes(b"%d" % i)
    names = [f"{i}" for i in range(n)] + ["none", "../x"]
    df = spark.createDataFrame([("x",)], "relative_path string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, task, schema: task)  # the task itself, to run here
    task = effects.copy_files(df, str(tmp_path / "from"), str(tmp_path / "to"))
    there, sync, refused = [], os.fsync, os.fspath(tmp_path / "to" / "300")

    def fsync(fd):
        there.append(len(os.listdir(tmp_path / "to")))
        if os.readlink(f"/proc/self/fd/{fd}") == refused:
            raise OSError("no space")
        sync(fd)

    monkeypatch.setattr(os, "fsync", fsync)
    opened = len(os.listdir("/proc/self/fd"))
    batch = pa.table({"relative_path": names, "_safe": [None if x == "../x" else x for x in names]}).to_batches()
    got = [tuple(r.values()) for b in task(iter(batch)) for r in b.to_pylist()]
    assert there == [group] * group + [2 * group] * group + [n] * (n - 2 * group) and len(os.listdir("/proc/self/fd")) == opened
    assert got[300] == ("300", False, "OSError", 0) and got[n:] == [("none", False, "FileNotFoundError", 0), ("../x", False, "unsafe path", 0)]
    assert got[:300] + got[301:n] == [(x, True, "copied", len(x)) for x in names[:300] + names[301:n]]
    assert all((tmp_path / "to" / x).read_text() == x for x in names[:n])


def test_profiles_and_documents(spark, tmp_path):
    path = str(tmp_path / "profiles")
    assert tables.read_document(spark, path, "profiles", tables.PROFILE).collect() == []
    store = spark.createDataFrame([("a", "s1"), ("a", "s2")], "name string, server string").coalesce(1)
    ask = lambda name: reconcile.named_profiles(spark.createDataFrame([(name,)], "name string"), store)
    assert [r["server"] for r in ask("a").collect()] == ["s1"]
    with pytest.raises(Exception, match="profile 'b' not found"):
        ask("b").collect()
    with pytest.raises(Exception, match="cannot be empty"):
        tables.upsert_profiles(store, spark.createDataFrame([(" ", "s")], "name string, server string")).collect()
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception):
        tables.read_document(spark, str(tmp_path / "bad.json"), "entries", tables.POLICY).collect()


def test_streams_of_frames(spark, tmp_path):
    frame = b"SPS1\0\2\1\1" + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"hhppp"
    data = frame * 3
    rows = [("s", i, data[i * 8 : i * 8 + 8]) for i in range(-(-len(data) // 8))] + [("bad", 0, b"XXXX" + frame)]
    schema = "stream_id string, seq long, data binary"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read by age
    q = framed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 64).writeStream.format("memory").queryName("framed").outputMode("append").start()
    stop_when_idle(q, 6)
    assert not q.isActive
    got = sorted((r["stream_id"], r["frame_no"], bytes(r["frame"] or b""), (r["error"] or "")[:5]) for r in spark.sql("select * from framed").collect())
    assert got == [("bad", 0, b"", "magic"), *(("s", k, frame, "") for k in range(3))]


def test_running_does_not_depend_on_partitions(spark):
    rows = [(i * 7919 % 501, i % 5 if i % 3 else None) for i in range(501)]
    df = spark.createDataFrame(rows, "k long, n long")
    want, total = [], 0
    for place, (k, n) in enumerate(sorted(rows)):
        want.append((k, place, total))
        total += n or 0
    for parts in (1, 6):
        got = ordering.running(df.repartition(parts), ["k"], "row", start=F.col("n")).orderBy("k").select("k", "row", "start").collect()
        assert [tuple(r) for r in got] == want


def test_medians_are_exact(spark):
    rng = random.Random(2)
    rows = [("t", k, v) for k, n in (("odd", 501), ("even", 500), ("one", 1), ("tied", 300)) for v in ([rng.choice([1.0, 2.0, 5.0]) if k == "tied" else rng.gauss(0, 1) for _ in range(n)])] + [("t", "odd", None)]
    got = {r["key"]: r["median"] for r in reports.medians(spark.createDataFrame(rows, "transport string, key string, value double").repartition(5)).collect()}
    for key in ("odd", "even", "one", "tied"):
        assert got[key] == statistics.median(v for _, k, v in rows if k == key and v is not None)


def test_batches_of_empty_files(spark):
    rows = [(i, None if i % 2 else 0) for i in range(300)] + [(300 + i, 7) for i in range(5)]
    got = batching.greedy_batches(spark.createDataFrame(rows, "k long, s long"), ["k"], F.col("s"), batching.Limit(20, 1 << 62), 4).orderBy("k").collect()
    assert [(r["batch_id"], r["pos"], r["offset"]) for r in got] == naive([s or 0 for _, s in rows], batching.Limit(20, 1 << 62))
    with pytest.raises(Exception, match="exceeds the limit"):
        batching.greedy_batches(spark.createDataFrame(rows, "k long, s long"), ["k"], F.col("s"), batching.framed_limit(10, 5), strict=True).collect()


def test_attributes_are_set_and_scanned(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    try:
        os.setxattr(tmp_path / "a", "user.old", b"1")
    except OSError:
        pytest.skip("no attributes on this file system")
    rows = spark.createDataFrame([("a", 0o640, 5, [("user.z", b"2"), ("user.b", b"3")])], "relative_path string, mode int, mtime_sec long, xattrs array<struct<name:string,value:binary>>")
    assert [r["message"] for r in effects.apply_metadata(rows, str(tmp_path)).collect()] == ["metadata updated"]
    spark.dataSource.register(FileTree)
    got = spark.read.format("filetree").options(root=str(tmp_path), xattrs="true").load().first()
    assert [(x["name"], bytes(x["value"])) for x in got["xattrs"]] == [("user.b", b"3"), ("user.z", b"2")] and got["mtime_sec"] == 5 and got["mode"] & 0o7777 == 0o640
