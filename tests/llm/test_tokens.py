"""Token store, packing and token counts against the tokenizers library."""

import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftline.llm.packing import Plan, pack, pieces, place, sequences
from driftline.llm.token_counts import token_counts
from driftline.llm.tokens import encoder
from driftline.llm.token_store import chunk_lengths, merkle, read_store, write_store

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def ids_of(path, rows):
    t = Tokenizer.from_file(path)
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(docs, rows, spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(docs, path, WORD, end_id=1, part_bytes=(9000, 9000))
    want = sorted((-1 if r[0] is None else r[0], [*ids, 1]) for r, ids in zip(rows, ids_of(WORD, rows)))
    got = read_store(spark, path).orderBy("start").collect()
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [k for k, _ in want]
    at = 0
    by_key = defaultdict(list)
    for k, ids in want:
        by_key[k].append(ids)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in by_key[-1 if r["doc_id"] is None else r["doc_id"]]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in read_store(spark, path, as_crc=True).collect()}
    assert all(sums[r["doc_id"], r["start"]] == zlib.crc32(r["ids"]) for r in got)
    stored = spark.read.parquet(f"{path}/recipes").selectExpr("explode(chunks) c").selectExpr("c.digest", "c.ids is not null as here")
    assert stored.filter("here").count() == stored.select("digest").distinct().count() < stored.count()
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    assert len(manifest) > 1 and sum(r["tokens"] for r in manifest) == at


def test_store_finds_damage(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    write_store(docs.limit(20), path, WORD)
    bad = spark.read.parquet(f"{path}/recipes").selectExpr("part", "state", "doc_id", "rid", "start", "n_tokens + 1 as n_tokens", "root", "chunks")
    bad.write.partitionBy("part", "state").parquet(f"{path}2/recipes")
    with pytest.raises(Exception, match="damaged"):
        read_store(spark, f"{path}2").collect()


@pytest.mark.parametrize("lost", ["part", "row", "manifest"])
def test_store_compares_the_manifest(spark, tmp_path, lost):
    path = tmp_path / "store"
    rows = [(i, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    write_store(spark.createDataFrame(rows, "doc_id long, text string"), str(path), WORD, part_bytes=(2000, 2000))
    parts = sorted((path / "recipes").glob("part=*"), key=lambda p: int(p.name[5:]))
    assert len(parts) > 2 and read_store(spark, str(path)).count() == 30
    if lost == "row":
        last = spark.read.parquet(str(parts[1])).orderBy("start")
        last.limit(last.count() - 1).write.partitionBy("state").parquet(str(tmp_path / "less"))
    if lost != "manifest":
        shutil.rmtree(parts[1])
    if lost == "row":
        shutil.move(tmp_path / "less", parts[1])
    if lost == "manifest":
        shutil.rmtree(path / "manifest")
    with pytest.raises(ValueError, match="manifest"):
        read_store(spark, str(path)).collect()


def test_store_of_nothing(nothing, spark, tmp_path):
    write_store(nothing, str(tmp_path / "s"), WORD)
    assert read_store(spark, str(tmp_path / "s")).collect() == []


@given(st.lists(st.integers(1, 5000), max_size=60, unique=True), st.integers(1, 5000))
def test_chunks_cover(marks, n):
    own = chunk_lengths(np.array(sorted(m for m in marks if m <= n), int), n)
    assert sum(own) == n and all(0 < c <= 1024 for c in own)


def test_merkle_depends_on_order():
    assert merkle([b"a", b"b", b"c"]) != merkle([b"a", b"c", b"b"]) and merkle([b"a"]) == b"a"


@settings(max_examples=200)
@given(st.integers(2, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=c))))
def test_plan_is_a_packing(case):
    capacity, histogram = case
    plan, held = Plan(histogram, capacity), defaultdict(list)
    table = plan.table()
    for w, n in histogram.items():
        for s, o in zip(*place(table, np.full(n, w), np.arange(n))):
            held[int(s)].append((int(o), w))
    assert sorted(held) == list(range(plan.sequences))
    for own in held.values():
        at = 0
        for o, w in sorted(own):
            assert o == at
            at += w
        assert at <= capacity
    least = -(-sum(w * n for w, n in histogram.items()) // capacity)
    assert least <= plan.sequences <= max(least, int(11 / 9 * least) + 1 + least // 2)


def optimum(capacity, pieces_):
    """Fewest sequences, by trying every sequence for every piece."""
    best = len(pieces_)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces_):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces_[k]}:
            i = rooms.index(room)
            put(k + 1, [*rooms[:i], room - pieces_[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - pieces_[k]])

    put(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=9))))
def test_reduction_keeps_the_optimum(case):
    capacity, lengths = case
    left = Counter(lengths)
    plan = Plan({}, capacity)
    plan._reduce(left)
    rest = sorted(left.elements(), reverse=True)
    assert plan.sequences + optimum(capacity, rest) == optimum(capacity, sorted(lengths, reverse=True))
    assert sum(r.count for r in plan.runs) + len(rest) == len(lengths)


def test_reduction_fixes_three():
    plan, left = Plan({}, 20), Counter({10: 1, 6: 1, 4: 1, 9: 1, 8: 1})
    plan._reduce(left)
    assert not +left and plan.sequences == 2  # 10 6 4 and 9 8


def test_dominance_keeps_the_optimum():
    # exact pairs and lone large pieces are fixed, nothing is left to best fit
    plan = Plan({7: 2, 3: 2, 9: 1, 6: 1, 4: 1}, 10)
    assert plan.fixed == plan.sequences == 4


def test_packing(docs, rows, spark):
    packed = pack(pieces(docs, WORD, end_id=0, capacity=64), 64)
    got = packed.collect()
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of(WORD, rows)):
        want[r[0]].append([*ids, 0])
    docs_of = defaultdict(list)
    for r in got:
        docs_of[r["doc_id"]].append((r["piece"], r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
    for k, texts in want.items():
        pieces_ = [(p, p * 64, len(ids[p * 64 : p * 64 + 64]), ids[p * 64 : p * 64 + 64]) for ids in texts for p in range(-(-len(ids) // 64))]
        assert sorted(docs_of[k]) == sorted(pieces_)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    least = max(-(-total // 64), sum(r["length"] > 32 for r in got))
    assert len(by_sequence) <= least + 2
    assert {"n_words", "shard"} <= set(packed.columns)
    joined = sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * total and all(len(r["ids"]) == 4 * r["length"] for r in joined)
    digests = pieces(docs, WORD, capacity=64, digest_only=True).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in digests) == sorted((str(r["doc_id"]), r["piece"], zlib.crc32(r["ids"])) for r in got)


def test_packing_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    df = spark.range(20).withColumn("length", F.col("id") % 7 + 1).withColumns({c: F.col("id") for c in ("part", "_part", "at", "_at", "n", "base", "rank", "sequence_id")})
    got = pack(df, 8).collect()
    assert len(got) == 20 and all(r["part"] == r["_part"] == r["rank"] == r["id"] for r in got) and sum(r["length"] for r in got if r["sequence_id"] == 0) <= 8


def test_packing_of_nothing(nothing):
    assert pack(pieces(nothing, WORD)).collect() == []


def test_token_counts(docs, rows, nothing):
    got = token_counts(docs, BYTE, size=50).selectExpr("doc_id", "tokens.*", "n_words").collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(ids)) for r, ids in zip(rows, ids_of(BYTE, rows)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_counts(nothing, BYTE).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAZéÉßÿÖñİıΣσςǅﬁ́̈ .,;:!?'\"<>|#*$%&09  \t\n\x0b\x1c中日🙂ªº×÷µ") | st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=40))
def test_word_encoder_is_the_library(texts):
    texts = [*texts, "<|endoftext|> A<|startoftext|>b", "Étude, naïve! ÉCOLE."]
    flat, ends = encoder(WORD).encode(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in library]
