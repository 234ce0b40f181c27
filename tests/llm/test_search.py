"""Top-k search and the n-gram Jaccard join against brute force."""

import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm.components import components
from driftline.llm.jaccard import Block, jaccard_components, near_duplicates, partners
from driftline.llm.topk import nra, top_k

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, width):
    out = []
    for _, text, *_ in rows:
        words = SPACE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return sorted((str(r[0]), len(sets[i]), str(min(least[find(i)], default=None))) for i, r in enumerate(rows))


def test_jaccard_matches_brute_force(docs, rows):
    for width, percent in ((4, 85), (5, 80), (2, 60)):
        got = jaccard_components(docs, width, percent).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, width, percent)


def test_blocks_and_parts_lose_no_link(docs, rows, monkeypatch):
    from driftline.llm import jaccard

    # small blocks: families and components of the fixture take several
    for name, value in (("BLOCK", 8), ("BLOCK_SHINGLES", 2000), ("SMALL_LIST", 3), ("PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard_components(docs, 4, 85).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute(rows, 4, 85)


def test_near_duplicates_keep_one_of_each_group(docs, rows, nothing):
    kept = near_duplicates(docs, 4, 85)
    assert kept.columns == docs.columns
    groups = defaultdict(set)
    for key, _, label in brute(rows, 4, 85):
        groups[label].add(key)
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    empty = {str(r[0]) for r in rows if not (r[1] or "").split()}
    want = sorted(g if g in members else next(iter(members)) for g, members in groups.items())
    assert [k for k in got if k not in empty] == [k for k in want if k not in empty] and empty <= set(got)
    assert near_duplicates(nothing).collect() == [] and jaccard_components(nothing).collect() == []


def test_near_duplicates_keep_wordless_rows_and_columns(spark):
    rows = [(1, "", "a"), (1, "", "b"), (2, None, "c"), (2, None, "d"), (3, "same text here", "e"), (3, "same text here", "f"), (4, "same text here", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").withColumn("_rid", F.col("rid"))
    kept = near_duplicates(df, 2, 80)
    got = kept.orderBy("doc_id", "rid").collect()
    assert kept.columns == df.columns and [r["rid"] for r in got[:4]] == ["a", "b", "c", "d"] and all(r["rid"] == r["_rid"] for r in got)
    assert len(got) == 5 and got[4]["rid"] in "ef"


def test_long_lists_lose_no_pair(spark, monkeypatch):
    from driftline.llm import jaccard

    rng = np.random.default_rng(4)
    n = rng.integers(1, 200, 300)
    pos = (rng.random(300) ** 2 * n).astype(int)
    key = rng.integers(0, 3, 300)
    rows = [(int(k), int(a), int(b), i) for i, (k, a, b) in enumerate(zip(key, n, pos))] + [(7, 5, 0, 1), (7, 5, 1, 1)]
    want = {
        (i, j) for i in range(300) for j in range(i + 1, 300)
        if key[i] == key[j] and min(n[i], n[j]) * 100 >= 80 * max(n[i], n[j]) and min(n[i] - pos[i], n[j] - pos[j]) * 180 >= 80 * (n[i] + n[j])
    }
    entries = spark.createDataFrame(rows, "hash long, n long, pos long, id long")
    for block in (5, 2048):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert {(r["a"], r["b"]) for r in jaccard.long_pairs(entries, 80, 4).collect()} == want


def test_partners_keep_every_pair_that_may_link():
    n, pos = np.array([10, 10, 12, 20]), np.array([0, 9, 1, 0])
    assert list(zip(*(x.tolist() for x in partners(n, n, n - pos, 80)))) == [(0, 2)]


def test_a_list_of_one_component_is_as_short_as_its_ids(spark):
    from driftline.llm import jaccard

    rows = spark.range(80_000).selectExpr("5L as hash", "100 + id % 10 as n", "id % 20 as pos", "1L as id")
    stranger = spark.range(1).selectExpr("5L as hash", "104L as n", "3L as pos", "2L as id")
    began = time.time()
    got = jaccard.long_pairs(rows.unionByName(stranger), 85, 4).collect()
    assert [tuple(r) for r in got] == [(1, 2)] and time.time() - began < 10


def test_folded_lists_lose_no_pair(spark, monkeypatch):
    from driftline.llm import jaccard

    rng = np.random.default_rng(5)
    n = rng.integers(1, 300, 500)
    pos, key, ids = (rng.random(500) ** 2 * n).astype(int), rng.integers(0, 4, 500), rng.integers(0, 60, 500)
    want = {
        (int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i in range(500) for j in range(i)
        if ids[i] != ids[j] and key[i] == key[j] and min(n[i], n[j]) * 100 >= 80 * max(n[i], n[j]) and min(n[i] - pos[i], n[j] - pos[j]) * 180 >= 80 * (n[i] + n[j])
    }
    entries = spark.createDataFrame([tuple(map(int, r)) for r in zip(key, n, pos, ids)], "hash long, n long, pos long, id long")
    for block in (5, 2048):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = [(r["a"], r["b"]) for r in jaccard.long_pairs(entries, 80, 4).collect()]
        assert len(got) == len(set(got)) and want <= set(got)


def test_block_components():
    texts = ["a b c d e f g h", "a b c d e f g i", "a b c d e f j i", "x y z", "x y z w"]
    assert Block(pa.array(texts), 1, 70).components().tolist() == [0, 0, 0, 3, 3]


def test_components(spark):
    edges = [(i, i - 1) for i in range(2, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 40)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[201] == got[200] == 200


def brute_top(ids, x, k):
    v = np.floor(256.0 * x.astype(float)).astype(int)
    out = []
    for q in np.flatnonzero(ids % 5 == 0):
        score = v @ v[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(order)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    from driftline.llm import topk

    monkeypatch.setattr(topk, "CANDIDATES", (70, 70))
    monkeypatch.setattr(topk, "QUERIES", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:60] = x[3]  # ties
    ids = np.arange(300)
    data = [(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x)]
    bad = [(400, None, "x"), (405, [1.0, None], "x"), (410, [float("nan")] * 8, "x"), (415, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x"), data[3]]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute_top(ids, x, 5)
    assert top_k(df.filter("false"), F.col("vec_id") % 5 == 0).collect() == []
    assert top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 5 == 0).count() == 1


def exact(q, x, ids, k):
    want = x @ q
    order = np.lexsort((ids, -want))[:k]
    return ids[order].tolist(), want[order].tolist()


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    near = np.floor(256 * np.concatenate([rng.normal(size=(2000, 6)), 9 + rng.normal(size=(12, 6))]))
    plain = np.floor(256 * rng.normal(size=(4000, 64)))
    for x, most in ((near, 0.75), (plain, 0.95)):
        q = np.floor(256 * rng.normal(size=(70, x.shape[1])))
        ids = rng.permutation(len(x))
        found, read = nra(q, np.full(len(q), -1), x, ids, 5)
        assert read < most * q.size * len(x)  # brute force reads every component of every candidate
        for query, (best, score) in zip(q, found):
            assert (best.tolist(), score.tolist()) == exact(query, x, ids, 5)


def test_nra_small_and_tied():
    for n, k in ((1, 5), (2, 1), (5, 5), (9, 3), (40, 4)):
        x, ids = np.floor(np.arange(n * 2).reshape(n, 2) % 3.0), np.arange(n)[::-1].copy()
        for query, (best, score) in zip(x, nra(x, np.full(n, -1), x, ids, k)[0]):
            assert (best.tolist(), score.tolist()) == exact(query, x, ids, k)


def test_top_k_of_large_components(spark):
    data = [(0, [3.0, -2.0]), (1, [1e13, 1.0]), (2, [1e13, 1.00390625]), (3, [0.5, 7.0]), (4, [-1e13, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = {i: [int(256 * c) if abs(c) < 1e9 else int(c) * 256 for c in x] for i, x in data}
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 3 == 0, 4).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 3):
        order = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(order)]
    assert got == want
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k(spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e300, 1.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()
