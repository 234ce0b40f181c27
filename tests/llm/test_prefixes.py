"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from driftline.llm import prefixes
from driftline.llm.prefixes import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def conversations(rng, n, roles=("user", "assistant", None), texts=("", None, "a", "b c", "d  e\tf", "ü ß")):
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c * rng.choice([1, 1, 1, 7]), t, rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    seen, out = set(), []
    for r in rows:  # tied turns are ordered by digest, which this model does not follow
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


def got(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_matches_brute_force(spark, seed):
    rows = conversations(random.Random(seed), 150)
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_blocks_of_any_size_give_the_same_nodes(spark, monkeypatch):
    """Deep copies over many small blocks, joined two at a time, and pieces of three ids."""
    rows = conversations(random.Random(7), 60)
    deep = [(t, "user", f"turn {t}") for t in range(40)]
    rows += [(1000 + c, t, r, x) for c in range(90) for t, r, x in deep[: 40 - c % 7]]
    monkeypatch.setattr(prefixes, "FAN", 2)
    monkeypatch.setattr(prefixes, "PIECE", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "no conversation"), (-3, None, None, None), (-3, 0, "user", "x"), (-20, 5, "user", "head one"), (-20, 6, "user", "head two"),
        (5, 0, "user", "w " * 30_000), (6, 0, "user", "w " * 30_000), (25, 1, "user", "only"), (45, 1, "user", "only"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversation_trie(df.selectExpr("*", "conv_id AS d", "text AS `a.b`", "1 AS seq", "2 AS `at`"))) == brute(rows)
    assert conversation_trie(df.filter("false")).collect() == []
    one = [(7, 0, "user", "alone")]
    assert got(conversation_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)
    repeated = spark.createDataFrame([(1, 0, "user", "same")] * 3 + [(2, 0, "user", "same")] * 3, SCHEMA)
    assert [(r.depth, r.n_convs) for r in conversation_trie(repeated).orderBy("depth", "conv_id").collect()][0] == (0, 2)


def test_turnless_conversations_are_members_of_the_root(spark):
    """A conversation with fewer turns than h and no group head has no turns."""
    c = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c - c % 20 + 1000, 0, "user", "kept")]
    assert got(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert got(conversation_trie(spark.createDataFrame(rows[:1], SCHEMA))) == brute(rows[:1])


def test_query_matches_brute_force(spark):
    from driftline.llm.queries import op11_prefix_trie

    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_prefix_trie(spark, folder)) == brute(rows)
