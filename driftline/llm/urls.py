"""Url filter: exact membership of listed keys by a cascade of Bloom filters.

Rules are a verdict and a key ``host/path``: a rule fits its host and all
subdomains where the url's path starts with the rule's; the longest one wins.
Hosts of a block list decide where no rule fits. Every url has a few keys that
could be listed: one for each shape (labels of the host, length of the path) that
occurs among the listed keys. All distinct keys of the corpus are the universe.

Level 1 of the cascade encodes the listed keys of the universe, level 2 the other
keys that pass level 1, level 3 the listed ones that pass level 2 as well, and so
on until no key is left. A key is listed if the first level to reject it is an
even one (or if it passes all of an odd number of levels). This holds for every
key of the universe, without false answers, so pages are judged in the scan, with
no join and no shuffle.

A filter's bits are set by the tasks and joined with bit_or. A cascade of up to
FILTER_BYTES (130 million listed keys or so) is broadcast; beyond, the keys of
urls are matched with the list by a shuffle join, with the same result.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
rule and no listed host; keys of a rule without a host fit nothing; rules of equal
length that fit one url: the one with the longer host wins; the same key in both
lists of rules is an error; listed hosts are compared in lower case (A-Z), null
ones and repeats are ignored; other columns are carried, and one with a result's
name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .names import fresh

#: Share of false positives of a level, as a power of 1/2, and bits for each key that this takes.
HALVINGS = 6
BITS = HALVINGS / math.log(2)
FILTER_BYTES = 256 << 20
LEVELS = 64
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * A + np.uint64(salt) * B
        h = (h ^ (h >> np.uint64(29))) * B
    return h ^ (h >> np.uint64(32))


def places(low: np.ndarray, high: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The HALVINGS bit numbers of each key (two hashes) in a level's filter; levels are independent of each other."""
    first, step = _mixed(low, 2 * level), _mixed(high, 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (first[:, None] + step[:, None] * np.arange(HALVINGS, dtype=np.uint64)) % np.uint64(bits)


def passes(words: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    at = places(low, high, level, 64 * len(words))
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def member(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    out = np.full(len(low), len(levels) % 2 == 1)
    left = np.arange(len(low))
    for level, words in enumerate(levels):
        ok = passes(words, low[left], high[left], level)
        out[left[~ok]] = level % 2 == 1
        left = left[ok]
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _filter(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The words of the filter of ``keys`` (low, high)."""

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = np.unique(places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), level, bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    set_ = keys.mapInArrow(task, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[set_.column("word").to_numpy()] = set_.column("mask").to_numpy().view(np.uint64)
    return words


def _passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)  # at most FILTER_BYTES

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, _unsigned(batch.column(0)), _unsigned(batch.column(1)), level)))

    return keys.mapInArrow(task, keys.schema)


def cascade(universe: DataFrame, limit: int = FILTER_BYTES) -> list[np.ndarray] | None:
    """Filters of the levels for the distinct keys of ``universe`` (low long, high long, listed boolean, stored); None if they would exceed ``limit`` bytes."""
    inside, outside = (universe.filter(where).select("low", "high") for where in ("listed", "NOT listed"))
    levels, room = [], limit
    while n := inside.count():
        bits = 64 * max(1, math.ceil(n * BITS / 64))
        room -= bits // 8
        if room < 0 or len(levels) == LEVELS:  # the latter: keys whose 128 bits are equal
            return None
        levels.append(_filter(inside, len(levels), bits))
        inside, outside = stored(_passing(outside, levels[-1], len(levels) - 1), "passing"), inside
    return levels


def _listed_in(spark: SparkSession, levels: list[np.ndarray]):
    """A function of columns (arrays of hashes): which of the keys are listed."""
    shared = spark.sparkContext.broadcast(levels)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def listed(low: pa.Array, high: pa.Array) -> pa.Array:
        found = member(shared.value, _unsigned(low.flatten()), _unsigned(high.flatten()))
        ends = np.concatenate([[0], np.cumsum(low.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))

    return listed


def _hash(key: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), key)


def _shapes(keys: list[str]) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) of all keys that have a host."""
    split = [(key.partition("/")[0], key) for key in keys]
    return sorted({(host.count(".") + 1, len(key) - len(host)) for host, key in split if host})


def _candidates(host: Column, path: Column, kind: str, shapes: list[tuple[int, int]]) -> list[Column]:
    """The url's keys of these shapes, each with its kind (five letters) in front; null where the url is too short."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    made = []
    for labels, length in shapes:
        fits = (F.length(host) > 0) & (dots >= labels - 1) & (F.length(path) >= length)
        made.append(F.when(fits, F.concat(F.lit(kind), F.substring_index(host, ".", -labels), F.substring(path, 1, length))))
    return made


def url_filter(df: DataFrame, allow: list[str], block: list[str], listed: DataFrame | None = None, url: str = "url", limit: int = FILTER_BYTES) -> DataFrame:
    """``df`` with host, path, rule and verdict (allow or block).

    ``allow`` and ``block``: rules ``host/path``. ``listed``: hosts to block where no rule fits (first column), subdomains included.
    """
    spark = df.sparkSession
    if both := set(allow) & set(block):
        raise ValueError(f"rules that allow and block: {sorted(both)}")
    if bad := [r for r in [*allow, *block] if "/" not in r]:
        raise ValueError(f"rules without a path: {bad}")
    low_case = str.maketrans(UPPER, LOWER)
    allow, block = ([r.partition("/")[0].translate(low_case) + "/" + r.partition("/")[2] for r in rules] for rules in (allow, block))
    if listed is not None:
        name = F.translate(F.col(f"`{listed.columns[0]}`"), UPPER, LOWER)
        listed = listed.select(name.alias("host")).filter("host <> ''").distinct()
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in FIELDS])
    host, path, keys, hits = fresh(df, "u_host", "u_path", "u_keys", "u_hits")
    own_host, own_path = host_and_path(F.col(f"`{url}`"))
    rows = rows.withColumn(host, own_host).withColumn(path, own_path)
    labels = [] if listed is None else [r[0] for r in listed.select((F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("n")).distinct().collect()]
    shapes = {"allow": _shapes(allow), "block": _shapes(block), "host ": [(n, 0) for n in labels]}
    made = [c for kind, own in shapes.items() for c in _candidates(F.col(host), F.col(path), kind, own)]
    none = F.array().cast("array<string>")
    rows = rows.withColumn(keys, F.array_compact(F.array(*made)) if made else none)
    universe = rows.select(F.explode(keys).alias("key")).distinct()
    ruled = spark.createDataFrame([(f"{kind}{rule}",) for kind, rules in (("allow", allow), ("block", block)) for rule in rules], "key string")
    every = ruled if listed is None else ruled.unionByName(listed.select(F.concat(F.lit("host "), "host").alias("key")))
    known = universe.join(every.distinct().withColumn("listed", F.lit(True)), "key", "left")
    known = stored(known.select("key", _hash(F.col("key"), 0).alias("low"), _hash(F.col("key"), 1).alias("high"), F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    levels = cascade(known, limit)
    if levels is None:
        rows = _joined(rows, known.filter("listed").select("key"), keys, hits)
    else:
        hashed = [F.transform(keys, lambda k: _hash(k, 0)), F.transform(keys, lambda k: _hash(k, 1))]
        marks = _listed_in(spark, levels)(*hashed)
        rows = rows.withColumn(hits, F.filter(F.transform(F.arrays_zip(F.col(keys).alias("key"), marks.alias("hit")), lambda z: F.when(z["hit"], z["key"])), lambda k: k.isNotNull()))
    return _judged(rows, host, path, keys, hits)


def _joined(rows: DataFrame, listed: DataFrame, keys: str, hits: str) -> DataFrame:
    """``rows`` with the listed ones of their keys, by a shuffle of distinct (row, key) pairs."""
    (at,) = fresh(rows, "u_row")
    rows = stored(rows.withColumn(at, F.monotonically_increasing_id()), "rows")
    found = rows.select(at, F.explode(keys).alias("key")).join(listed, "key", "left_semi").groupBy(at).agg(F.collect_list("key").alias(hits))
    none = F.array().cast("array<string>")
    return rows.join(found, at, "left").withColumn(hits, F.coalesce(F.col(hits), none)).drop(at)


def _judged(rows: DataFrame, host: str, path: str, keys: str, hits: str) -> DataFrame:
    """The longest rule among the hits, the longer host first among equals; a listed host where there is none."""
    rules = F.filter(hits, lambda k: ~k.startswith("host "))
    body = lambda k: F.substring(k, 6, 1 << 30)
    ranked = F.transform(rules, lambda k: F.struct(F.length(body(k)).alias("n"), F.instr(body(k), "/").alias("h"), body(k).alias("rule"), F.substring(k, 1, 5).alias("verdict")))
    best = F.array_max(ranked)
    other = F.when(F.exists(hits, lambda k: k.startswith("host ")), "block").otherwise("allow")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (host, path, keys, hits)]
    return rows.select(*kept, F.col(host).alias("host"), F.col(path).alias("path"), best["rule"].alias("rule"), F.coalesce(best["verdict"], other).alias("verdict"))
