"""The url filter against plain matching, and the cascade against a set."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm.queries import ALLOW, BLOCK, BLOCKED, op12_url_filter
from driftline.llm.urls import cascade, member, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.translate(low), slash + path


def brute(url, allow, block, listed):
    host, path = split(url)
    inside = lambda top: bool(top) and (host == top or host.endswith("." + top))
    fits = []
    for verdict, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            top, slash, rest = rule.partition("/")
            if inside(top) and path.startswith(slash + rest):
                fits.append((len(rule), len(top), rule, verdict))
    if fits:
        return host, path, *max(fits)[2:]
    return host, path, None, "block" if any(inside(h) for h in listed) else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "https://example.net/EN/x", "ftp://net/", "ftp://net", "x://net?/", "http://xnet/", "http://a.b.org/fr/", "http://org/fr", "http://org/fr/é#",
    "http://example.com/de/a://b", "http://m.example.com/en/://", "a://b://c/d", "http://bad.example.org", "http://worse.bad.example.org/x", "http://notbad.example.org/x", "http://É.net/\n/x", "http://u@bad.example.org:80/", "http://.net/", "http://..", "http://" + "a." * 3000 + "net/" + "p" * 5000,
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_filter_matches_plain_rules(spark, limit):
    rng = random.Random(3)
    hosts = ["net", "a.net", "example.net", "b.example.com", "c.org", "bad.example.org", "x.y.bad.example.org", "example.com"]
    urls = URLS + [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', 'fr/', ''])}{rng.choice(['', 'x', '?q', '#h'])}" for _ in range(200)]
    allow, block, listed = [*ALLOW, "a.net/abcdef", "Example.COM/de/allowed"], [*BLOCK, "/nohost", "net/abcdefgh"], ["Bad.example.org", None, "", "bad.example.org", "c.org"]
    urls += ["http://a.net/abcdefgh", "http://example.com/de/allowed/x"]
    rows = [(i % 50, u, "h", "p") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, Host string, `a.b` string").withColumn("u_keys", F.lit(1)).repartition(3)
    made = url_filter(df, allow, block, spark.createDataFrame([(h,) for h in listed], "h string"), limit=limit)
    assert made.columns == ["page_id", "url", "a.b", "u_keys", "host", "path", "rule", "verdict"]
    small = [r.replace("Example.COM", "example.com") for r in allow]
    expected = sorted((i % 50, str(u), *map(str, brute(u, small, block, ["bad.example.org", "c.org"]))) for i, u in enumerate(urls))
    assert sorted((r.page_id, str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in made.collect()) == expected


def test_cascade_is_exact_for_its_universe(spark):
    keys = spark.range(60_000).select(F.xxhash64(F.lit(0), "id").alias("low"), F.xxhash64(F.lit(1), "id").alias("high"), (F.col("id") % 7 == 0).alias("listed")).cache()
    levels = cascade(keys)
    assert len(levels) > 1
    rows = keys.toPandas()
    low, high = (rows[c].to_numpy().view(np.uint64) for c in ("low", "high"))
    assert (member(levels, low, high) == rows["listed"].to_numpy()).all()
    assert cascade(keys, limit=100) is None
    assert cascade(keys.filter("false")) == []


def test_empty_and_wrong_input(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter(df.filter("false"), ALLOW, BLOCK).collect() == []
    assert [tuple(r) for r in url_filter(df, [], []).collect()] == [(1, "http://a.net/", "a.net", "/", None, "allow")]
    with pytest.raises(ValueError):
        url_filter(df, ["net/"], ["net/"])
    with pytest.raises(ValueError):
        url_filter(df, ["net"], [])


def test_query_matches_plain_rules(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    expected = sorted((p.page_id, *map(str, brute(p.url, ALLOW, BLOCK, BLOCKED))) for p in pages)
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in op12_url_filter(spark, folder).collect()) == expected
