"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path, stored
from ..session import ship
from .html import extract
from .jaccard import jaccard_components
from .mixing import Mix, mix_sources
from .packing import pack, pieces
from .ppm import score_documents
from .prefixes import conversation_trie
from .quality import quality_rules
from .sharding import shard
from .token_counts import token_counts
from .token_store import read_store, write_store
from .topics import TopicModel, with_topics
from .topk import top_k
from .urls import url_filter
from .whitening import whiten

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-store")
    write_store(docs, path, public_tokenizers.path(WORD_BPE), end_id=1)
    return read_store(spark, path, as_crc=True).select("doc_id", "start", "n_tokens", "ids_crc32", F.hex("root").alias("root"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, public_tokenizers.path(WORD_BPE), end_id=0, digest_only=True)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(BYTE_BPE))
    return counted.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 512).alias("over_limit"))


#: The mixture of the registered query and of the pipeline: the hot source held down, languages and topics by name, other sources by size.
MIXTURE = Mix(targets={"source": {"src0": 0.1}, "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}, "topic": {"good": 0.85, "poor": 0.14, "toxic": 0.01}}, budget=0.5)


def topic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> TopicModel:
    """Topics good, poor and toxic, from the documents that ``labels`` covers."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    topic = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return TopicModel.fit(docs, labels.select("doc_id", topic.alias("topic")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    model = topic_model(spark, docs, sf_dir)
    weighed = stored(with_topics(docs, model, tokenizer=public_tokenizers.path(WORD_BPE), keep_text=False), "weighed")
    return mix_sources(weighed, F.col("n_tokens"), F.col("topic"), MIXTURE).select("doc_id", "source", "lang", "n_tokens", "mix.*")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shard(docs, 24).select("doc_id", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules(docs).select("doc_id", "quality.*")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


#: The rules of the registered query, and hosts to block where no rule fits: names under every example domain.
ALLOW, BLOCK = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]
BLOCKED = [f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for top in ("com", "net", "org")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(host,) for host in BLOCKED], "host string")
    return url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK, listed).select("page_id", "host", "path", "rule", "verdict")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)
    each = white.select("vec_id", "white", F.posexplode(F.arrays_zip("white.whitened", "white.explained")).alias("at", "own"))
    deviation = F.col("white.deviation").try_cast("long")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "white.n", deviation.alias("deviation"), "own.whitened", "own.explained", "white.identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_ppm": op7_ppm,
    "op8_html": op8_html,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) >= 4 THEN w[i:i + 3] ELSE w END, ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.r) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.d = d.doc_id GROUP BY ALL
""",
    "op11_prefix_trie": """
WITH turns AS (
  SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(x ORDER BY i) AS xs, c - ((c % 20) + 20) % 20 AS b,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM turns GROUP BY c
), heads AS (
  SELECT c, xs, b, xor(crc, 4294967295) % 4 AS h FROM own
), whole AS (
  SELECT o.c, list_concat(coalesce(p.xs, [])[1:o.h], o.xs[o.h + 1:]) AS xs FROM heads o LEFT JOIN own p ON p.c = o.b
), prefixes AS (
  SELECT c, xs[1:d] AS p, d, len(xs) AS l FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM whole)
), nodes AS (
  SELECT p, d, min(c) AS m, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '')) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w
  FROM prefixes GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL
), made AS (
  SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children ON children.p = nodes.p
), below AS (
  SELECT p[1:a] AS p, sum((k = 0)::BIGINT)::BIGINT AS leaves, sum((n - 1) * w)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM made) GROUP BY ALL
)
SELECT made.m AS conv_id, made.d AS depth, up.m AS parent_conv_id, made.n AS n_convs, made.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, made.ends AS ends_sha256
FROM made JOIN below ON below.p = made.p LEFT JOIN made up ON made.d > 0 AND up.p = made.p[1:made.d - 1]
""",
    "op12_url_filter": f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), k AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rule) AS (
  VALUES {", ".join(f"('{verdict}', '{rule}')" for verdict, rules in (("allow", ALLOW), ("block", BLOCK)) for rule in rules)}
), s AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS top, substr(rule, instr(rule, '/')) AS rest FROM r
), best AS (
  SELECT page_id, arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) AS x
  FROM k JOIN s ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, rest) GROUP BY page_id
), listed AS (
  SELECT DISTINCT page_id FROM k JOIN (SELECT unnest({BLOCKED}) AS h) ON host = h OR ends_with(host, '.' || h)
)
SELECT k.page_id, k.host, k.path, x.rule AS rule, CASE WHEN x.verdict IS NOT NULL THEN x.verdict WHEN listed.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN best ON best.page_id = k.page_id LEFT JOIN listed ON listed.page_id = k.page_id
""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
