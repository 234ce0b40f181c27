"""The corpus pipeline: quality rules, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept, and gives a DataFrame that is written as Parquet before the
next one reads it. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.jaccard import near_duplicates
from driftline.llm.mixing import mix_sources
from driftline.llm.names import fresh
from driftline.llm.packing import pack, pieces
from driftline.llm.quality import quality_rules
from driftline.llm.queries import MIXTURE, topic_model
from driftline.llm.topics import with_topics
from driftline.scratch import stored
from driftline.session import ship

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules(docs, only_kept=True)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    ship(spark)
    return near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with their cells' calibrated probabilities: one pass weighs the cells in tokens, a second one draws."""
    ship(spark)
    (topic, out), names = fresh(docs, "topic", "mix"), docs.columns
    model = topic_model(spark, docs, sf_dir)
    cells = with_topics(docs.select("source", "lang", "text"), model, tokenizer=public_tokenizers.path(TOKENIZER), keep_text=False)
    weighed = cells.select("source", "lang", "topic", F.col("n_tokens").alias("n"))
    known = with_topics(docs, model, topic=topic)
    return mix_sources(known, F.lit(0), F.col(topic), MIXTURE, out=out, weighed=weighed).filter(F.col(out)["kept"]).select(*[F.col(f"`{c}`") for c in names])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids and places in sequences."""
    ship(spark)
    made = pieces(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), end_id=0, digest_only=True)
    return pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicated), ("mixing to target weights", mixed), ("best-fit packing", packed)]
#: Summaries, raking and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
