"""Topics of texts by naive Bayes over hashed words, and their exact token counts, in one pass.

The model is fitted on labelled rows, at most TRAIN_ROWS of them (the least by a
digest of their id); its table is BUCKETS x topics. Every text is then read
whole: its topic is the class with the largest sum of log probabilities of its
words (lower case, A-Z) and its token count is the tokenizer's.

Defined cases: a text without words, and every text where no labelled row was
found, has the topic of the largest class, or '' without classes; ties go to the
class that sorts first; null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import coded, given_back, hashes, slices, texts_of, words_of
from .names import with_plain_names
from .tokens import encoder

TRAIN_ROWS, BUCKETS = 20_000, 1 << 16


def _buckets(distinct: pa.Array) -> np.ndarray:
    return (hashes(pc.ascii_lower(distinct)) % np.uint64(BUCKETS)).astype(np.int64)


class TopicModel:
    """Log probabilities of each bucket's words by class, with one added to each count, and of each class."""

    def __init__(self, rows: list[tuple[str, int, int]], docs: dict[str, int]):
        self.classes = sorted(docs)
        place = {c: k for k, c in enumerate(self.classes)}
        counts = np.ones((BUCKETS, len(self.classes)))
        for topic, bucket, n in rows:
            counts[bucket, place[topic]] += n
        self.words = np.log(counts / counts.sum(0))
        of = np.array([docs[c] for c in self.classes], float)
        self.prior = np.log(of / of.sum()) if len(of) else of

    @classmethod
    def fit(cls, df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> TopicModel:
        """From the rows of ``df`` whose key has a row (key, topic) in ``labels``; of a key's topics the first in order counts."""
        one = labels.filter(F.col(key).isNotNull() & F.col("topic").isNotNull()).groupBy(key).agg(F.min("topic").alias("topic"))
        some = one.orderBy(F.xxhash64(key), key).limit(rows)

        def task(batches):
            for batch in batches:
                texts, (of, topics) = texts_of(batch.column(0)), coded(batch.column(1))
                for lo, hi in slices(texts):
                    flat, offsets = words_of(texts.slice(lo, hi - lo))
                    codes, distinct = coded(flat)
                    cell = np.repeat(of[lo:hi], np.diff(offsets)) * np.int64(BUCKETS) + _buckets(distinct)[codes]
                    cell, n = np.unique(cell, return_counts=True)
                    docs, times = np.unique(of[lo:hi], return_counts=True)
                    topic = topics.take(pa.array(np.concatenate([cell // BUCKETS, docs])))
                    bucket = np.concatenate([cell % BUCKETS, np.full(len(docs), -1)])
                    yield pa.RecordBatch.from_arrays([topic, pa.array(bucket, pa.int64()), pa.array(np.concatenate([n, times]), pa.int64())], ["topic", "bucket", "n"])

        met = df.select(F.col(key).alias(key), F.col(text).alias("text")).join(F.broadcast(some), key).select("text", "topic")
        counts = met.mapInArrow(task, "topic string, bucket long, n long").groupBy("topic", "bucket").agg(F.sum("n").alias("n")).collect()
        return cls([tuple(r) for r in counts if r["bucket"] >= 0], {r["topic"]: r["n"] for r in counts if r["bucket"] < 0})

    def of(self, codes: np.ndarray, distinct: pa.Array, offsets: np.ndarray) -> pa.Array:
        """The topic of each text, from its words."""
        if not self.classes:
            return pa.array([""] * (len(offsets) - 1), pa.string())
        weight = self.words[_buckets(distinct)]
        score = np.empty((len(offsets) - 1, len(self.classes)))
        for k in range(len(self.classes)):
            total = np.concatenate([[0.0], np.cumsum(weight[codes, k])])
            score[:, k] = total[offsets[1:]] - total[offsets[:-1]] + self.prior[k]
        return pa.array(self.classes, pa.string()).take(pa.array(score.argmax(1)))


def with_topics(df: DataFrame, model: TopicModel, text: str = "text", topic: str = "topic", tokens: str | None = "n_tokens", tokenizer: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` with the column ``topic`` and, with a ``tokenizer`` file, ``tokens``; both replace columns of these names."""
    results = (topic, tokens) if tokenizer else (topic,)
    return with_plain_names(df, lambda d, n: _known(d, model, n[text], topic, tokens, tokenizer, keep_text), (text,), results)


def _known(df: DataFrame, model: TopicModel, text: str, topic: str, tokens: str | None, tokenizer: str | None, keep_text: bool) -> DataFrame:
    made = [topic, tokens] if tokenizer else [topic]
    rest = [c for c in df.columns if c not in made and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(topic, T.StringType())] + ([T.StructField(tokens, T.LongType())] if tokenizer else []))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            texts = texts_of(batch.column(len(rest)))
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                flat, offsets = words_of(part)
                codes, distinct = coded(flat)
                columns = [shared.value.of(codes, distinct, offsets)]
                if tokenizer:
                    columns.append(pa.array(encoder(tokenizer).counted(codes, distinct, offsets), pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(rest))), *columns], schema.names)
        given_back()

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("_")).mapInArrow(task, schema)
