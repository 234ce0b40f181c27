"""Quality rules by distribution divergence.

A document is compared with references of its language: the distribution of
its characters over classes, and of its words over the language's most common
words. The distance is Jensen-Shannon's (square root of the divergence in
bits, 0 to 1). References are exact counts over all documents: classes of
characters, and words by language, pre-aggregated in each task and summed by
Spark; the most common ones are ranked part by part before they meet, so no
language is one task's work. Words are told apart by 64-bit hashes. Counts do not
depend on how rows are dealt.

Guards: below ``min_chars`` code points the class test is not applied, below
``min_words`` words the word test is not. The word test's limit for n words is
``max_word_distance + word_allowance / sqrt(n)``, since the histogram of a short
text strays from its language's by chance alone. So short clean texts stay.

Defined cases: a null or empty text has no words and fails the base rule; a
null or unknown language is compared with the pooled reference of all
languages; beyond the MAX_LANGS languages of most words a text is judged by the pool, too; each repeated row is judged
by itself; an empty table gives an empty result; an input column that has the name of the result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .arrowtext import bytes_of, coded, given_back, hashes, lists_of, mixed, owners, slices, summed, sums, texts_of, windows, words_of
from .names import with_plain_names

#: Distinct words that a counting task holds before it hands them on, and languages with a reference of their own.
HELD, MAX_LANGS = 1 << 20, 1 << 11
SYMBOLS = "#*$%&|<>"
#: Character classes: lower, upper, digit, white space, sentence marks, other marks, symbols, other letters.
CLASSES = 8
POOL = ""


def _class_table() -> np.ndarray:
    """Class of each byte; UTF-8 continuation bytes get none (CLASSES)."""
    out = np.full(256, 5, np.uint8)
    for first, last, kind in ((0x61, 0x7A, 0), (0x41, 0x5A, 1), (0x30, 0x39, 2), (0x09, 0x0D, 3), (0x80, 0xBF, CLASSES), (0xC0, 0xFF, 7)):
        out[first : last + 1] = kind
    out[0x20] = 3
    for c in ".,;:!?'\"-()":
        out[ord(c)] = 4
    for c in SYMBOLS:
        out[ord(c)] = 6
    return out


CLASS_OF = _class_table()
IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])


@dataclass(frozen=True)
class Rules:
    """Parameters: the base rule's limits, and the method's."""

    min_words_base: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    common_words: int = 48
    min_chars: int = 80
    min_words: int = 40
    max_class_distance: float = 0.33
    max_word_distance: float = 0.26
    word_allowance: float = 1.4


def class_counts(texts: pa.Array) -> np.ndarray:
    """Code points of each class, one row for each text."""
    data, offsets = bytes_of(texts)
    cells = owners(offsets) * (CLASSES + 1) + CLASS_OF[data]
    return np.bincount(cells, minlength=len(texts) * (CLASSES + 1)).reshape(len(texts), CLASSES + 1)[:, :CLASSES]


def plain_words(values: pa.Array) -> pa.Array:
    """Lower case, without sentence marks around: the form in which common words are counted."""
    return pc.utf8_trim(pc.utf8_lower(values), characters=".,;:!?'\"()")


class Words(NamedTuple):
    """Words of some texts: codes into the distinct ones, and each text's range."""

    codes: np.ndarray
    distinct: pa.Array
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        flat, offsets = words_of(texts)
        return cls(*coded(flat), offsets)


def base_measures(texts: pa.Array, words: Words, rules: Rules) -> dict[str, np.ndarray]:
    codes, distinct, offsets = words
    n = np.diff(offsets)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    data, ends = bytes_of(texts)
    lines, at = lists_of(pc.split_pattern(texts, "\n"))
    real = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    line_codes, _ = coded(lines)
    row = owners(at)[real]
    seen = np.unique(row * np.int64(len(lines) + 1) + line_codes[real])
    n_lines = np.bincount(row, minlength=len(texts))
    n_distinct = np.bincount(seen // (len(lines) + 1), minlength=len(texts))
    return {
        "n_words": n,
        "word_chars": sums(length[codes], offsets),
        "n_symbols": sums(IS_SYMBOL[data].astype(np.int8), ends),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": repeated_words(codes, distinct, offsets, rules.repeat_window),
    }


def repeated_words(codes: np.ndarray, distinct: pa.Array, offsets: np.ndarray, width: int) -> np.ndarray:
    """Words inside windows of ``width`` words that their text holds twice or more."""
    row = owners(offsets)
    h = windows(hashes(distinct)[codes], width)
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(h):
        starts = np.flatnonzero(row[: len(h)] == row[width - 1 :])
        key = mixed(h[starts] ^ mixed(row[starts].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered[starts[twice]] += 1
        covered[starts[twice] + width] -= 1
    return sums((np.cumsum(covered[:-1]) > 0).astype(np.int8), offsets)


def base_failed(m: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    return (m["n_words"] < rules.min_words_base) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of count rows ``p`` from reference rows ``q``; an empty row is at distance 0."""
    total = p.sum(1, keepdims=True)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    p = np.where(total > 0, p / np.maximum(total, 1), q)
    m = (p + q) / 2

    def against(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(1)

    return np.sqrt(np.maximum(0, (against(p) + against(q)) / 2))


def diverges(texts: pa.Array, n_words: np.ndarray, by_class: np.ndarray, by_word: np.ndarray, rules: Rules) -> np.ndarray:
    """The method's verdict, with its guards of length."""
    long_enough = pc.utf8_length(texts).to_numpy(zero_copy_only=False) >= rules.min_chars
    limit = rules.max_word_distance + rules.word_allowance / np.sqrt(np.maximum(n_words, 1))
    return long_enough & (by_class > rules.max_class_distance) | (n_words >= rules.min_words) & (by_word > limit)


CLASS, TOTAL, COMMON = 0, 1, 2


def _counted(batches):
    """(lang, kind, item, n): characters by class, words in all, and each word (by its hash) but the empty one."""
    fixed: dict[str, np.ndarray] = {}
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows(lang: str, kind: int, item: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), pa.array(np.full(len(item), kind), pa.int32()), pa.array(item, pa.int64()), pa.array(n, pa.int64())], ["lang", "kind", "item", "n"])

    def merged():
        for lang, parts in held.items():
            yield lang, summed(*(np.concatenate(x) for x in zip(*parts)))

    for batch in batches:
        texts = texts_of(batch.column(0))
        lang_codes, langs = coded(pc.fill_null(batch.column(1).cast(pa.string()), POOL))
        langs = langs.to_pylist()
        for lo, hi in slices(texts):
            part, of = texts.slice(lo, hi - lo), lang_codes[lo:hi]
            counts = class_counts(part)
            words = Words.of(part)
            plain_codes, plain = coded(plain_words(words.distinct))
            codes = plain_codes[words.codes] if len(words.codes) else words.codes
            names, real = hashes(plain).view(np.int64), pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0
            row = owners(words.offsets)
            for k in np.unique(of):
                lang, mine = langs[k], of == k
                n = np.bincount(codes[mine[row]], minlength=len(names))
                fixed[lang] = fixed.get(lang, 0) + np.append(counts[mine].sum(0), n.sum())
                at = np.flatnonzero((n > 0) & real)
                held.setdefault(lang, []).append((names[at], n[at]))
                size += len(at)
            if size > HELD:
                held = {lang: [own] for lang, own in merged()}
                size = sum(len(own[0][0]) for own in held.values())
                if size > HELD // 2:
                    yield from (rows(lang, COMMON, *own[0]) for lang, own in held.items())
                    held, size = {}, 0
    for lang, n in fixed.items():
        yield rows(lang, CLASS, np.arange(CLASSES), n[:CLASSES])
        yield rows(lang, TOTAL, np.zeros(1, np.int64), n[CLASSES:])
    for lang, own in merged():
        yield rows(lang, COMMON, *own)
    held.clear()
    given_back()


def references(df: DataFrame, rules: Rules, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of all documents: (lang, kind, item, n) of every class, the words in all and the most common words (ties: the lesser hash); lang '' is the pool."""
    parts = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(_counted, "lang string, kind int, item long, n long")
    own = stored(parts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "words")
    pool = own.groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("lang"), "kind", "item", "n")
    most = own.filter((F.col("kind") == TOTAL) & (F.col("lang") != POOL)).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).select("lang")
    every = own.join(F.broadcast(most), "lang", "left_semi").unionByName(pool)  # MAX_LANGS names at most
    common = every.filter(F.col("kind") == COMMON)
    for by in (["lang", F.pmod("item", F.lit(32))], ["lang"]):  # first among a 32nd of the words, so that few meet in one task
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item"))
        common = common.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words).drop("rank")
    return every.filter(F.col("kind") != COMMON).unionByName(common)


class Reference:
    """The collected references: a few dozen numbers for each language."""

    def __init__(self, rows):
        self.chars: dict[str, np.ndarray] = {}
        words: dict[str, list[tuple[int, int]]] = {}
        total: dict[str, int] = {}
        for r in rows:
            if r["kind"] == CLASS:
                self.chars.setdefault(r["lang"], np.zeros(CLASSES))[r["item"]] = r["n"]
            elif r["kind"] == TOTAL:
                total[r["lang"]] = r["n"]
            else:
                words.setdefault(r["lang"], []).append((r["item"], r["n"]))
        #: By language: the hashes of its common words in rising order, and their counts with that of all others last.
        self.words: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in self.chars:
            own = np.array(sorted(words.get(lang, [])), np.int64).reshape(-1, 2)
            self.words[lang] = own[:, 0].copy(), np.append(own[:, 1], max(0, total.get(lang, 0) - own[:, 1].sum())).astype(float)

    def distances(self, texts: pa.Array, words: Words, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class distance and word distance of each text from its language's reference."""
        counts, row = class_counts(texts), owners(words.offsets)
        names = hashes(plain_words(words.distinct)).view(np.int64)
        by_class, by_word = np.zeros(len(texts)), np.zeros(len(texts))
        of, values = coded(pa.array([x if x in self.chars else POOL for x in langs], pa.string()))
        for k, lang in enumerate(values.to_pylist()):
            mine = np.flatnonzero(of == k)
            by_class[mine] = js_distance(counts[mine], self.chars[lang][None, :])
            common, reference = self.words[lang]
            column = np.full(len(names), len(common))
            if len(common):
                at = np.minimum(np.searchsorted(common, names), len(common) - 1)
                column = np.where(common[at] == names, at, len(common))
            place = np.zeros(len(texts), np.int64)
            place[mine] = np.arange(len(mine))
            own = of[row] == k
            width = len(common) + 1
            cells = place[row[own]] * width + column[words.codes[own]]
            by_word[mine] = js_distance(np.bincount(cells, minlength=len(mine) * width).reshape(len(mine), width), reference[None, :])
        return by_class, by_word


MEASURES = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(k, T.DoubleType()) for k in ("class_distance", "word_distance")]
)


def quality_rules(df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", out: str = "quality", only_kept: bool = False) -> DataFrame:
    """``df`` with a struct column ``out`` of MEASURES; with ``only_kept``, the kept rows as they came, without it.

    The references are collected to the driver: CLASSES + common_words + 1
    numbers for each of the MAX_LANGS languages of most words, whatever the number of documents.
    """
    return with_plain_names(df, lambda d, n: _judged(d, rules, n[text], n[lang], out, only_kept), (text, lang), () if only_kept else (out,))


def _judged(df: DataFrame, rules: Rules, text: str, lang: str, out: str, only_kept: bool) -> DataFrame:
    reference = Reference(references(df, rules, text, lang).collect())
    names = [c for c in df.columns if only_kept or c != out]
    at_text, at_lang = df.columns.index(text), df.columns.index(lang)
    keep_at = [df.columns.index(c) for c in names]
    schema = T.StructType([df.schema[c] for c in names] + ([] if only_kept else [T.StructField(out, MEASURES)]))
    reference_of = df.sparkSession.sparkContext.broadcast(reference)

    def task(batches):
        ref = reference_of.value
        for batch in batches:
            texts = texts_of(batch.column(at_text))
            langs = pc.fill_null(batch.column(at_lang).cast(pa.string()), POOL).to_pylist()
            parts = []
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                words = Words.of(part)
                m = base_measures(part, words, rules)
                failed = base_failed(m, rules)
                by_class, by_word = ref.distances(part, words, langs[lo:hi])
                parts.append([*m.values(), failed, ~failed & ~diverges(part, m["n_words"], by_class, by_word, rules), by_class, by_word])
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t.dataType.typeName() != "boolean" and np.int64 or bool) for t in MEASURES]
            rest = [batch.column(k) for k in keep_at]
            if only_kept:
                yield pa.RecordBatch.from_arrays(rest, names).filter(pa.array(columns[6].astype(bool)))
            else:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                made = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], MEASURES.names)
                yield pa.RecordBatch.from_arrays([*rest, made], [*names, out])
        given_back()

    return df.mapInArrow(task, schema)
