"""Language-model scores by prediction by partial matching (PPM) over bytes.

A trie of byte contexts of up to ORDER bytes is trained on the training
documents: counts of what follows each context, method D escapes (half a count
of each distinct follower goes to the escape) and symbol exclusion on the way down to
shorter contexts, and last a uniform choice of 256 bytes and an end. A text's
score is the sum of log10 probabilities of its bytes and its end.

The trie is never cut and never in one place. A window is a symbol with the ORDER
before it. Distinct windows of all documents are counted, pre-aggregated in each
task and summed by Spark, and dealt by the SPLIT bytes next to the symbol: all
contexts of SPLIT bytes and more that a window's price needs are in its own
part, and the shorter ones are broadcast: at most 257 ** SPLIT counts, whatever
the corpus. So every distinct window gets its exact price in one pass
(``priced``). Of these prices the CACHE most frequent windows' are broadcast, and
texts are scored against them; what a document has beyond is listed and joined
with the table of all prices. The score does not depend on CACHE.

The base score is that of single words with one added to each count. Counts of
the FREQUENT most frequent words are broadcast; the other words of a document are
joined with the table of all words. Words are told apart by 64-bit hashes.

``adaptive_score`` is the same model trained on the text itself as it goes.

Defined cases: null and empty texts have an end alone; a null id counts as the
text 'null' when held-out documents are chosen; repeated rows are trained on and
scored one by one; very long texts are scored whole; with no training documents
every byte costs log10(257); an empty table gives an empty result; other input
columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import new_path, stored
from .arrowtext import bytes_of, coded, given_back, hashes, owners, slices, summed, sums, texts_of, words_of

ORDER, SPLIT = 5, 3
#: Prices of windows and counts of words that are broadcast; the others are joined.
CACHE, FREQUENT = 1 << 20, 1 << 18
END, PAD, BITS, SYMBOLS = 256, 257, 9, 257
WORD, GRAM, DOCS = 0, 1, 2
#: A task sorts the windows of so many bytes at once, and scores so many; both take about 40 times the memory.
TRAIN_BYTES, SCORE_BYTES = 3 << 20, 2 << 20
#: Distinct windows that a counting task holds before it hands them on.
HELD = 1 << 20


def held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % parts == part


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ORDER pads, the bytes and an end of each text in one array, and each text's range in it."""
    data, offsets = bytes_of(texts)
    ends = offsets + np.arange(len(offsets)) * (ORDER + 1)
    out = np.full(len(data) + (ORDER + 1) * len(texts), PAD, np.uint16)
    out[np.arange(len(data)) + ORDER + owners(offsets) * (ORDER + 1)] = data
    out[ends[1:] - 1] = END
    return out, ends


def grams(s: np.ndarray) -> np.ndarray:
    """The windows of ORDER + 1 symbols that end in a byte or an end."""
    code = np.zeros(max(0, len(s) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(BITS)) | s[k : len(s) - ORDER + k].astype(np.uint64)
    return code[s[ORDER:] != PAD]


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[at], np.diff(np.append(at, len(code)))


COUNTS = "kind int, code long, n long, seen long"


def _counts(kind: int, code: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind), pa.int32()), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], ["kind", "code", "n", "seen"])


def _counted(batches):
    """Words of training texts, and windows of all texts: ``n`` counts in training, ``seen`` in all."""
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        return summed(*(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        texts, out = texts_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in slices(texts, TRAIN_BYTES):
            part = pc.ascii_lower(texts.slice(lo, hi - lo))
            for trained in (True, False):
                own = part.filter(pa.array(out[lo:hi] != trained))
                if not len(own):
                    continue
                code, n = counted(grams(symbols(own)[0]).view(np.int64))
                held.append((code, n if trained else np.zeros_like(n), n))
                if trained:
                    codes, distinct = coded(words_of(own)[0])
                    words = np.bincount(codes, minlength=len(distinct))
                    yield _counts(WORD, hashes(distinct).view(np.int64), words, words)
                    yield _counts(DOCS, np.zeros(1, np.int64), np.array([len(own)]), np.array([len(own)]))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield _counts(GRAM, *held.pop())
    if held:
        yield _counts(GRAM, *merged())
    held.clear()
    given_back()


class Level:
    """Counts of one order: of each (context, symbol), and of each context the total, the number of followers, and
    ``inner``, how often these followers stand after the context one shorter."""

    def __init__(self, k: int, code: np.ndarray, n: np.ndarray, below: Level | None):
        self.k, self.code, self.n = k, code, n
        context = code >> BITS
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)
        self.context, self.total, self.kinds = context[at], add(n), add(np.ones(len(code), np.int64))
        self.inner = add(below.count(code & mask(k))) if below else np.zeros(len(at), np.int64)

    @classmethod
    def of(cls, k: int, code: np.ndarray, n: np.ndarray, below: Level | None) -> Level:
        """Level k from (longer) windows."""
        return cls(k, *summed(code & mask(k + 1), n), below)

    def count(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code), np.int64)
        at, met = self._found(self.code, code)
        return np.where(met, self.n[at], 0)

    @staticmethod
    def _found(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        return at, names[at] == asked

    def figures(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Total, followers and inner count of each code's context; 0 where it was not met in training."""
        if not len(self.context):
            return (np.zeros(len(code), np.int64),) * 3
        at, met = self._found(self.context, code >> BITS)
        return tuple(np.where(met, x[at], 0) for x in (self.total, self.kinds, self.inner))


def mask(digits: int) -> int:
    return (1 << BITS * digits) - 1


def low_levels(code: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels 0 to SPLIT - 1 from the counts of the last of them."""
    out: list[Level] = []
    for k in range(SPLIT):
        out.append(Level.of(k, code, n, out[-1] if out else None))
    return out


def prices(code: np.ndarray, n: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of each of these distinct windows; they are all there are of their SPLIT-byte contexts."""
    levels = list(low)
    known = n > 0
    for k in range(SPLIT, ORDER + 1):
        levels.append(Level.of(k, code[known], n[known], levels[-1]))
    p, left = np.ones(len(code)), np.ones(len(code), bool)
    inner, kinds = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)  # what the longer context's followers take away
    for level in reversed(levels):
        own = code & mask(level.k + 1)
        total, followers, below = level.figures(own)
        c, free = level.count(own), total - inner
        open_ = left & (free > 0)
        twice = 2 * np.maximum(free, 1)
        p = np.where(open_, p * np.where(c > 0, 2 * c - 1, followers - kinds) / twice, p)
        left &= ~(open_ & (c > 0))
        inner, kinds = np.where(total > 0, below, inner), np.where(total > 0, followers, kinds)
    return np.log10(np.where(left, p / np.maximum(SYMBOLS - kinds, 1), p))


def _priced(low):
    def task(batches):
        parts = [[b.column(k).to_numpy() for k in range(3)] for b in batches]
        if not parts:
            return
        code, n, seen = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(code)
        code, n, seen = code[order], n[order], seen[order]
        cost = prices(code, n, low.value)
        for lo in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (code, seen, cost)], ["code", "seen", "cost"])

    return task


def priced(windows: DataFrame) -> DataFrame:
    """(code, seen, cost) of all distinct windows (code, n, seen)."""
    spark = windows.sparkSession
    digits = F.col("code").bitwiseAND(F.lit(mask(SPLIT)))
    short = windows.filter("n > 0").groupBy(digits.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast(low_levels(short["code"].to_numpy(), short["n"].to_numpy()))
    near = F.shiftright("code", BITS).bitwiseAND(F.lit(mask(SPLIT)))
    return windows.select("code", "n", "seen").repartition(near).mapInArrow(_priced(low), "code long, seen long, cost double")


def frequent(table: DataFrame, by: str, limit: int) -> int:
    """The least value of ``by`` for which no more than ``limit`` rows have it or more; values count in steps of an eighth of a doubling."""
    step = F.floor(8 * F.log2(F.col(by).cast("double"))).cast("int")
    cut, total = None, 0
    for r in sorted(table.filter(F.col(by) > 0).groupBy(step.alias("step")).agg(F.min(by).alias("least"), F.count("*").alias("rows")).collect(), reverse=True):
        total += r["rows"]
        if total > limit:
            break
        cut = r["least"]
    return cut if cut is not None else (1 << 63) - 1


class Cache:
    """Prices of the most frequent windows: two hash tables with one place for each slot, and a sorted list of what found none."""

    MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, code: np.ndarray, cost: np.ndarray):
        self.given, self.tables = (code, cost), None

    def __getstate__(self):
        return self.given

    def __setstate__(self, state):
        self.__init__(*state)

    def _slot(self, k: int, bits: int, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * self.MIX[k]) >> np.uint64(64 - bits)).astype(np.int64)

    def _build(self) -> None:
        (code, cost), self.given, self.tables = self.given, None, []
        for k in range(2):
            bits = max(4, int(2 * len(code)).bit_length())
            names, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float64)
            slot = self._slot(k, bits, code)
            names[slot] = code  # of those with one slot the last stays
            mine = names[slot] == code
            values[slot[mine]] = cost[mine]
            self.tables.append((bits, names, values))
            code, cost = code[~mine], cost[~mine]
        order = np.argsort(code)
        self.rest = code[order], cost[order]

    def costs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The price of each window (0 where there is none here), and the places of those without."""
        if self.tables is None:
            self._build()
        cost, open_ = np.zeros(len(code)), None
        for k, (bits, names, values) in enumerate(self.tables):
            asked = code if open_ is None else code[open_]
            slot = self._slot(k, bits, asked)
            hit = names[slot] == asked
            if open_ is None:
                np.multiply(values[slot], hit, out=cost)
                open_ = np.flatnonzero(~hit)
            else:
                cost[open_[hit]] = values[slot[hit]]
                open_ = open_[~hit]
        names, values = self.rest
        if len(names) and len(open_):
            at = np.minimum(np.searchsorted(names, code[open_]), len(names) - 1)
            hit = names[at] == code[open_]
            cost[open_[hit]] = values[at[hit]]
            open_ = open_[~hit]
        return cost, open_

    def opened(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each (lower-cased) text without its windows that are not here, and text and code of each of these."""
        raw, ends = symbols(texts)
        code = grams(raw).view(np.int64)
        cost, open_ = self.costs(code)
        edges = np.concatenate([[0], np.cumsum(np.diff(ends) - ORDER)])
        return sums(cost, edges), np.searchsorted(edges, open_, "right") - 1, code[open_]


class Base:
    """log10 of a word's share with one added, for the frequent words."""

    def __init__(self, rows: pa.Table, words: int, distinct: int, docs: int):
        h = rows["code"].to_numpy()
        at = np.argsort(h)
        self.hashes, self.counts = h[at], rows["n"].to_numpy()[at]
        self.tokens = words + docs
        self.denominator = self.tokens + distinct + (docs > 0) + 1
        self.end = docs

    def log(self, counts):
        return np.log10((np.asarray(counts, np.float64) + 1) / self.denominator)


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,n:int>>, open array<struct<h:long,n:int>>"


def _listed(row: np.ndarray, which: np.ndarray, names: np.ndarray, rows: int) -> pa.ListArray:
    """For each row its distinct names with their number; ``which`` are places in ``names``."""
    width = max(len(names), 1)
    pair, times = np.unique(row * np.int64(width) + which, return_counts=True)
    lists = np.concatenate([[0], np.cumsum(np.bincount(pair // width, minlength=rows))]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(names[pair % width], pa.int64()), pa.array(times, pa.int32())], ["h", "n"])
    return pa.ListArray.from_arrays(pa.array(lists), struct)


def _scored(model):
    def task(batches):
        cache, base = model.value
        for batch in batches:
            texts = texts_of(batch.column(3))
            for lo, hi in slices(texts, SCORE_BYTES):
                part = pc.ascii_lower(texts.slice(lo, hi - lo))
                flat, offsets = words_of(part)
                codes, distinct = coded(flat)
                h = hashes(distinct).view(np.int64)
                at = np.minimum(np.searchsorted(base.hashes, h), max(len(base.hashes) - 1, 0))
                known = base.hashes[at] == h if len(base.hashes) else np.zeros(len(h), bool)
                value = np.where(known, base.log(base.counts[at]), 0) if len(base.hashes) else np.zeros(len(h))
                n = np.diff(offsets)
                rare = ~known[codes]
                score, row, code = cache.opened(part)
                code, which = np.unique(code, return_inverse=True)
                end_known = int(base.end > 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(n + 1, pa.int64()), pa.array(sums(known[codes].astype(np.int8), offsets) + end_known, pa.int64()),
                     pa.array(sums(value[codes], offsets) + base.log(base.end), pa.float64()), pa.array(score, pa.float64()),
                     _listed(owners(offsets)[rare], codes[rare], h, hi - lo), _listed(row, which, code, hi - lo)],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "open"],
                )
        given_back()

    return task


def score_documents(df: DataFrame, held: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows with ``held`` are not trained on."""
    spark = df.sparkSession
    held = held_out(F.col(key)) if held is None else F.coalesce(held, F.lit(False))
    counts = df.select(F.col(text).alias("text"), held.alias("held")).mapInArrow(_counted, COUNTS)
    counted_at, prices_at = new_path(spark, "counts"), new_path(spark, "prices")
    counts = stored(counts.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts", counted_at)
    words = counts.filter(F.col("kind") == WORD)
    size = {r["kind"]: r for r in counts.filter(F.col("kind") != GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    total = lambda kind, what: size[kind][what] if kind in size else 0
    common = words.filter(F.col("n") >= frequent(words, "n", FREQUENT)).select("code", "n").toArrow()
    base = Base(common, total(WORD, "n"), total(WORD, "distinct"), total(DOCS, "n"))
    cost = stored(priced(counts.filter(F.col("kind") == GRAM)), "prices", prices_at)
    often = frequent(cost, "seen", CACHE)
    held_here = cost.filter(F.col("seen") >= often).select("code", "cost").toArrow()
    model = spark.sparkContext.broadcast((Cache(held_here["code"].to_numpy(), held_here["cost"].to_numpy()), base))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    scored = stored(rows.mapInArrow(_scored(model), SCORED), "scored")
    listed = lambda name: scored.select("rid", F.explode(name).alias("w")).select("rid", F.lit(name == "open").alias("window"), F.col("w.h").alias("code"), F.col("w.n").alias("times"))
    known = words.select(F.lit(False).alias("window"), "code", "n", F.lit(None).cast("double").alias("cost"))
    known = known.unionByName(cost.filter(F.col("seen") < often).select(F.lit(True).alias("window"), "code", F.lit(None).cast("long").alias("n"), "cost"))
    found = listed("rare").unionByName(listed("open")).join(known, ["window", "code"], "left")
    share = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(base.denominator)))
    word = F.when(~F.col("window"), F.col("times"))
    found = found.groupBy("rid").agg(F.sum(word * share).alias("more"), F.sum(F.when(F.col("n").isNotNull(), word).otherwise(0)).alias("met"), F.sum(F.col("times") * F.col("cost")).alias("open_score"))
    out = scored.drop("rare", "open").join(found, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), F.lit(int(base.tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("open_score", F.lit(0.0))).alias("score"),
    )


def adaptive_score(data: bytes, order: int = ORDER) -> float:
    """log10 probability of ``data`` and its end by a trie that learns each byte after predicting it."""
    trie: dict[bytes, dict[int, int]] = {}
    out = 0.0
    for i, symbol in enumerate([*data, END]):
        excluded: set[int] = set()
        p = 1.0
        for k in range(min(order, i), -1, -1):
            held = {s: n for s, n in trie.get(data[i - k : i], {}).items() if s not in excluded}
            n = sum(held.values())
            if not n:
                continue
            if symbol in held:
                p *= (2 * held[symbol] - 1) / (2 * n)
                break
            p *= len(held) / (2 * n)
            excluded |= held.keys()
        else:
            p /= SYMBOLS - len(excluded)
        out += math.log10(p)
        for k in range(min(order, i) + 1):
            follow = trie.setdefault(data[i - k : i], {})
            follow[symbol] = follow.get(symbol, 0) + 1
    return out
