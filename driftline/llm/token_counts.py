"""Token counts by a map-side two-tier lookup of pre-tokens.

A pre-token here is one white-space character or none and the run up to the next
white space; a run of sentence marks at its end stands by itself. The byte-level
tokenizer never merges across these edges, so the count of a text is the sum over
its pre-tokens. Tier 1 is a broadcast Arrow table of the corpus's frequent
pre-tokens with their lengths, looked up by Arrow's hash; its size is a parameter.
Tier 2 is each worker's bounded cache, filled by the library. No pre-token is
shuffled: each task sums up its frequent ones (Misra-Gries) into one bounded row,
and those rows are merged in two levels.

Texts with longer runs of white space are cut by a regular expression that keeps
such runs whole, as the tokenizer's own pattern does.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted one by one; an empty table gives an empty result; an input column that
has the name of the result column is replaced.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arrowtext import HeavyHitters, coded, lists_of, slices, strings, sums, texts_of
from .names import with_plain_names
from .tokens import CACHE_WORDS, MARKS

FREQUENT = 32_768
#: White space as the tokenizer's pattern has it.
SPACE = "\t-\r \u0085   -     　"
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """This worker's counter for a file; it lives as long as the worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts with their white space, and each text's range."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n")
    flat, offsets = lists_of(pc.split_pattern(marked, "\x00"))
    codes, distinct = coded(flat)
    # an empty first piece is a text that begins with white space: no pre-token, and no harm
    odd = pc.match_substring_regex(distinct, f"[{SPACE}]$").to_numpy(zero_copy_only=False)[codes]
    irregular = (sums(odd.astype(np.int8), offsets) > 0) | pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
    if irregular.any():
        lists = [None] * len(texts)
        bare = texts.filter(pa.array(irregular)).to_pylist()
        for k, text in zip(np.flatnonzero(irregular), bare):
            lists[k] = RUNS.findall(text)
        keep = np.repeat(~irregular, np.diff(offsets))
        n = np.where(irregular, [len(x) if x else 0 for x in lists], np.diff(offsets))
        more = pa.array([x for own in lists if own for x in own], pa.string())
        # regular pieces and the others in the order of their texts
        place = np.empty(int(n.sum()), np.int64)
        mine = np.repeat(~irregular, n)
        place[mine], place[~mine] = np.arange(int(keep.sum())), int(keep.sum()) + np.arange(len(more))
        flat = pa.concat_arrays([flat.filter(pa.array(keep)), more]).take(pa.array(place))
        offsets = np.concatenate([[0], np.cumsum(n)])
    return flat, offsets


def parted(distinct: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each pre-token without the sentence marks at its end, where a letter or digit stands before them; and those marks."""
    core = pc.ascii_rtrim(distinct, characters=MARKS)
    core = pc.if_else(pc.match_substring_regex(core, "[\\pL\\pN]$"), core, distinct)
    n = pc.binary_length(distinct).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)
    tails = np.full(len(n), "", object)
    at = np.flatnonzero(n)
    if len(at):
        tails[at] = [w[-k:] for w, k in zip(strings(distinct.take(pa.array(at))), n[at])]
    return core, pa.array(tails, pa.string())


class PieceCounter:
    """Numbers of tokens of pre-tokens, kept for as long as the worker lives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        if step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("counting by pre-tokens needs a byte-level file without normaliser or prefix space")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.spelling = {b: b if b in plain else next(others) for b in range(256)}
        self.space = chr(self.spelling[0x20])
        self.known: dict[str, int] = {"": 0}

    def _one(self, piece: str) -> int:
        """A word of letters, perhaps after a space, needs the BPE model alone; anything else goes through the whole library."""
        space = piece[0] == " "
        word = piece[1:] if space else piece
        if word.isalpha():
            word = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelling)
            return len(self.model.tokenize(self.space + word if space else word))
        return len(self.full.encode(piece, add_special_tokens=False).ids)

    def count(self, pieces) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {"": 0}
        known, one = self.known, self._one
        out = np.empty(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            n = known.get(piece)
            if n is None:
                n = known[piece] = one(piece)
            out[k] = n
        return out

    def lengths(self, pieces: pa.Array, frequent: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Tier 1, then tier 2."""
        at = pc.index_in(pieces, value_set=frequent)
        miss = at.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros(len(pieces), np.int64)
        out[~miss] = sizes[at.drop_null().to_numpy(zero_copy_only=False)]
        if miss.any():
            out[miss] = self.count(strings(pieces.filter(pa.array(miss))))
        return out


def frequent_pieces(df: DataFrame, text: str = "text", size: int = FREQUENT) -> list[str]:
    """The corpus's frequent pre-tokens, at most ``size``, from one pass over all rows."""

    def summed(batches):
        own = HeavyHitters(size)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for lo, hi in slices(texts):
                flat, _ = pre_tokens(texts.slice(lo, hi - lo))
                codes, distinct = coded(flat)
                core, _ = parted(distinct)
                n = np.bincount(codes, minlength=len(distinct))
                often = n > 2  # a count of one or two in 8 MB is below the summary's own error
                own.add(strings(core.filter(pa.array(often))).tolist(), n[often].tolist())
        yield from packed(own)

    def packed(own: HeavyHitters):
        own.shrink()
        yield pa.RecordBatch.from_arrays([pa.array([list(own.counts)], pa.list_(pa.string())), pa.array([list(own.counts.values())], pa.list_(pa.int64()))], ["pieces", "counts"])

    def merged(batches):
        own = HeavyHitters(size)
        for batch in batches:
            for row in batch.to_pylist():
                own.add(row["pieces"], row["counts"])
        yield from packed(own)

    schema = "pieces array<string>, counts array<long>"
    parts = df.select(F.col(text)).mapInArrow(summed, schema)
    n = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) or 1
    # two levels of merging, so that one summary of bounded size is all that comes to the driver
    rows = parts.repartition(n).mapInArrow(merged, schema).repartition(1).mapInArrow(merged, schema).collect()
    return [p for r in rows for p in r["pieces"] if p]


COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "tokens", size: int = FREQUENT) -> DataFrame:
    """``df`` without the text, with a struct column ``out`` of n_bytes and n_tokens."""
    return with_plain_names(df, lambda d, n: _counted(d, tokenizer, n[text], out, size), (text,), (out,))


def _counted(df: DataFrame, tokenizer: str, text: str, out: str, size: int) -> DataFrame:
    common = frequent_pieces(df, text, size)
    lengths = counter(tokenizer).count(common)
    table = df.sparkSession.sparkContext.broadcast((common, lengths))
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(out, COUNTS)])

    def task(batches):
        own = counter(tokenizer)
        frequent, sizes = pa.array(table.value[0], pa.string()), table.value[1]
        for batch in batches:
            texts = texts_of(batch.column(len(rest)))
            n_tokens = []
            for lo, hi in slices(texts):
                flat, offsets = pre_tokens(texts.slice(lo, hi - lo))
                codes, distinct = coded(flat)
                length = np.zeros(len(distinct), np.int64)
                for piece in parted(distinct):
                    piece_codes, piece_distinct = coded(piece)
                    length += own.lengths(piece_distinct, frequent, sizes)[piece_codes]
                n_tokens.append(sums(length[codes], offsets))
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            made = pa.StructArray.from_arrays([n_bytes, pa.array(np.concatenate(n_tokens) if n_tokens else [], pa.int64())], COUNTS.names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], schema.names)

    return df.select(*rest, text).mapInArrow(task, schema)
