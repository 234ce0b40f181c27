"""Encoding with a tokenizers file, word by word with a bounded worker cache.

The tokenizer is the library's own. It is asked once for each distinct word
that a worker meets; texts are put together from the answers. That is exact for
a tokenizer which drops white space and never merges across it: every piece
between white space is encoded by itself anyway. ``WordEncoder`` checks that its
file is of this kind.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .arrowtext import coded, slices, strings, sums, words_of

#: Distinct words that one worker keeps; beyond, the cache starts afresh. Bounds its memory at about 100 MB.
CACHE_WORDS = 600_000
#: Marks that are split off after a letter or digit, where the tokenizer splits, too; none of them is in a special token.
MARKS = ".,;:!?#*$%&"
#: Words of Latin-1 letters and marks: composed, and lowered letter by letter.
LATIN = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff{MARKS}]+$"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would cost memory only
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... for each (start, count), one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class WordEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if not (steps[0].get("behavior") == "Removed" and steps[0].get("invert")) or spec["model"].get("type") != "BPE":
            raise ValueError("word by word encoding needs a BPE file whose pre-tokenizer drops white space")
        self.full = Tokenizer.from_file(path)
        #: Byte-level spelling: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        self.spelling = {b: b if b in plain else next(others) for b in range(256)}
        self.model = self.full.model
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def _append(self, words: list[str], answers: list[list[int]]) -> None:
        first = len(self.known)
        counts = np.fromiter(map(len, answers), np.int64, len(answers))
        flat = np.fromiter(chain.from_iterable(answers), np.uint32, int(counts.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) > len(self.counts):
            self.starts, self.counts = np.concatenate([self.starts, self.starts]), np.concatenate([self.counts, self.counts])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : first + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[first : first + len(words)] = counts
        self.used += len(flat)
        self.known.update(zip(words, range(first, first + len(words))))

    def _word(self, word: str) -> list[int] | None:
        """Ids of a word of letters, by the BPE model alone; None if normalising or splitting could matter."""
        if not word.isalpha() or not unicodedata.is_normalized("NFC", word):
            return None
        lower = word.lower()
        if len(lower) != len(word) or "\u03a3" in word:  # the library lowers character by character
            return None
        return [t.id for t in self.model.tokenize(lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.spelling))]

    def _learn(self, words: list[str]) -> None:
        gc.disable()  # hundreds of thousands of small lists, none in a cycle
        try:
            kind = pa.array(words, pa.string())
            plain, latin = (pc.match_substring_regex(kind, f"^[a-z{more}]+$").to_pylist() for more in ("", "\u00df-\u00f6\u00f8-\u00ff"))
            tokenize, spelling = self.model.tokenize, self.spelling
            # lower-case Latin-1 letters are composed and stay as they are: the model alone says all
            spelt = [w if p else w.encode().decode("latin-1").translate(spelling) if q else None for w, p, q in zip(words, plain, latin)]
            answers = [self._word(w) if x is None else [t.id for t in tokenize(x)] for w, x in zip(words, spelt)]
        finally:
            gc.enable()
        rest = [k for k, ids in enumerate(answers) if ids is None]
        for k, e in zip(rest, self.full.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            answers[k] = e.ids
        self._append(words, answers)

    def _entries(self, keys: pa.Array) -> np.ndarray:
        """Cache entries of distinct strings, encoding those that are new."""
        words = strings(keys)
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = found < 0
        if new.any():
            self._learn(words[new].tolist())
            found[new] = np.fromiter(map(self.known.__getitem__, words[new]), np.int64, int(new.sum()))
        return found

    def _pieces(self, distinct: pa.Array) -> np.ndarray:
        """For each distinct word the cache entries of its core and of the marks after it."""
        if len(self.known) > CACHE_WORDS:
            self.reset()
        # ASCII and Latin-1 words are lowered here already, and marks after a letter or digit split off: fewer distinct keys
        plain = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<")))
        lowered = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        others = pc.invert(plain)
        rest = distinct.filter(others)
        lowered = pc.replace_with_mask(lowered, others, pc.if_else(pc.match_substring_regex(rest, LATIN), pc.utf8_lower(rest), rest))
        core = pc.ascii_rtrim(lowered, characters=MARKS)
        split = pc.match_substring_regex(core, "[\\pL\\pN]$")  # I with a dot above is the one letter whose lower case ends in a mark
        core = pc.if_else(pc.and_(split, pc.invert(pc.ends_with(core, "\u0130"))), core, lowered)
        entries = []
        for piece in (core, self._tails(lowered, core)):
            piece_codes, piece_distinct = coded(piece)
            entries.append(self._entries(piece_distinct)[piece_codes])
        return np.stack(entries, 1)

    def counted(self, codes: np.ndarray, distinct: pa.Array, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text, given as its words."""
        if not len(codes):
            return np.zeros(len(offsets) - 1, np.int64)
        entries = self._pieces(distinct)  # may replace self.counts
        return sums(self.counts[entries].sum(1)[codes], offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of all texts and each text's range in them."""
        flat, offsets = words_of(texts)
        codes, distinct = coded(flat)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        entries = self._pieces(distinct)
        counts, starts = self.counts[entries].astype(np.int64), self.starts[entries]
        word_ids = self.ids[ragged(starts.ravel(), counts.ravel())]
        per_word = counts.sum(1)
        word_starts = np.cumsum(per_word) - per_word
        n = per_word[codes]
        ids = word_ids[ragged(word_starts[codes], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[offsets]

    @staticmethod
    def _tails(lowered: pa.Array, core: pa.Array) -> pa.Array:
        """What follows the core of each word: a run of MARKS or nothing."""
        n = pc.binary_length(lowered).to_numpy(zero_copy_only=False) - pc.binary_length(core).to_numpy(zero_copy_only=False)
        out = np.full(len(n), "", object)
        at = np.flatnonzero(n)
        if len(at):
            words = strings(lowered.take(pa.array(at)))
            out[at] = [w[-k:] for w, k in zip(words, n[at])]
        return pa.array(out, pa.string())


def encoded_slices(path: str, texts: pa.Array, limit: int = 8 << 20):
    """(lo, hi, flat ids, ranges) for row ranges of about ``limit`` bytes."""
    own = encoder(path)
    for lo, hi in slices(texts, limit):
        yield lo, hi, *own.encode(texts.slice(lo, hi - lo))
