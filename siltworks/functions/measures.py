"""Text mappers and statistics as functions of one document, for pipelines that run in one pass over Arrow batches.

A document keeps what several statistics read: its code points, the class of each, its lines and its words. Each function computes the same
as the Column expression of its name in text.py; tests hold them against each other.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

from . import fixed

#: Bits of the class of a code point. Classes are looked up once and kept in a table of a worker.
LETTER, ALNUM, SPECIAL, UNKNOWN = 1, 2, 4, 128
_TABLE = np.full(0x110000, UNKNOWN, np.uint8)
_SPECIALS = "".join(sorted(fixed.special_characters()))
_BAD = fixed.special_characters()


def _classes(points: np.ndarray) -> np.ndarray:
    out = _TABLE[points]
    if (out == UNKNOWN).any():
        for p in np.unique(points[out == UNKNOWN]).tolist():
            c = chr(p)
            major = unicodedata.category(c)[0]
            _TABLE[p] = LETTER * (major == "L") | ALNUM * (major in "LN") | SPECIAL * (c in _BAD)
        out = _TABLE[points]
    return out


class Doc:
    """A text and what is known of it."""

    __slots__ = ("text", "_points", "_classes", "_lines", "_words")

    def __init__(self, text: str):
        self.text = text
        self._points = self._classes = self._lines = self._words = None

    @property
    def points(self) -> np.ndarray:
        if self._points is None:
            self._points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._points

    @property
    def classes(self) -> np.ndarray:
        if self._classes is None:
            self._classes = _classes(self.points)
        return self._classes

    @property
    def lines(self) -> list[str]:
        if self._lines is None:
            self._lines = self.text.splitlines()
        return self._lines

    @property
    def words(self) -> list[str]:
        """Lower-cased words between spaces, line feeds and tabs, without special characters at their ends; empty ones go."""
        if self._words is None:
            found = self.text.lower().replace("\n", " ").replace("\t", " ").split(" ")
            self._words = [w for w in [w.strip(_SPECIALS) for w in found if w] if w]
        return self._words


# Mappers


_EMAIL = re.compile(fixed.EMAIL)
_BLOCK = re.compile(fixed.BLOCK_COMMENT)
_HEAD = re.compile(r"^(?:(?://|#|--)[^\n]*(?:\n|\Z)|\n)+")
_SPACES = str.maketrans({c: " " for c in fixed.SPACES})
_PUNCTUATION = str.maketrans(fixed.PUNCTUATION)


def clean_email(text: str) -> str:
    return _EMAIL.sub("", text) if "@" in text else text


def normalize_punctuation(text: str) -> str:
    return text if text.isascii() else text.translate(_PUNCTUATION)


def normalize_whitespace(text: str) -> str:
    return text.strip().translate(_SPACES)


def clean_copyright(text: str) -> str:
    block = _BLOCK.search(text)
    if not block:
        return _HEAD.sub("", text, count=1)
    return text[: block.start()] + text[block.end() :] if "copyright" in block[0].lower() else text


def _kept_words(text: str, keep) -> str:
    lines = ("\t".join(c for c in (" ".join(w for w in cell.split(" ") if w and keep(w)) for cell in line.split("\t")) if c) for line in text.split("\n"))
    return "\n".join(x for x in lines if x)


def remove_words_with(text: str, substrings: Sequence[str] = fixed.BAD_SUBSTRINGS) -> str:
    def found(w: str) -> bool:
        return any(s in w for s in substrings)

    return _kept_words(text, lambda w: not (found(w) and found(w.strip(_SPECIALS))))


def remove_long_words(text: str, min_len: int = 1, max_len: int = (1 << 31) - 1) -> str:
    return _kept_words(text, lambda w: min_len <= len(w) <= max_len or min_len <= len(w.strip(_SPECIALS)) <= max_len)


# Statistics


def text_length(d: Doc) -> float:
    return len(d.text)


def average_line_length(d: Doc) -> float:
    return len(d.text) / len(d.lines) if d.text else 0.0


def maximum_line_length(d: Doc) -> float:
    return max(map(len, d.lines)) if d.text else 0.0


def _share(d: Doc, bit: int) -> float:
    return float(np.count_nonzero(d.classes & bit)) / len(d.text) if d.text else 0.0


def alnum_ratio(d: Doc) -> float:
    return _share(d, ALNUM)


def special_ratio(d: Doc) -> float:
    return _share(d, SPECIAL)


def words_num(d: Doc) -> float:
    return len(d.words)


@cache
def _listed(listed: tuple[str, ...]) -> frozenset[str]:
    return frozenset(listed)


def listed_ratio(d: Doc, listed: Sequence[str]) -> float:
    known = _listed(tuple(listed))
    return min(1.0, sum(w in known for w in d.words) / len(d.words)) if d.words else 0.0


_CHAR_WEIGHTS = {n: np.uint64(0x9E3779B97F4A7C15) ** np.arange(n, dtype=np.uint64) for n in range(1, 65)}


def _gram_counts(codes: np.ndarray, n: int) -> np.ndarray:
    """How often each different run of n codes occurs, by a 64-bit hash of it."""
    grams = np.zeros(len(codes) - n + 1, np.uint64)
    codes = codes ^ (codes >> np.uint64(29))
    for k, w in enumerate(_CHAR_WEIGHTS[n]):
        grams += codes[k : k + len(grams)] * w
    grams.sort()
    edges = np.flatnonzero(grams[1:] != grams[:-1])
    return np.diff(np.concatenate([[-1], edges, [len(grams) - 1]]))


def char_repetition(d: Doc, n: int = 10) -> float:
    """The share of the most frequent character n-grams: as many kinds as the root of their number, but none that occurs once."""
    if len(d.text) < n:
        return 0.0
    counts = _gram_counts(d.points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), n)
    top = min(math.isqrt(len(counts)), int(np.count_nonzero(counts > 1)))
    if not top:
        return 0.0
    return float(np.partition(counts, len(counts) - top)[len(counts) - top :].sum()) / float(counts.sum())


def word_repetition(d: Doc, n: int = 10, model: str | None = None) -> float:
    """The share of word n-grams that occur more than once."""
    words = d.words if model is None else _tokens(d.text, model, True)
    if len(words) < n:
        return 0.0
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.uint64) + np.uint64(1)
    counts = _gram_counts(codes * np.uint64(0xD6E8FEB86659FD93), n)
    return float(counts[counts > 1].sum()) / float(counts.sum())


def _tokens(text: str, model: str, lower: bool) -> list[str]:
    from .kernels import tokens

    return tokens(text, model, lower)


def token_count(d: Doc, model: str | None = None) -> float:
    return len(d.words if model is None else _tokens(d.text, model, False))


def alpha_per_token(d: Doc, tokenize=str.split) -> float:
    """Letters per token; above 1 for most texts."""
    n = len(tokenize(d.text))
    return float(np.count_nonzero(d.classes & LETTER)) / n if n else 0.0


def language_score(d: Doc, model, lang: str | None = None) -> float:
    """The probability of the best language; 0 if another than `lang` is best."""
    best, score = model.predict(d.text)
    return score if lang is None or best == lang else 0.0


def perplexity(d: Doc, model) -> float:
    return model.perplexity(d.text)
