"""Scores from models. The published pipelines use downloaded models; here a scorer is any function of texts, and two small ones can be
fitted on the data at hand. They are stand-ins with the same interface, not the same numbers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Log probabilities are whole numbers of this fraction, so that their sums don't depend on their order.
LOG_UNITS = 10**9


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of three code points of a lower-cased text between spaces, as numbers, and how often each occurs."""
    points = np.frombuffer((" " + text.lower().replace("\n", " ") + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:], return_counts=True)


@dataclass
class LanguageModel:
    """Naive Bayes over character trigrams: the language and its probability. logs: languages x (grams and one for all others)."""

    langs: tuple[str, ...] = ()
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs:
            return "", 0.0
        grams, counts = _trigrams(text)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        n = max(1.0, counts.sum() / 50)  # probabilities as if of about fifty trigrams, for they aren't independent
        total = (self.logs[:, at] * counts).sum(1) / n
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.maximum(-700.0, total - total[best])).sum())


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 2000, longest: int = 5000, kinds: int = 3000) -> LanguageModel:
    """Fits on at most `most` rows of at most `longest` characters, chosen by a digest of the text; keeps the `kinds` most frequent trigrams of
    each language, ties in the order of code points."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.length("t").between(20, longest) & F.col("l").isNotNull()).orderBy(F.md5("t"), "l").limit(most).collect()
    counts: dict[str, Counter] = {}
    for r in rows:
        for g, c in zip(*map(np.ndarray.tolist, _trigrams(r.t))):
            counts.setdefault(r.l, Counter())[g] += c
    if not counts:
        return LanguageModel()
    langs = tuple(sorted(counts))
    chosen = {k: sorted(counts[k].items(), key=lambda x: (-x[1], x[0]))[:kinds] for k in langs}
    grams = np.array(sorted({g for c in chosen.values() for g, _ in c}), np.uint64)
    logs = np.empty((len(langs), len(grams) + 1))
    for i, k in enumerate(langs):
        n = sum(counts[k].values())
        logs[i] = math.log(0.5 / n)
        logs[i, np.searchsorted(grams, np.array([g for g, _ in chosen[k]], np.uint64))] = [math.log(v / n) for _, v in chosen[k]]
    return LanguageModel(langs, grams, logs)


@dataclass
class WordModel:
    """An interpolated unigram model over words, with a share for unknown ones.

    hashes (sorted) and logs, in LOG_UNITS, hold the frequent words. Where there are more, tail is a table of all the others, (w, log), which
    is joined. A line end counts as a word of log probability LINE.
    """

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    unknown: int = -6 * LOG_UNITS
    tail: DataFrame | None = field(default=None, compare=False, repr=False)
    LINE = -2 * LOG_UNITS

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log, and whether the model has it."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) for w in words], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.logs[at], self.hashes[at] == h

    def perplexity(self, text: str) -> float:
        """10 to the negative mean log10 probability over words and line ends, to one decimal; 0 for an empty text."""
        if self.tail is not None:
            raise ValueError("the words of this model are also in a table; plans.pipeline.lower joins it")
        n, total, others = self.known_part(text)
        total += self.unknown * sum(others.values())
        return round(10.0 ** (-total / LOG_UNITS / n), 1) if n else 0.0

    def known_part(self, text: str) -> tuple[int, int, Counter]:
        """Words and line ends of a text, the sum over those that are known, in LOG_UNITS, and the other words with their counts."""
        lines, words = len(text.splitlines()), text.lower().split()
        total = self.LINE * lines
        if not words:
            return lines, total, Counter()
        logs, known = self._found(words)
        return len(words) + lines, total + int(logs[known].sum()), Counter(w for w, k in zip(words, known.tolist()) if not k)


def fit_words(docs: DataFrame, text: str = "text", most: int = 500_000) -> WordModel:
    """Counts words over all rows, and all of them make the model: the `most` frequent ones in memory, as 16 bytes each, the others as a table
    to join."""
    words = cut(docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("w")).filter("w != ''").groupBy("w").count())
    total, kinds = words.agg(F.sum("count"), F.count("*")).first()
    total = total or 1
    log = F.round(F.log10(F.col("count") / F.lit(total)) * LOG_UNITS).cast("long")
    tail, first = None, words
    if kinds > most:
        last = words.orderBy(F.desc("count"), "w").select("count", "w").offset(most - 1).limit(1).first()  # the last that memory holds
        above = (F.col("count") > F.lit(last["count"])) | ((F.col("count") == F.lit(last["count"])) & (F.col("w") <= F.lit(last.w)))
        first, tail = words.filter(above), words.filter(~above).select("w", log.alias("log"))
    held = first.select(F.xxhash64("w").alias("h"), log.alias("log")).toArrow()
    hashes, logs = (held.column(c).to_numpy() for c in ("h", "log"))
    order = np.argsort(hashes)
    return WordModel(hashes[order], logs[order], round(math.log10(0.1 / total) * LOG_UNITS), tail)


_LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """What load() gives, called once a worker and kept by a name that the caller gives, so that a model is never pickled."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def score(texts: list[str], name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> np.ndarray:
    """Any scorer of texts; another model needs another name."""
    return np.asarray(loaded(name, load)(texts), float)
