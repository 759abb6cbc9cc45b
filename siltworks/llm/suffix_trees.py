"""Substring deduplication on words by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import BASES, Shape, _arrow, covered, mixed, repeated, texts_of, word_units

WINDOW, GRAM = 50, 25
SHAPE = Shape(WINDOW, GRAM, word_units)


def stored_words(text: bytes, codes: np.ndarray) -> tuple[np.ndarray, int]:
    return codes, 8


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of a group, cut at the width of `suffixes` (one row of words each): the leaves in order, and the depth of the node
    that each leaf shares with the one before it."""
    order = np.lexsort(suffixes.T[::-1])
    at = suffixes[order]
    same = at[1:] == at[:-1]
    depth = np.where(same.all(1), suffixes.shape[1], same.argmin(1))
    return order, np.concatenate([[0], depth])


#: Suffixes of which a subtree is built at once.
GROUP = 20_000


def prefix_groups(flat: np.ndarray, start: np.ndarray, window: int, most: int | None = None) -> Iterator[np.ndarray]:
    """Which suffixes share a prefix, in groups of at most `most`: a prefix with more suffixes is made longer by a word, as often as it takes. A
    group of one is left out, as nothing repeats in it; one that shares the whole window is given as it is, whatever its size."""
    most = most or GROUP
    stack = [(np.arange(len(start)), 0)]
    while stack:
        some, depth = stack.pop()
        if depth >= window:
            yield some
            continue
        # Prefixes begin with two words, which make one number.
        word = flat[start[some] + depth] if depth else mixed(flat[start] + flat[start + 1] * np.uint64(BASES[1]))
        depth += 1 if depth else 2
        order = np.argsort(word, kind="stable")
        some, word = some[order], word[order]
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        sizes = np.diff(np.concatenate([[0], edges, [len(some)]]))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            stack.extend((part, depth) for part in np.split(some, edges) if len(part) > most)
        # Small groups: neighbouring ones are sorted together, as a forest, up to that many suffixes.
        kept = some[np.repeat(sizes > 1, sizes) & ~large]
        ends = np.cumsum(sizes[(sizes > 1) & (sizes <= most)])
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield kept[base : ends[to - 1]]
            at = to


def earlier_windows(rows: list[tuple], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(row, low, high) of every window that also is in a text with a smaller first_id.

    Suffixes of a group share its prefix, or those of a few small groups are sorted at once. A node of depth `window` is a run of leaves; a
    leaf is repeated if its run has a smaller id. Words are compared by hashes of 64 bits, so windows are equal in 3,200.
    """
    words = [np.frombuffer(r[4], np.uint64) for r in rows]
    sizes = np.array([len(w) for w in words])
    counts = np.maximum(sizes - window + 1, 0)
    if not counts.sum():
        return []
    flat = np.concatenate(words)
    row = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[row] + offset
    ids = np.array([r[2] for r in rows], np.int64)[row]
    hit = np.zeros(len(start), bool)
    for part in prefix_groups(flat, start, window):
        order, depth = subtree(flat[start[part][:, None] + np.arange(window)])
        leaf = part[order]
        node = np.flatnonzero(depth < window)
        least = np.minimum.reduceat(ids[leaf], node)
        hit[leaf] |= np.repeat(least, np.diff(np.concatenate([node, [len(leaf)]]))) < ids[leaf]
    lows = np.array([r[3] for r in rows])
    return _runs(row[hit], lows[row[hit]] + offset[hit], window)


def _runs(row: np.ndarray, low: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Windows of a row that follow each other place by place, as one range."""
    if not len(row):
        return []
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (low[1:] != low[:-1] + 1)])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(row)]]) - 1
    return list(zip(row[at].tolist(), low[at].tolist(), (low[last] + window).tolist()))


RESULT = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("nothing_sha256", T.StringType()), T.StructField("first_id", T.LongType())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    A word goes if a window of 50 words that covers it also begins in a document with a smaller id. Of documents with the same text all but
    those with the smallest id lose all words, if there are 50. Null and empty texts have no words. A null id counts as the largest.
    """
    rows, different = texts_of(docs, id_col, text_col)
    ranges = repeated(different, SHAPE, True, stored_words, 8, earlier_windows)
    joined = different.select("key", "text", "first_id", "copies").join(ranges, "key", "left")

    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for b in batches:
            out = []
            for key, text, first_id, spans in zip(*(b.column(c).to_pylist() for c in ("key", "text", "first_id", "ranges"))):
                words = text.encode().split()
                gone = covered(len(words), spans) if spans else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((key, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), empty if len(words) >= WINDOW else "", first_id))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _arrow(RESULT).types)], schema=_arrow(RESULT))

    results = joined.mapInArrow(run, RESULT)
    later = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) != F.col("first_id")) & (F.col("n_words") >= WINDOW)
    out = rows.join(results, "key")
    return out.select("doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("removed")).alias("n_removed"), F.when(later, F.col("nothing_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
