"""Substring deduplication on bytes by external induced suffix sorting."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import Rolling, Shape, _arrow, byte_units, covered, repeated, texts_of

LENGTH, GRAM = 200, 100
SHAPE = Shape(LENGTH, GRAM, byte_units)
#: Bytes of suffixes that a queue holds in memory before it writes them to its file, and the largest alphabet that is sorted by induction.
QUEUE_BYTES, ALPHABET = 64_000_000, 4096
#: Suffixes are told apart by so many names at most, and a name covers two bytes at least, so order is exact over the first LENGTH bytes.
DEEPEST = LENGTH


class Queue:
    """A monotone priority queue of suffixes, popped by first character: one run per character, in order of arrival.

    Suffixes are pushed in the order of the suffixes that follow them, so the order of arrival within a character is the order sought. What
    is over QUEUE_BYTES goes to a file, which is read back run by run; it is in the worker's temporary folder and gone when closed.
    """

    def __init__(self, alphabet: int):
        self.runs: list[list] = [[] for _ in range(alphabet)]
        self.held, self.file = 0, None

    def push(self, first: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        first = first.astype(np.uint16)  # an alphabet of at most ALPHABET, and so a sort by counting
        order = np.argsort(first, kind="stable")
        first, suffixes = first[order], suffixes[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for c, part in zip(first[np.concatenate([[0], cuts])].tolist(), np.split(suffixes, cuts)):
            self.runs[c].append(part)
        self.held += suffixes.nbytes
        if self.held > QUEUE_BYTES:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for run in self.runs:
            for i, part in enumerate(run):
                if isinstance(part, np.ndarray):
                    run[i] = (self.file.seek(0, 2), len(part), part.dtype)
                    self.file.write(part.tobytes())
        self.held = 0

    def pop(self, c: int) -> np.ndarray:
        out = []
        for part in self.runs[c]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(part[1] * part[2].itemsize), part[2])
            else:
                self.held -= part.nbytes
            out.append(part)
        self.runs[c] = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file:
            self.file.close()


def rising(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them. The last character of t is the unique smallest."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    after = differs[np.searchsorted(differs, np.arange(n - 1))]
    return np.concatenate([t[after] < t[after + 1], [True]])


def induced(t: np.ndarray, up: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in order, from the order of the seeds (the leftmost rising suffixes of each rise)."""
    low: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    by_first = np.argsort(t[seeds].astype(np.uint16), kind="stable")
    seeds = seeds[by_first]
    bounds = np.searchsorted(t[seeds], np.arange(alphabet + 1))
    queue = Queue(alphabet)

    def before(s: np.ndarray, rise: bool) -> tuple[np.ndarray, np.ndarray]:
        p = s[s > 0] - 1
        p = p[up[p] == rise]
        return t[p], p

    for c in range(alphabet):  # falling suffixes, smallest first
        wave = queue.pop(c)
        while len(wave):
            low[c].append(wave)
            first, p = before(wave, False)
            queue.push(first[first != c], p[first != c])
            wave = p[first == c]
        queue.push(*before(seeds[bounds[c] : bounds[c + 1]], False))
    queue.close()
    queue = Queue(alphabet)
    queue.push(t[-1:], np.array([len(t) - 1]))
    high: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    for c in range(alphabet - 1, -1, -1):  # rising suffixes, largest first
        wave = queue.pop(c)
        while len(wave):
            high[c].append(wave)
            first, p = before(wave, True)
            queue.push(first[first != c], p[first != c])
            wave = p[first == c]
        for part in reversed(low[c]):
            queue.push(*before(part[::-1], True))
    queue.close()
    return np.concatenate([p for c in range(alphabet) for p in (*low[c], *[h[::-1] for h in reversed(high[c])])])


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence with a large alphabet, by prefix doubling over DEEPEST names."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank << 32 | second
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= min(n, DEEPEST):
            return order


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffixes of t in order. The last character of t is 0 and the only 0.

    Induced sorting: suffixes that start a rise are few. Their order gives that of all others in two passes over a queue. Their own order is
    found by sorting the stretches between them, which takes the same two passes, naming equal stretches alike, and sorting the suffixes of
    the sequence of names: by recursion, or by doubling if there are too many names for runs of useful size.
    """
    up = rising(t)
    starts = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(starts) < 2:
        return induced(t, up, starts, alphabet)
    once = induced(t, up, starts, alphabet)
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    by_stretch = once[is_start[once]]
    end = np.empty(len(t), np.int64)
    end[starts] = np.concatenate([starts[1:] + 1, [len(t)]])
    rolling = Rolling(t.astype(np.uint64) + np.uint64(1))
    stretch = rolling.of(by_stretch, end[by_stretch])
    long = end[by_stretch] - by_stretch
    name = np.empty(len(t), np.int64)
    name[by_stretch] = np.concatenate([[0], np.cumsum((stretch[1:] != stretch[:-1]) | (long[1:] != long[:-1]))])
    names = name[starts]
    kinds = int(names.max()) + 1
    order = np.argsort(names) if kinds == len(names) else suffix_array(names, kinds) if kinds <= ALPHABET else doubled(names)
    return induced(t, up, starts[order], alphabet)


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The length of the common prefix of suffixes a and b of t, eight bytes at a time, up to `most` (a multiple of 8)."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(most + 8, np.uint8)]), 8)).view(np.uint64).ravel()
    out, live = np.full(len(a), most, np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        differ = eight[a + at] ^ eight[b + at]
        lost = differ != 0
        low = differ[lost]
        low &= ~low + np.uint64(1)  # the lowest bit in which they differ
        out[live[lost]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        a, b, live = a[~lost], b[~lost], live[~lost]
    return out


def repeated_windows(rows: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(row, low, high) of every window of `length` bytes that is also at another place of the documents.

    Contexts are joined to one shard, with a separator that is in no text. Suffixes with a whole window before them are neighbours in order
    if they begin with the same window, and then have at least `length` bytes in common. Two contexts of a document can hold the same
    place, so places are compared, not suffixes.
    """
    texts = [np.frombuffer(r[4], np.uint8) for r in rows]
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    flat = np.full(ends[-1], 1, np.int32)
    raw = np.ones(ends[-1], np.uint8)
    row = np.repeat(np.arange(len(rows)), sizes + 1)
    offset = np.arange(ends[-1]) - starts[row]
    is_text = offset < sizes[row]
    raw[is_text] = np.concatenate(texts)
    flat[is_text] = raw[is_text].astype(np.int32) + 2
    order = suffix_array(np.concatenate([flat, [0]]), 258)[1:]
    order = order[offset[order] + length <= sizes[row[order]]]
    if len(order) < 2:
        return []
    shared = common_prefix(raw, order[:-1], order[1:], length)
    group = np.flatnonzero(np.concatenate([[True], shared < length]))
    number = {k: i for i, k in enumerate(dict.fromkeys(r[1] for r in rows))}
    text = np.array([number[r[1]] for r in rows], np.int64)[row[order]]
    place = text << 40 | (np.array([r[3] for r in rows], np.int64)[row[order]] + offset[order])
    several = np.minimum.reduceat(place, group) != np.maximum.reduceat(place, group)
    hit = np.zeros(len(flat), bool)
    hit[order] = np.repeat(several, np.diff(np.concatenate([group, [len(order)]])))
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    lows = np.array([r[3] for r in rows])
    return [(int(row[at[a]]), int(lows[row[at[a]]] + offset[at[a]]), int(lows[row[at[b]]] + offset[at[b]] + length)) for a, b in zip(first, last)]


def stored_bytes(text: bytes, codes: np.ndarray) -> tuple[np.ndarray, int]:
    return np.frombuffer(text, np.uint8), 1


RESULT = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay.

    A byte of the UTF-8 text goes if a string of 200 bytes that covers it begins at any other place of any document. Rows with the same
    text are other places of each other, so all of them lose every byte, if there are 200. Null counts as empty.
    """
    rows, different = texts_of(docs, id_col, text_col)
    ranges = repeated(different, SHAPE, False, stored_bytes, 1, repeated_windows)
    joined = different.select("key", "text", "first_id", "copies").join(ranges, "key", "left")

    def run(batches):
        for b in batches:
            out = []
            for key, text, copies, spans in zip(*(b.column(c).to_pylist() for c in ("key", "text", "copies", "ranges"))):
                raw = text.encode()
                if copies > 1 and len(raw) >= LENGTH:
                    spans = [{"low": 0, "high": len(raw)}]
                if not spans:
                    out.append((key, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = covered(len(raw), spans)
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((key, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _arrow(RESULT).types)], schema=_arrow(RESULT))

    return rows.join(joined.mapInArrow(run, RESULT), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
