"""Where long repeats can be: content-chosen anchors, and the few contexts around them that need a suffix structure.

A text is a sequence of units (bytes or words). Winnowing chooses, among any REACH = length - gram + 1 consecutive grams, the one with the
smallest hash, so every window of `length` units chooses an anchor, and equal windows choose the same one. The windows that choose an anchor
follow each other; its context is what they cover, and no window is in two contexts. Anchors whose gram occurs once are done with. Equal contexts, by two hashes of 64 bits, are known to repeat without looking
at their text.
Only an anchor whose gram has several different contexts is `open`: some windows around it may repeat and others not. The texts of these
contexts, and no others, go to the suffix structure of the operator.

One row stands for all copies of a text, so groups of copies of any size are one row here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import whole

#: Of the two hashes: one orders and tells grams apart, the other contexts, so that equal contexts are equal in 128 bits.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Units that are hashed at once, and after about how many a task combines its anchors.
CHUNK, COMBINED = 400_000, 4_000_000
#: Occurrences of a gram beyond which its contexts are cut into pieces, windows to a piece, and occurrences beyond which a piece is one window.
HOT, BLOCK, BURNING = 2_000, 16, 20_000
#: A gram is frequent if it is so often among a task's COMBINED units; so many of the most frequent ones are dealt into so many lanes.
OFTEN, MOST, LANES = 8, 1_000, 1_009
#: Bits of the part of a context that follows the place, in the number that holds both parts.
AFTER = 16
BYTE_CODES = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, kept in the worker up to the longest sequence."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK) - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return _POWERS[base]


class Rolling:
    """Hashes of all stretches of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        power, self.inverse = powers(base, len(codes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[: len(codes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        """of() every stretch of a length."""
        x = self.sums[length:] - self.sums[:-length]
        x *= self.inverse[: len(x)]
        return mixed(x)


def byte_units(text: bytes) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text, np.uint8)]


def word_units(text: bytes) -> np.ndarray:
    """A hash of each word; words lie between white space bytes."""
    raw = np.frombuffer(text, np.uint8)
    blank = BLANK[raw]
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return Rolling(BYTE_CODES[raw]).of(start, end) if len(start) else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Shape:
    """Windows of `length` units, anchors of `gram` units; `units` turns UTF-8 text into codes."""

    length: int
    gram: int
    units: Callable[[bytes], np.ndarray]

    @property
    def reach(self) -> int:
        return self.length - self.gram + 1


def chunks(texts: list[bytes], units: Callable[[bytes], np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Whole texts' codes, joined up to about CHUNK units: which texts, their codes, and where each begins and the last ends."""
    which, parts, size = [], [], 0
    for i, t in enumerate(texts):
        u = units(t)
        if which and size + len(u) > CHUNK:
            yield which, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            which, parts, size = [], [], 0
        which.append(i)
        parts.append(u)
        size += len(u)
    if which:
        yield which, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def anchored(codes: np.ndarray, bounds: np.ndarray, shape: Shape, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(text index, place, extent of context, gram hash, context hash) of every anchor in joined codes; places are within the text. An extent
    is the number of units before the place, shifted by AFTER bits, and that from the place on. Without contexts, their hashes are 0."""
    k, w, n = shape.gram, shape.reach, len(codes)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < shape.length:
        return none
    rolling = Rolling(codes)
    gram = rolling.all_of(k)
    sizes = np.diff(bounds)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    # The upper bits order grams, the place within the text breaks ties to the left.
    key = gram & ~np.uint64(0xFFFFFF)
    key |= (np.arange(len(gram)) - begin[: len(gram)]).astype(np.uint64) & np.uint64(0xFFFFFF)
    m = -(-len(key) // w) * w
    grid = np.concatenate([key, np.full(m - len(key), ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    many = n - shape.length + 1  # windows
    least = np.minimum(behind[:many], ahead[w - 1 : w - 1 + many])
    first = np.flatnonzero(np.arange(shape.length, n + 1) <= end[:many])
    least, place = least[first], first - begin[first]
    place += ((least & np.uint64(0xFFFFFF)).astype(np.int64) - place) & 0xFFFFFF
    absolute = place + begin[first]
    if not len(absolute):
        return none
    # A window that begins later never chooses an earlier anchor.
    new = np.flatnonzero(np.concatenate([[True], absolute[1:] != absolute[:-1]]))
    low, high = first[new], first[np.append(new[1:], len(first)) - 1] + shape.length
    absolute, place = absolute[new], place[new]
    t = np.searchsorted(bounds, absolute, side="right") - 1
    extent = (absolute - low) << AFTER | (high - absolute)
    if not contexts:
        return t, place, extent, gram[absolute], np.zeros(len(t), np.uint64)
    context = mixed(Rolling(codes, BASES[1]).of(low, high) ^ extent.astype(np.uint64))
    return t, place, extent, gram[absolute], context


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, text, first_id, copies) of every different text; copies are combined before they move."""
    # A key that can't be null gives all uses of the texts the same plan, and so one shuffle.
    key = F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).select("doc_id", key.alias("key"), "text")
    # A null id is larger than any other.
    different = rows.groupBy("key").agg(F.first("text").alias("text"), F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).alias("first_id"), F.count("*").alias("copies"))
    return rows.select("doc_id", "key"), different


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.ArrayType: pa.list_(pa.int32())}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema])


def _rows(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _arrow(schema).types)], schema=_arrow(schema))


def stretches(b: pa.RecordBatch, shape: Shape, contexts: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the batch, place, extent, gram, context) of its anchors, in arrays for about COMBINED units each."""
    held, size = [], 0
    for which, codes, bounds in chunks(b.column("text").cast(pa.binary()).to_pylist(), shape.units):
        t, *rest = anchored(codes, bounds, shape, contexts)
        held.append((np.array(which)[t], *rest))
        size += len(codes)
        if size > COMBINED:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def combined(gram: np.ndarray, context: np.ndarray, first: np.ndarray, row: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray]:
    """For anchors of one task: how many with its context each stands for, and 0 if it is known to repeat by another one that stays; and the
    anchor of the same text with the same context that stands for it too (its own number if none does)."""
    n = np.arange(len(gram))
    order = np.argsort(gram ^ (context << np.uint64(1)), kind="stable")
    g, c = gram[order], context[order]
    start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
    size = np.diff(np.append(start, len(order)))
    same, by = np.zeros(len(order), np.int32), n.copy()
    if not earlier:
        same[order[start]] = size
        return same, by
    least = first[order] == np.repeat(np.minimum.reduceat(first[order], start), size)
    head = np.repeat(np.minimum.reduceat(np.where(least, n, len(n)), start), size)
    folded = least & (n != head) & (row[order] == row[order][head])
    same[order] = least
    by[order[folded]] = order[head[folded]]
    return same, by


ANCHOR = T.StructType([T.StructField("key", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("first_id", "gram", "context")], *[T.StructField(n, T.IntegerType()) for n in ("place", "extent", "same")], T.StructField("also", T.ArrayType(T.IntegerType()))])
FREQUENT = T.StructType([T.StructField("gram", T.LongType()), T.StructField("often", T.LongType())])


def anchors(different: DataFrame, shape: Shape, earlier: bool) -> DataFrame:
    """Every anchor. Of those with one context in a task, one moves on for all (earlier: of the smallest id, with the other places of its text in
    `also`). The others are known to repeat; they have a 0 as `same`, and no gram, but a number by which they are spread. first_id is 0 where only places count."""

    def run(batches):
        for b in batches:
            ids = b.column("first_id").to_numpy()
            for row, place, extent, gram, context in stretches(b, shape, True):
                if not len(row):
                    continue
                first = ids[row] if earlier else np.zeros(len(row), np.int64)
                same, by = combined(gram, context, first, row, earlier)
                gram = np.where(same == 0, mixed(context + place.astype(np.uint64) * np.uint64(BASES[1]) + row.astype(np.uint64)), gram)
                stays = by == np.arange(len(by))
                folded = np.flatnonzero(~stays)
                folded = folded[np.argsort(by[folded], kind="stable")]
                ends = np.cumsum(np.bincount(by[folded], minlength=len(by))[stays])
                also = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(place[folded].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row[stays])), pa.array(first[stays]), *[pa.array(x[stays].view(np.int64)) for x in (gram, context)], *[pa.array(x[stays].astype(np.int32)) for x in (place, extent, same)], also], schema=_arrow(ANCHOR))

    return different.select("key", "text", "first_id", "copies").mapInArrow(run, ANCHOR)


def frequent(different: DataFrame, shape: Shape) -> DataFrame:
    """(gram, often): at most MOST of the most frequent grams. They only decide how rows are dealt, and no result depends on which they are."""

    def run(batches):
        for b in batches:
            for _, _, _, gram, _ in stretches(b, shape, False):
                kinds, often = np.unique(gram, return_counts=True)
                if (often >= OFTEN).any():
                    yield pa.RecordBatch.from_arrays([pa.array(kinds[often >= OFTEN].view(np.int64)), pa.array(often[often >= OFTEN].astype(np.int64))], schema=_arrow(FREQUENT))

    found = different.select("key", "text", "first_id", "copies").mapInArrow(run, FREQUENT)
    return found.groupBy("gram").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "gram").limit(MOST)


def judged(found: DataFrame, hot: DataFrame, earlier: bool) -> DataFrame:
    """Anchors whose gram occurs more than once, with `sure` (the whole context repeats) and `open` (its windows must be looked at).

    earlier: a window only counts as repeated if it also is in a text with a smaller first_id; else any other place counts. An open anchor
    stands for all with its context. Rows of a gram meet in one task; those of a frequent one are dealt by their context into lanes, and of a
    frequent context there is one row for each task that has it.
    """
    lane = F.when(F.col("often").isNotNull() & (F.col("same") > 0), F.pmod("context", F.lit(LANES)).cast("int") + 1).otherwise(0)
    rows = found.join(F.broadcast(hot), "gram", "left").withColumn("lane", lane)
    by_gram, by_context = W.partitionBy("gram", "lane"), W.partitionBy("gram", "lane", "context")
    rows = rows.withColumns({"n": F.when(F.col("lane") > 0, F.col("often")).otherwise(F.sum("same").over(by_gram)), "several": (F.col("lane") > 0) | (F.min("context").over(by_gram) != F.max("context").over(by_gram))})
    rows = rows.filter("n > 1 or same = 0")
    rows = rows.withColumns({"all": F.sum("same").over(by_context), "least": F.min("first_id").over(by_context), "turn": F.row_number().over(by_context.orderBy("first_id", "key", "place"))})
    # Both uses of these rows name the same columns, and so have one shuffle.
    if earlier:
        sure, open_ = F.col("least") < F.col("first_id"), (F.col("least") == F.col("first_id")) & (F.col("turn") > 0) & (F.col("all") > 0)
    else:
        sure, open_ = (F.col("all") > 1) & (F.col("turn") > 0), (F.col("turn") == 1) & (F.col("least") <= F.col("first_id")) & (F.col("all") > 0)
    return rows.select("key", "first_id", "gram", "place", "extent", "also", "n", ((F.col("same") == 0) | sure).alias("sure"), ((F.col("same") > 0) & F.col("several") & open_).alias("open")).filter("sure or open")


CONTEXT = T.StructType([T.StructField("gram", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("first_id", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("units", T.BinaryType()), T.StructField("kind", T.IntegerType()), T.StructField("also", T.ArrayType(T.IntegerType()))])
#: Kinds of rows: to be looked at; the same, and known to repeat; one window, of which units is a digest; the same, and known to repeat; a range that is known to repeat.
LOOK, LOOK_MANY, ONE, ONE_MANY, RANGE_KNOWN = range(5)


def contexts(different: DataFrame, open_: DataFrame, shape: Shape, earlier: bool, stored: Callable[[bytes, np.ndarray], tuple[np.ndarray, int]]) -> DataFrame:
    """The units of every open context: gram, key, first_id, low and high (where it begins and ends), units, kind, and also: where else the same
    units begin in the same text.

    The context of a gram with more than HOT occurrences is cut into pieces: windows that begin within a block of BLOCK places share all but
    the block, and that longer stretch is what the piece groups by. So what differs around a frequent passage falls apart into small groups.
    Beyond BURNING occurrences a piece is one window, and a group holds equal windows only. Of equal pieces in a task one moves on for all.
    """
    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("gram", "place", "extent", "also", "n")).alias("open"))
    joined = different.select("key", "text", "first_id", "copies").join(wanted, "key")

    def run(batches):
        for b in batches:
            out: list[list] = []
            held: dict[tuple, int] = {}
            size = 0

            def piece(group: int, key: bytes, first_id: int, low: int, high: int, units: bytes, kind: int) -> None:
                row = [group, key, first_id, low, high, units, kind, []]
                at = held.setdefault((group, units), len(out))
                if at == len(out):
                    out.append(row)
                    return
                other = out[at]
                if (key, low) == (other[1], other[3]):
                    return  # two contexts of a text hold the same place
                if earlier and key == other[1]:
                    other[7].append(low)
                    return
                if earlier and first_id == other[2]:
                    out.append(row)
                    return
                if earlier and first_id < other[2]:
                    out[at], row = row, other
                elif not earlier:
                    other[6] = LOOK_MANY if kind == LOOK else ONE_MANY
                for at in (row[3], *row[7]):
                    out.append([hash((row[1], at)), row[1], row[2], at, at + row[4] - row[3], None, RANGE_KNOWN, []])

            for key, text, first_id, spots in zip(*(b.column(c).to_pylist() for c in ("key", "text", "first_id", "open"))):
                text = text.encode()
                codes = shape.units(text)
                kept, width = stored(text, codes)
                raw, rolling = kept.tobytes(), None
                for s, place in ((s, p) for s in spots for p in (s["place"], *s["also"])):
                    # Equal contexts are as long on both sides.
                    low, high = place - (s["extent"] >> AFTER), place + (s["extent"] & (1 << AFTER) - 1)
                    if s["n"] <= HOT:
                        out.append([s["gram"], key, first_id, low, high, raw[low * width : high * width], LOOK, []])
                        size += (high - low) * width
                        continue
                    if s["n"] > BURNING:
                        for begin in range(low, high - shape.length + 1):
                            digest = hashlib.blake2b(raw[begin * width : (begin + shape.length) * width], digest_size=16).digest()
                            piece(int.from_bytes(digest[:8], "little", signed=True), key, first_id, begin, begin + shape.length, digest, ONE)
                        size += 2000
                        continue
                    rolling = rolling or Rolling(codes)
                    for a in range(0, shape.reach, BLOCK):
                        b_ = min(a + BLOCK, shape.reach)
                        begin, end = max(low, place - b_ + 1), min(high, place - a + shape.length)
                        if end - begin >= shape.length:  # then what all windows of the block share is within the text, too
                            core = rolling.of(np.array([place - a]), np.array([place - b_ + 1 + shape.length]))
                            piece(int(core.view(np.int64)[0]), key, first_id, begin, end, raw[begin * width : end * width], LOOK)
                            size += (end - begin) * width
                if size > HELD_BYTES:
                    yield _rows(CONTEXT, out)
                    out, size = [], 0
                    held.clear()
            if out:
                yield _rows(CONTEXT, out)

    return joined.mapInArrow(run, CONTEXT)


RANGE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
#: Bytes of contexts that a suffix structure is built over at once, and more only for one group, of at most BURNING pieces; bytes of contexts
#: that a task holds before it sends them.
ENGINE_BYTES, HELD_BYTES = 1_000_000, 8_000_000


def repeated(different: DataFrame, shape: Shape, earlier: bool, stored, width: int, engine: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """(key, ranges): for each text with any, the ranges (low, high) of its units that repeated windows cover.

    width is the number of bytes of a stored unit. engine gets whole groups of contexts (gram, key, first_id, low, units) and returns
    (index, low, high) of the covered ranges.
    """
    rows = judged(anchors(different, shape, earlier), frequent(different, shape), earlier)
    each = rows.filter("sure").select("key", "extent", F.explode(F.concat(F.array("place"), "also")).alias("at"))
    sure = each.select("key", (F.col("at") - F.shiftright("extent", AFTER)).alias("low"), (F.col("at") + F.col("extent").bitwiseAND((1 << AFTER) - 1)).alias("high"))
    some = contexts(different, rows.filter("open").select("key", "gram", "place", "extent", "also", "n"), shape, earlier, stored)

    def run(batches):
        held: list[tuple] = []
        more: list[list[int]] = []
        twice: list[tuple] = []
        size, last = 0, None

        def done():
            ranges = twice + [(held[i][1], a + d, b + d) for i, a, b in (engine(held) if held else ()) for d in (0, *(at - held[i][3] for at in more[i]))]
            for at in range(0, len(ranges), 200_000):
                yield _rows(RANGE, ranges[at : at + 200_000])
            held.clear()
            more.clear()
            twice.clear()

        for b in batches:
            for gram, key, first_id, low, high, units, kind, also in zip(*(c.to_pylist() for c in b.columns)):
                if kind in (LOOK_MANY, ONE_MANY, RANGE_KNOWN):
                    twice.append((key, low, high))
                if kind == RANGE_KNOWN:
                    continue
                if last and gram == last[0] and units == last[5] and (first_id > last[2] if earlier else (key, low) != (last[1], last[3])):
                    # Equal contexts are neighbours: all their windows repeat, and one stands for them.
                    twice += [(key, at, at + high - low) for at in (low, *also)]
                    if not earlier:
                        twice.append((last[1], last[3], last[4]))
                elif kind in (ONE, ONE_MANY):
                    if not last or gram != last[0] or units != last[5]:
                        last = (gram, key, first_id, low, high, units)
                else:
                    if size > ENGINE_BYTES and gram != held[-1][0]:
                        yield from done()
                        size = 0
                    held.append((gram, key, first_id, low, units))
                    more.append(also)
                    size += len(units)
                    last = (gram, key, first_id, low, high, units)
                if len(twice) > 100_000:
                    yield _rows(RANGE, twice)
                    twice.clear()
        yield from done()

    looked = some.repartition("gram").sortWithinPartitions("gram", "units", "first_id").mapInArrow(run, RANGE)
    return sure.unionByName(looked).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def covered(n: int, ranges: list[dict] | None) -> np.ndarray:
    """Which of n units the ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    for r in ranges or ():
        edge[r["low"]] += 1
        edge[r["high"]] -= 1
    return np.cumsum(edge[:n]) > 0
