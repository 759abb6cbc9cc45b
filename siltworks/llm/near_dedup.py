"""N-gram Jaccard join with Bayesian candidate pruning, and the groups of near copies that follow from it.

Texts are sets of five-word shingles; two are linked if their Jaccard similarity is 0.8 or more. Equal texts are one class from the start.
Classes with an equal band of MinHash values are candidates. Their MinHash values are compared a few at a time, and a pair is dropped once
the posterior probability of reaching the threshold, given the agreements so far and a uniform prior, is below TOLERANCE. The others are
verified on their shingle sets.

Pairs never are rows. A band's bucket is dealt into tiles of TILE classes; a pair of tiles is compared in one piece of work, which handles
a pair only in the first band that it shares. It hands on classes with their partners as numbers within the tile, and verification hands on,
for each class, its number of links and one edge of a spanning forest. So work is spread and rows are linear, whatever a bucket's size.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .anchors import Rolling, _arrow, word_units
from .common import BROADCAST_ROWS, cut, fresh, slices, small, whole

WORDS, THRESHOLD = 5, 0.8
BANDS, IN_BAND = 24, 3  # a linked pair shares no band with probability 3e-8 at the threshold, and less above
HASHES, STEP, TOLERANCE = BANDS * IN_BAND, 12, 1e-6
#: Classes and shingles of a tile (one class may have more); tiles from which on a bucket is numbered in slices.
TILE, TILE_SHINGLES, SLICE = 256, 1_000_000, 32
MULTIPLY = np.random.default_rng(9).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
ADD = np.random.default_rng(10).integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of `words` words, sorted."""
    units = word_units(text)
    at = np.arange(len(units) - words + 1) if len(units) >= words else np.zeros(0, np.int64)
    return np.unique(Rolling(units).of(at, at + words)) if len(at) else np.zeros(0, np.uint64)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of 16 bits for each set; sets aren't empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * MULTIPLY[k] + ADD[k]) >> np.uint64(32), at) & np.uint64(0xFFFF)
    return out


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values: the fewest agreements with which the posterior probability of the threshold is at least the tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            density = np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid))
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return out


SKETCH = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("signature", T.BinaryType())])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, first_id, copies, size, signature) of every different text; size is the number of shingles, and the signature is null for texts of
    fewer than WORDS words. Every row's text is sketched where it is, so that sketches move and not texts."""
    text = whole(text_col)
    rows = docs.select(F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), text.alias("text"))

    def run(batches):
        for b in slices(batches):
            out: list[bytes | None] = []
            sizes: list[int] = []
            held: list[np.ndarray] = []
            where: list[int] = []

            def flush():
                for i, s in zip(where, signature(held) if held else ()):
                    out[i] = s.tobytes()
                held.clear()
                where.clear()

            size = 0
            for text in b.column("text").cast(pa.binary()).to_pylist():
                got = shingles(text)
                out.append(None)
                sizes.append(len(got))
                if len(got):
                    held.append(got)
                    where.append(len(out) - 1)
                    size += len(got)
                if size > 500_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], schema=_arrow(SKETCH))

    return rows.mapInArrow(run, SKETCH).groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))


def tiles(sketch: DataFrame) -> DataFrame:
    """(band, bucket, a, b, side, key, signature): each class of a bucket in every pair of tiles (a <= b) that holds its own tile."""
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("signature"), i * (2 * IN_BAND) + 1, F.lit(2 * IN_BAND))))
    rows = sketch.filter("signature is not null").select("key", "size", band.alias("band", "bucket"))
    several = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Plain equality joins: adaptive execution splits the partition of a hot bucket.
    rows = rows.join(several, ["band", "bucket"])
    slices = F.ceil(F.col("n") / (SLICE * TILE))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("key"), slices).cast("int"))
    of, share = W.partitionBy("band", "bucket", "slice"), F.lit(1 / TILE) + F.col("size") / F.lit(float(TILE_SHINGLES))
    # A tile is full when its classes' shares reach 1.
    rows = rows.withColumn("share", share).withColumn("nth", F.floor(F.sum("share").over(of.orderBy("key").rowsBetween(W.unboundedPreceding, 0)) - F.col("share")).cast("int"))
    each = rows.groupBy("band", "bucket", "slice").agg((F.max("nth") + 1).alias("many"))
    whole_bucket = W.partitionBy("band", "bucket")  # one row a slice
    each = each.select("band", "bucket", "slice", (F.sum("many").over(whole_bucket.orderBy("slice")) - F.col("many")).alias("before"), (F.sum("many").over(whole_bucket) - 1).alias("last"))
    rows = rows.join(each, ["band", "bucket", "slice"]).withColumn("tile", (F.col("before") + F.col("nth")).cast("int"))
    rows = rows.select("key", "band", "bucket", "tile", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("other"))
    rows = rows.select("key", "band", "bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.col("tile").alias("side"))
    return rows.join(sketch.select("key", "signature"), "key")


def _groups(batches, size: int):
    """Rows with equal first `size` columns, from sorted batches."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:size] != now:
                if held:
                    yield now, held
                now, held = row[:size], []
            held.append(row[size:])
    if held:
        yield now, held


PARTNERS = T.StructType([T.StructField(n, T.LongType()) for n in ("band", "a", "b")] + [T.StructField("bucket", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("partners", T.BinaryType())])


def pruned(dealt: DataFrame) -> DataFrame:
    """The classes of a pair of tiles that have or are candidates, with their number there and the numbers of their partners."""
    least = least_agreements()

    def run(batches):
        for (band, bucket, a, b), rows in _groups(batches, 4):
            rows.sort(key=lambda r: (r[0], r[1]))
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, HASHES)
            side = np.array([r[0] for r in rows])
            found: list[tuple[int, np.ndarray]] = []
            for i in range(len(rows)):
                if a != b and side[i] != a:
                    break
                rest = np.arange(i + 1, len(rows)) if a == b else np.flatnonzero(side == b)
                # Earlier bands: the pair is handled there.
                for e in range(0, band * IN_BAND, IN_BAND):
                    rest = rest[(sig[rest, e : e + IN_BAND] != sig[i, e : e + IN_BAND]).any(1)]
                agree = np.zeros(len(rest), np.int32)
                for k, fewest in enumerate(least):
                    if not len(rest):
                        break
                    agree = agree + (sig[rest, k * STEP : (k + 1) * STEP] == sig[i, k * STEP : (k + 1) * STEP]).sum(1)
                    rest, agree = rest[agree >= fewest], agree[agree >= fewest]
                if len(rest):
                    found.append((i, rest))
            if found:
                used = sorted({i for i, _ in found} | set(np.concatenate([r for _, r in found]).tolist()))
                number = np.zeros(len(rows), np.int32)
                number[used] = np.arange(len(used))
                partners = {i: number[r].astype(np.int32).tobytes() for i, r in found}
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(used), t) for v, t in ((band, pa.int64()), (a, pa.int64()), (b, pa.int64()), (bucket, pa.binary()))] + [pa.array([rows[i][1] for i in used], pa.binary()), pa.array(number[used]), pa.array([partners.get(i) for i in used], pa.binary())], schema=_arrow(PARTNERS))

    cols = ["band", "bucket", "a", "b"]
    return dealt.select(*cols, "side", "key", "signature").repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, PARTNERS)


SETS = T.StructType([*PARTNERS.fields[:4], PARTNERS["number"], PARTNERS["key"], T.StructField("copies", T.LongType()), T.StructField("shingles", T.BinaryType()), PARTNERS["partners"]])
LINKS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("texts", T.LongType()), T.StructField("root", T.BinaryType())])


def verified(docs: DataFrame, text_col: str, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, links, texts, root): for every piece of work and class with links there: linked documents, linked texts, and the smallest key
    that its links lead to there."""
    wanted = candidates.groupBy("key").agg(F.collect_list(F.struct("band", "a", "b", "bucket", "number", "partners")).alias("work"))
    wanted = cut(wanted)
    keys, text = wanted.select("key"), whole(text_col)
    # Only candidates' texts move, once each.
    texts = docs.select(F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"), text.alias("text"))
    n = keys.count()
    texts = texts.join(small(keys, n), "key", "left_semi") if n <= BROADCAST_ROWS else texts
    joined = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(wanted, "key")

    def sets(batches):
        for b in batches:
            for key, text, copies, work in zip(*(b.column(c).to_pylist() for c in ("key", "text", "copies", "work"))):
                got = shingles(text.encode()).tobytes()
                rows = [(w["band"], w["a"], w["b"], w["bucket"], w["number"], key, copies, got, w["partners"]) for w in work]
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), _arrow(SETS).types)], schema=_arrow(SETS))

    def run(batches):
        for _, rows in _groups(batches, 4):
            rows.sort(key=lambda r: r[0])
            each = [np.frombuffer(r[3], np.uint64) for r in rows]
            size = np.array([len(s) for s in each])
            ids = np.unique(np.concatenate(each), return_inverse=True)[1].astype(np.int32)
            begin = np.cumsum(size) - size
            parts = [ids[s : s + n] for s, n in zip(begin, size)]
            mark = np.zeros(int(ids.max()) + 1, np.int32)
            copies = np.array([r[2] for r in rows])
            links, texts, root = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), list(range(len(rows)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, r in enumerate(rows):
                if not r[4]:
                    continue
                others = np.frombuffer(r[4], np.int32)
                mark[parts[i]] = 1
                shared = np.add.reduceat(mark[np.concatenate([parts[j] for j in others])], np.cumsum(size[others]) - size[others])
                mark[parts[i]] = 0
                ok = others[shared >= threshold * (size[i] + size[others] - shared) - 1e-9]
                links[i] += copies[ok].sum()
                texts[i] += len(ok)
                links[ok] += copies[i]
                texts[ok] += 1
                for j in ok.tolist():
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
            # Keys in order, so that the smallest number of a tree needn't be the smallest key; any of the tree will do as its root.
            some = np.flatnonzero(texts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in some], pa.binary()), pa.array(links[some]), pa.array(texts[some]), pa.array([rows[find(i)][1] for i in some], pa.binary())], schema=_arrow(LINKS))

    cols = ["band", "a", "b", "bucket"]
    return joined.mapInArrow(sets, SETS).repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex that isn't the smallest of its component, from edges (u, v), by large and small stars.

    Each round joins and combines by vertex and cuts its lineage; the number of rounds grows with the logarithm of the component's size.
    Every count of rows is at most that of the edges.
    """
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    n_links is the number of other rows with the same text or a Jaccard similarity of THRESHOLD or more over five-word shingles; words lie
    between white space and are taken unchanged. class_id is the smallest doc_id that links lead to, over any number of steps. Texts of
    fewer than five words, empty and null ones too, have no shingles and are linked to equal texts only; null counts as empty. A null id
    counts as the largest; a class of null ids has the class_id 9223372036854775807.
    """
    return near_classes(docs, id_col, text_col).drop("key")


def near_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_dedup() with the key of the text."""
    sketch = cut(sketches(docs, id_col, text_col))
    found = cut(verified(docs, text_col, pruned(tiles(sketch))))
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = sketch.select("key", "first_id", "copies").join(roots.select(F.col("u").alias("key"), "root"), "key", "left").join(links, "key", "left").select("key", "first_id", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = cut(known)
    class_ids = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = known.join(class_ids, "root").select("key", "class_id", "n_links")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.unhex(F.md5(whole(text_col))), F.lit(b"")).alias("key"))
    return rows.join(classes, "key").select("doc_id", "key", "class_id", "n_links")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their class, with all their columns. Rows that share an id are one document here."""
    the_id, the_key = fresh(docs, "id"), fresh(docs, "key")
    gone = cut(near_classes(docs, id_col, text_col).filter(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) != F.col("class_id")).select(F.col("doc_id").alias(the_id), F.col("key").alias(the_key)).distinct())
    return docs.join(small(gone, gone.count()), F.col(id_col).eqNullSafe(F.col(the_id)) & (F.unhex(F.md5(whole(text_col))) == F.col(the_key)), "left_anti")
