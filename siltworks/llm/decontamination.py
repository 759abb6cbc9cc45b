"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, whole

#: Fixed masks over 10 tokens: 1 is read, 0 is ignored. All read the first and the last and as many in all. Wherever two of 12 tokens in a row are
#: substituted, one of the masks at one of its three places reads neither (tests enumerate this), so every window that verifies at 10 of 12 has a seed.
MASKS = ("1101011001", "1001001111", "1011010101")
#: Benchmark items are matched in pieces of so many tokens that overlap by so many. Equal pieces are one, and their seeds, rows of a few numbers, are
#: broadcast in blocks of about so many.
PIECE, PIECE_OVERLAP, BLOCK_SEEDS = 96, 32, 100_000
#: Pieces, of at most PIECE numbers each, that may be broadcast to the hits; more are joined by a shuffle.
MOST_PIECES = 20_000
#: Letters of scripts that don't put spaces between words: each is a token.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits, and of single letters in scripts without spaces."""
    between = r"[^\p{L}\p{N}]+"
    split = F.when(text.rlike(SPACELESS), F.split(F.lower(text), f"{between}|(?<={SPACELESS})|(?={SPACELESS})")).otherwise(F.split(F.lower(text), between))
    tokens = F.filter(split, lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def places(rows: DataFrame, keep: list[str], tokens: str, span: int) -> DataFrame:
    """One row per place of the masks: keep, tokens, at (from 0), ends: a hash of the two outer tokens, which every mask reads."""
    all_places = F.when(F.size(tokens) >= span, F.sequence(F.lit(0), F.size(tokens) - span))  # null, and so no row, for short texts
    at = rows.select(*keep, tokens, F.explode(all_places).alias("at"))
    return at.withColumn("ends", F.xxhash64(F.get(tokens, F.col("at")), F.get(tokens, F.col("at") + (span - 1))))


def seeded(at: DataFrame, tokens: str, masks: tuple[str, ...]) -> DataFrame:
    """places() times masks, with seed: the hash of the tokens that the mask reads, and of the mask."""
    reads = F.array(*[F.array(*[F.lit(i) for i, c in enumerate(m) if c == "1"]) for m in masks])
    by_mask = at.select("*", F.posexplode(reads).alias("mask", "reads"))
    read = [F.get(tokens, F.col("at") + F.get("reads", F.lit(k))) for k in range(masks[0].count("1"))]
    return by_mask.withColumn("seed", F.xxhash64("mask", *read)).drop("mask", "reads", "ends")


def agreement(aligned: DataFrame, window: int) -> DataFrame:
    """aligned (..., part, item, skip) with agreement: the largest share of equal tokens in a window of item and part.

    Item token j lies on token j + skip of part. A window is `window` tokens, or the whole item if that is shorter.
    """
    equal = F.transform("item", lambda t, j: F.when(F.get("part", j + F.col("skip")) == t, 1).otherwise(0))
    width = F.least(F.lit(window), F.size("same"))
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - width + 1), lambda i: F.aggregate(F.slice("same", i, width), F.lit(0), lambda a, x: a + x))
    # `same` is a column of its own, so that it is computed once and not in every window.
    return aligned.withColumn("same", equal).withColumn("agreement", F.array_max(sums) / width).drop("same")


def _hits(texts: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(doc_id, doc, at, piece, item_at): equal seeds of texts and of a block of benchmark pieces, which is small enough to broadcast."""
    at = places(items, ["piece"], "item", len(masks[0]))
    seeds = F.broadcast(seeded(at, "item", masks).select("piece", F.col("at").alias("item_at"), "seed"))
    # Few places have the outer tokens of any seed, so the masks are read at few places only.
    near = places(texts, ["doc_id"], "doc", len(masks[0])).join(F.broadcast(at.select("ends").distinct()), "ends", "left_semi")
    return seeded(near, "doc", masks).join(seeds, "seed")


def runs(n: int, similarity: float) -> list[tuple[int, int]]:
    """(at, length) of runs that make up an item of n tokens: one more than may differ in it, so that one of them is whole in every match."""
    differ = max(k for k in range(n) if (n - k) / n >= similarity)
    ends = [n * k // (differ + 1) for k in range(differ + 2)]
    return [(a, z - a) for a, z in zip(ends, ends[1:])]


def _short_hits(texts: DataFrame, items: DataFrame, of: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """_hits() for items of few tokens: equal runs, by the items' sizes, of texts and of a block of items."""
    all_runs = F.coalesce(*[F.when(F.size("item") == n, F.array(*[F.struct(F.lit(a).alias("item_at"), F.lit(k).alias("k")) for a, k in r])) for n, r in of.items()])
    run = items.select("piece", "item", F.explode(all_runs).alias("r")).select("piece", "item", "r.*")
    run = run.withColumns({"first": F.get("item", F.col("item_at")), "seed": F.xxhash64("k", F.slice("item", F.col("item_at") + 1, F.col("k")))})
    at = texts.select("doc_id", "doc", F.posexplode("doc").alias("at", "first")).join(F.broadcast(run.select("first").distinct()), "first", "left_semi")
    ks = F.array(*[F.lit(k) for k in sorted({k for r in of.values() for _, k in r})])
    seeds = at.select("doc_id", "doc", "at", F.explode(ks).alias("k")).filter(F.col("at") + F.col("k") <= F.size("doc"))
    seeds = seeds.select("doc_id", "doc", "at", F.xxhash64("k", F.slice("doc", F.col("at") + 1, F.col("k"))).alias("seed"))
    return seeds.join(F.broadcast(run.select("piece", "item_at", "seed")), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 12, similarity: float = 0.8, masks: tuple[str, ...] = MASKS, short: bool = True) -> DataFrame:
    """(doc_id, item_id, shift, agreement): every alignment of a benchmark item with a document that verifies.

    A hit is a place in a document and one in an item with equal hashes under one mask. It fixes an alignment, and this is verified: some
    window of `window` tokens (or the whole item, if shorter) must agree in at least `similarity` of its tokens. Items longer than PIECE
    tokens are cut into pieces that overlap by more than a window. With the default masks, window and similarity no such alignment is missed.
    Items of fewer tokens than a window or a mask are matched as wholes; without `short` they match nothing. The benchmark is the stated query
    set: pieces that items share count once, and their seeds are counted and dealt into blocks of about BLOCK_SEEDS, each of which is broadcast against all documents.
    """
    least = max(len(masks[0]), window)
    tokens = token_hashes(whole(item_text_col))
    every = benchmark.select(F.col(item_col).alias("item_id"), tokens.alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - PIECE_OVERLAP - 1, F.lit(0)), F.lit(PIECE - PIECE_OVERLAP))
    cuts = F.when(F.size("t") >= least, F.transform(starts, lambda o: F.slice("t", o + 1, PIECE)))
    if short:
        cuts = F.coalesce(cuts, F.when(F.size("t") > 0, F.array("t")))
    held = every.select("item_id", F.explode(cuts).alias("item"))
    held = cut(held.select("item_id", "item", F.struct(F.xxhash64("item").alias("x"), F.xxhash64(F.lit(1), F.reverse("item")).alias("y")).alias("piece")))
    of_items = held.select("item_id", "piece").distinct()
    pieces = cut(held.select("piece", "item").distinct())
    sizes = {r.n: r["count"] for r in pieces.groupBy(F.least(F.size("item"), F.lit(least)).alias("n")).count().collect()}  # as many rows as a window has tokens at most
    n = pieces.filter(F.size("item") >= least).agg(F.sum(F.size("item"))).first()[0] or 0
    blocks = max(1, -(-n * len(masks) // BLOCK_SEEDS))
    texts = docs.select(F.col(id_col).alias("doc_id"), token_hashes(whole(text_col)).alias("doc"))
    found = [_hits(texts, pieces.filter((F.size("item") >= least) & (F.pmod("piece.x", F.lit(blocks)) == k)), masks) for k in range(blocks)]
    of = {n: runs(n, similarity) for n in sorted(sizes) if n < least}
    blocks_of_few = -(-sum(len(of[n]) * sizes[n] for n in of) // BLOCK_SEEDS)
    found += [_short_hits(texts, pieces.filter((F.size("item") < least) & (F.pmod("piece.x", F.lit(blocks_of_few)) == k)), of) for k in range(blocks_of_few)]
    hits = reduce(DataFrame.unionByName, [h.select("doc_id", "doc", "at", "piece", "item_at") for h in found])
    hits = hits.join(small(pieces, sum(sizes.values()), MOST_PIECES), "piece")
    shift = F.col("at") - F.col("item_at")
    # The stretch of the document that the item can lie on, with the shift into that stretch.
    stretch = F.slice("doc", F.greatest(shift, F.lit(0)) + 1, F.size("item"))
    hits = hits.select("doc_id", "piece", "item", shift.alias("shift"), F.least(shift, F.lit(0)).alias("skip"), stretch.alias("part"))
    # Above an aggregation, so that the test isn't pushed to where it would compute the windows once for each use.
    checked = agreement(hits, window).groupBy("doc_id", "piece", "shift").agg(F.max("agreement").alias("agreement")).filter(F.col("agreement") >= similarity)
    checked = checked.join(small(of_items, sum(sizes.values())), "piece")
    return checked.groupBy("doc_id", "item_id", "shift").agg(F.max("agreement").alias("agreement"))


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document id: doc_id, items (the benchmark items that it holds, by id), agreement (the best), contaminated.

    Null and empty texts hold no item, and items without tokens match nothing. Repeated ids are one row; a null id is an id. Empty tables on either side leave every document clean.
    """
    found = overlaps(docs, benchmark, id_col, text_col, **options).select("doc_id", "item_id", "agreement")
    ids = docs.select(F.col(id_col).alias("doc_id"))
    rows = ids.select("doc_id", F.lit(None).cast(found.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("agreement")).unionByName(found)
    out = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("agreement").alias("agreement"))
    return out.select("doc_id", "items", F.coalesce("agreement", F.lit(0.0)).alias("agreement"), F.col("agreement").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. Rows that share an id are one document here."""
    the_id = fresh(docs, "id")
    gone = cut(overlaps(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(the_id)).distinct())
    return docs.join(small(gone, gone.count()), F.col(id_col).eqNullSafe(F.col(the_id)), "left_anti")
