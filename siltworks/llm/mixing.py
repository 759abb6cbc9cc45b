"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, n_words, small, whole


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """totals (source, source_size) with target: `share` of all sizes dealt by weight, none above `cap` times its source's size.

    Sources by code point, null last, get the weights in turn. What is above a cap is dealt to the others by weight until none is above;
    that is the level at which the uncapped sources, in order of cap over weight, take what the capped ones leave. One row per source: the
    table is small, as sources are, and its window runs in one task.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    dealt = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    dealt = dealt.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = W.orderBy((F.col("most") / F.col("w")), F.col("source").asc_nulls_last())
    whole_table = fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dealt = dealt.withColumns({"k": F.row_number().over(fill), "before": F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)), "all": F.sum("source_size").over(whole_table) * F.lit(float(share))})
    level = (F.col("all") - F.col("before")) / F.col("left")
    dealt = dealt.withColumn("level", F.min(F.when(level * F.col("w") <= F.col("most"), F.struct("k", level.alias("v")))).over(whole_table))
    return dealt.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("k") < F.col("level.k")), F.col("most")).otherwise(F.col("level.v") * F.col("w")).alias("target"))


def pareto_key(u: Column, odds_of: Column) -> Column:
    """The order of Pareto sampling: random odds divided by inclusion odds; certain ones first, impossible ones last."""
    p = F.least(F.greatest(odds_of, F.lit(0.0)), F.lit(1.0))
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf"))).otherwise((u / (1 - u)) / (p / (1 - p)))


#: Weights count to an eighth of an octave, so a source has a bounded number of them.
EIGHTHS = 8


def expected_copies(classes: DataFrame, cap: float) -> DataFrame:
    """classes (name, eighth, words, target) with expected: how often a document of the class is taken, in proportion to its weight up to cap.

    The words expected of a source are its target. That is the level at which the classes that stay below the cap, from the heaviest on, take
    what the capped ones leave; without weight nothing is taken. A source has a bounded number of classes.
    """
    weight = F.pow(F.lit(2.0), F.col("eighth") / EIGHTHS)
    of = W.partitionBy("name").orderBy(F.desc("eighth"))
    fill = classes.filter("eighth is not null").withColumn("w", weight)
    fill = fill.withColumns({"before": F.coalesce(F.sum("words").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "rest": F.sum(F.col("words") * F.col("w")).over(of.rowsBetween(0, W.unboundedFollowing))})
    level = F.when(F.col("rest") > 0, F.greatest(F.col("target") - F.lit(float(cap)) * F.col("before"), F.lit(0.0)) / F.col("rest"))
    fits = F.when(level * F.col("w") <= F.lit(float(cap)) * (1 + 1e-12), F.struct(F.col("before").alias("k"), level.alias("v")))
    fill = fill.withColumn("level", F.min(fits).over(W.partitionBy("name"))["v"])
    return fill.select("name", "eighth", F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("w"), F.lit(float(cap)))).alias("expected"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11, weight_col: str | None = None, size_power: float = 0.0, bin_rows: int = 2000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, expected, taken.

    A document's weight is weight_col (1 without one) times size ** size_power, to an eighth of an octave. It is expected to be taken in
    proportion to its weight, cap times at most, so that a source's expected words are its target. The whole part of that are certain copies.
    The rest of the target is a Pareto sample: documents are ranked by random odds over the odds of the fraction, and taken in that order
    until the next doesn't fit. What room is then left is filled with the largest documents that fit, in the same order among equal sizes, until
    nothing fits; a last one that is too large is taken if that comes nearer to the target. So a source misses its target by half the smallest
    document with a copy left at most. Randomness is a hash of seed and id. Running sums are in two levels, within bins of the key and over the
    bins of a source, so no task holds a whole source.

    Null texts have size 0; a null source is a source; a null or negative weight is 0. Documents of size or weight 0 take 0. Repeated ids draw
    the same number. Other columns are not looked at. An empty table gives an empty result.
    """
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(whole(text_col)).alias("size"), weight.alias("weight"))
    weighed = F.col("weight") * F.pow(F.col("size").cast("double"), F.lit(float(size_power)))
    rows = cut(rows.select("doc_id", "source", "size", F.when((F.col("weight") > 0) & (F.col("size") > 0), F.round(F.log2(weighed) * EIGHTHS).cast("int")).alias("eighth")))
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    classes = cut(rows.groupBy("source", "eighth").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    per = source_targets(totals, weights, share, cap).select(name.alias("name"), "source_size", "target")
    expected = expected_copies(classes.withColumn("name", name).join(per.select("name", "target"), "name"), cap)
    per = cut(per.join(expected.groupBy("name").agg(F.collect_list(F.struct("eighth", "expected")).alias("of")), "name", "left"))
    sources, n = per.count(), classes.agg(F.sum("n")).first()[0] or 0
    bins = max(8, n // bin_rows)
    rows = rows.withColumn("name", name).join(small(per, sources), "name")
    rows = rows.withColumn("expected", F.coalesce(F.get(F.filter("of", lambda x: x["eighth"] == F.col("eighth")), F.lit(0))["expected"], F.lit(0.0)))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("copies", F.floor(F.col("expected") + F.lit(1e-9)).cast("int"))
    rows = rows.withColumn("key", pareto_key(u, F.col("expected") - F.col("copies")))
    # Bins of about equal size: the key times the odds of a usual document is about u / (1 - u).
    usual = F.least(F.lit(float(cap)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    usual = F.least(F.greatest(usual - F.floor(usual), F.lit(1e-6)), F.lit(1 - 1e-6))
    level = F.col("key") * usual / (1 - usual)
    rows = rows.withColumn("bin", F.when(level < float("inf"), F.least(F.floor(level / (1 + level) * bins), F.lit(bins - 1))).otherwise(F.lit(bins - 1)).cast("int"))
    rows = cut(rows.select("doc_id", "source", "name", "size", "source_size", "target", "expected", "eighth", "copies", "key", "bin"))
    rows = cut(_sampled(rows, sources))
    rows = _filled(rows, cap, sources)
    return rows.select("doc_id", "source", "size", "source_size", "target", "expected", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def _room(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("room"))


def _sampled(rows: DataFrame, sources: int) -> DataFrame:
    """One more copy of the documents before the first that doesn't fit, in the order of the key; such as never could fit are passed over."""
    rows = rows.join(small(_room(rows), sources), "name")
    may = (F.col("key") < float("inf")) & (F.col("size") <= F.col("room"))
    rows = rows.withColumn("bid", F.when(may, F.col("size")).otherwise(F.lit(0)))
    by_bin = rows.groupBy("name", "bin").agg(F.sum("bid").alias("in_bin"))
    before = by_bin.withColumn("before", F.coalesce(F.sum("in_bin").over(W.partitionBy("name").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("in_bin")
    rows = rows.join(before, ["name", "bin"])
    within = F.sum("bid").over(W.partitionBy("name", "bin").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    took = (F.col("bid") > 0) & (F.col("before") + within <= F.col("room"))
    return rows.withColumn("copies", F.col("copies") + F.when(took, F.lit(1)).otherwise(F.lit(0))).drop("room", "bid", "before")


def _filled(rows: DataFrame, cap: float, sources: int) -> DataFrame:
    """One more copy of documents that fill what room is left: how many of each size is found on the sizes' counts alone, which are few."""
    levels = int(cap)
    left = F.lit(levels) - F.col("copies")
    may = F.col("eighth").isNotNull() & (F.col("size") > 0) & (left > 0)
    sizes = rows.filter(may).groupBy("name", "size").agg(F.sum(left).cast("long").alias("n")).join(_room(rows), "name")
    # Larger sizes than the room, but for the smallest of them, can't be used.
    within = sizes.filter("size <= room").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    beyond = sizes.groupBy("name").agg(F.max("room").alias("room"), F.min(F.when(F.col("size") > F.col("room"), F.col("size"))).alias("over"))
    fill = beyond.join(within, "name", "left")
    kind = "array<struct<size:bigint,k:bigint>>"

    def step(a, s):
        k = F.least(s["n"], F.floor(F.greatest(a["room"], F.lit(0.0)) / s["size"])).cast("long")
        more = F.when(k > 0, F.concat(a["took"], F.array(F.struct(s["size"].cast("long").alias("size"), k.alias("k"))))).otherwise(a["took"])
        # The smallest document of which one is left is the last that comes.
        return F.struct((a["room"] - k * s["size"]).alias("room"), more.alias("took"), F.when(s["n"] > k, s["size"].cast("long")).otherwise(a["left"]).alias("left"))

    start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast(kind).alias("took"), F.col("over").cast("long").alias("left"))
    fill = fill.select("name", F.aggregate(F.coalesce("sizes", F.array().cast("array<struct<size:bigint,n:bigint>>")), start, step).alias("f"))
    one = F.when(2 * F.col("f.room") > F.col("f.left"), F.array(F.struct(F.col("f.left").alias("size"), F.lit(1).cast("long").alias("k")))).otherwise(F.array().cast(kind))
    wanted = fill.select("name", F.explode(F.concat("f.took", one)).alias("t")).groupBy("name", F.col("t.size").alias("size")).agg(F.sum("t.k").alias("k"))
    wanted = cut(wanted)
    rows = rows.join(small(wanted, wanted.count()), ["name", "size"], "left")
    chosen = rows.filter(may & F.col("k").isNotNull())
    # First one copy of each, in the order of the key, then a second of those that have one left, and so on.
    has = [F.when(left > j, F.lit(1)).otherwise(F.lit(0)) for j in range(levels)]
    in_bin = chosen.groupBy("name", "size", "bin").agg(*[F.sum(h).alias(f"n{j}") for j, h in enumerate(has)])
    of = W.partitionBy("name", "size")
    before, above = [], F.lit(0)
    for j in range(levels):
        before.append((above + F.coalesce(F.sum(f"n{j}").over(of.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias(f"before{j}"))
        above = above + F.sum(f"n{j}").over(of)
    chosen = chosen.join(in_bin.select("name", "size", "bin", *before), ["name", "size", "bin"])
    within = W.partitionBy("name", "size", "bin").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    gets = [F.when((h == 1) & (F.col(f"before{j}") + F.sum(h).over(within) <= F.col("k")), 1).otherwise(0) for j, h in enumerate(has)]
    chosen = chosen.withColumn("copies", F.col("copies") + sum(gets[1:], gets[0])).drop(*[f"before{j}" for j in range(levels)])
    return chosen.unionByName(rows.filter(~(may & F.col("k").isNotNull())))
