"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small, spaced, whole

#: Runs at the leaves of the tree, a power of two; slots by which the entries of a run are spread over tasks.
RUNS, SLOTS = 16, 4096


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, digest, proof): SHA-256 of the normalised text, and its length with a second hash, against which digests are verified. place
    numbers the rows, so that rows which repeat an id can be told apart."""
    text = spaced(whole(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.monotonically_increasing_id().alias("place"))
    return rows.select("id", "place", F.unhex(F.sha2("t", 256)).alias("digest"), F.struct(F.length("t").alias("n"), F.xxhash64("t").alias("x")).alias("proof"))


def _one() -> list[Column]:
    """What a merge keeps of the entries with one digest: the smallest of the row that stays, the count, the smallest and largest proof."""
    return [F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"), F.min("low").alias("low"), F.max("high").alias("high")]


def _verified(level: DataFrame) -> DataFrame:
    """Two proofs for a digest (two texts with one SHA-256) end the job instead of merging different texts."""
    sound = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two different texts share a SHA-256 digest")).cast("long")).otherwise(F.col("group_size"))
    return level.withColumn("group_size", sound)


def merged_runs(rows: DataFrame, runs: int = RUNS, slots: int = SLOTS) -> DataFrame:
    """(id, place, digest, proof) to one row per digest: digest, keep_id, keep_place, group_size.

    The partitions are dealt to `runs` runs, and each run is merged from its partitions' entries, equal digests combined before they move. Then
    come log2(runs) rounds, as in a binomial tree: in round k every run whose bit k is set goes to the run without it, both are sorted by
    digest, and the merge of the two has one entry per digest. A run lies in `slots` slots by the first bits of its digests, so every merge is
    many tasks, each over two sorted stretches, and a digest with a third of all rows is one entry per run. Every level verifies its proofs
    and keeps the smallest id; null ids count as the largest, and of equal ids the first place stays.
    """
    slot = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(slots)).cast("int")
    keep = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    level = rows.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), slot.alias("slot"), "digest", keep.alias("keep"), F.lit(1).cast("long").alias("group_size"), F.col("proof").alias("low"), F.col("proof").alias("high"))
    level = _verified(level.groupBy("run", "slot", "digest").agg(*_one()))
    bit = 1
    while bit < runs:
        level = level.withColumn("run", F.col("run").bitwiseAND(~bit))
        level = level.repartition("run", "slot").sortWithinPartitions("run", "slot", "digest")
        level = _verified(level.groupBy("run", "slot", "digest").agg(*_one()))  # a pass over sorted rows, without a further exchange
        bit *= 2
    return level.select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.place").alias("keep_place"), "group_size")


def judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_dedup() with the digest as bytes."""
    rows = cut(digested(docs, id_col, text_col))
    out = rows.select("id", "place", "digest").join(merged_runs(rows), "digest")  # a plain equality join: adaptive execution splits the partition of a hot digest
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. Of equal texts the row with the
    smallest id stays, and of rows that repeat both id and text one. Null ids count as the largest: they stay only in groups without an id,
    where keep_id is null. Other columns are not looked at. An empty table gives an empty result.
    """
    return judged(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    What goes is joined to the rows, not what stays, so that texts needn't be shuffled as long as the counted list is small.
    """
    every = cut(judged(docs, id_col, text_col).filter("group_size > 1").select("doc_id", "digest", "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("least")))
    the_id, the_digest, the_place = (fresh(docs, n) for n in ("id", "digest", "place"))
    gone = every.filter("not least").select(F.col("doc_id").alias(the_id), F.col("digest").alias(the_digest)).distinct()
    gone = cut(gone)
    digest = F.unhex(F.sha2(spaced(whole(text_col)), 256))
    out = docs.join(small(gone, gone.count()), F.col(id_col).eqNullSafe(F.col(the_id)) & (digest == F.col(the_digest)), "left_anti")
    if every.filter("least and not kept").isEmpty():
        return out
    # Some rows repeat both id and text. They are numbered in a written table, so that numbers hold, and the first of each stays.
    out = cut(out.withColumns({the_digest: digest, the_place: F.monotonically_increasing_id()}))
    first = out.groupBy(id_col, the_digest).agg(F.min(the_place).alias(the_place)).select(the_place)
    return out.join(first, the_place, "left_semi").drop(the_digest, the_place)
