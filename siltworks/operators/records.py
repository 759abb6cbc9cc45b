"""Record operators: conversations, instructions, image-text records, views, splits and rounds, as DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.scratch import unused
from .rows import with_ordinal

IMAGE, END = "<image>", "<|__dj__eoc|>"


def captions(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, text): the second turn of each conversation, trimmed, as an image caption. Conversations of one turn and blank captions give none."""
    second = F.get(F.sort_array(F.collect_list(F.struct(F.col(turn), tx.text_of(text).alias("t")))), F.lit(1))["t"]
    rows = turns.groupBy(conv).agg(second.alias("c")).withColumn("c", F.regexp_replace("c", r"^\s+|\s+$", "")).filter("c is not null and c != ''")
    return rows.select(conv, F.concat(F.lit(f"{IMAGE}\n"), "c", F.lit(f" {END}")).alias("text"))


def checked(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """df, where a row that isn't ok ends the job."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def instructions(df: DataFrame, parts: Sequence[str] = ("instruction", "input", "output"), out: str = "raw_content") -> DataFrame:
    return df.withColumn(out, tx.join_nonempty(*[F.col(p) for p in parts]))


def output_text(df: DataFrame) -> Column:
    """text, else raw_content, else empty."""
    return F.coalesce(*[F.col(c) for c in ("text", "raw_content") if c in df.columns], F.lit(""))


def image_chunks(text: Column, paths: Column) -> Column:
    """array of (text, paths): the parts of a text between end marks that speak of images, each with the next images that it names."""
    parts = F.split(text, re.escape(END))
    # Count by length, so that no text is a pattern.
    count = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(IMAGE)))) / len(IMAGE)).cast("int")
    counted = F.transform(parts, lambda c: F.struct(F.trim(F.replace(c, F.lit(IMAGE))).alias("text"), count(c).alias("n")))
    before = F.transform(counted, lambda x, i: F.struct(x["text"].alias("text"), x["n"].alias("n"), F.aggregate(F.slice(counted, 1, i), F.lit(0), lambda a, y: a + y["n"]).alias("at")))
    return F.transform(F.filter(before, lambda x: x["n"] > 0), lambda x: F.struct(F.regexp_replace(x["text"], r"^\s+|\s+$", "").alias("text"), F.slice(paths, x["at"] + 1, x["n"]).alias("paths")))


def reduced(results: Column, any_or_all: str = "any") -> Column:
    """Whether any or all are true; true if there are none."""
    if any_or_all not in ("any", "all"):
        raise ValueError(f"any or all, not {any_or_all!r}")
    whole = F.exists(results, lambda x: x) if any_or_all == "any" else F.forall(results, lambda x: x)
    return (F.size(results) == 0) | whole


def reduced_score(scores: Column, mode: str = "avg") -> Column:
    if mode == "avg":
        return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    if mode in ("max", "min"):
        return F.array_max(scores) if mode == "max" else F.array_min(scores)
    raise ValueError(f"avg, max or min, not {mode!r}")


def byte_size(value: int | float | str) -> int:
    """124KB and the like, in steps of 1024."""
    if isinstance(value, (int, float)):
        return int(value)
    m = re.fullmatch(r"\s*([0-9.]+)\s*([kmgt]?b)?\s*", value, re.I)
    if not m:
        raise ValueError(f"no size: {value!r}")
    return int(float(m[1]) * 1024 ** ["b", "kb", "mb", "gb", "tb"].index((m[2] or "b").lower()))


def image_aspect(shapes: Column, low: float = 0.0, high: float = float("inf"), any_or_all: str = "any") -> Column:
    """shapes: array of (width, height)."""
    return reduced(F.transform(shapes, lambda s: F.when(s["height"] > 0, s["width"] / s["height"]).otherwise(0.0).between(low, high)), any_or_all)


def image_shape(shapes: Column, width: tuple[int, int] = (1, 1 << 31), height: tuple[int, int] = (1, 1 << 31), any_or_all: str = "any") -> Column:
    return reduced(F.transform(shapes, lambda s: s["width"].between(*width) & s["height"].between(*height)), any_or_all)


def image_bytes(sizes: Column, low: int | str = 0, high: int | str = "1TB", any_or_all: str = "any") -> Column:
    return reduced(F.transform(sizes, lambda s: s.between(byte_size(low), byte_size(high))), any_or_all)


def score_bounds(score: Column, min_score: float | None = None, max_score: float | None = None) -> Column:
    """The predicate of a model score: safety and perplexity have a largest, the others a smallest."""
    keep = F.lit(True)
    keep = keep & (score >= min_score) if min_score is not None else keep
    return keep & (score <= max_score) if max_score is not None else keep


def on_field(df: DataFrame, field: str, f) -> DataFrame:
    return df.withColumn(field, f(F.col(field)))


def collected_views(df: DataFrame, n: int, out: str = "views") -> DataFrame:
    """view0 to view(n-1) as one array."""
    return df.withColumn(out, F.array(*[F.col(f"view{i}") for i in range(n)])).drop(*[f"view{i}" for i in range(n)])


def splits(df: DataFrame, sizes: Mapping[str, int], order: Sequence[str]) -> DataFrame:
    """df with split: disjoint stretches of the given order. Rows after the last stretch go."""
    place = unused("n", df)
    rows, start, name = with_ordinal(df, order, place), 0, F.lit(None).cast("string")
    for k, n in sizes.items():
        name = F.when(F.col(place).between(start, start + n - 1), F.lit(k)).otherwise(name)
        start += n
    return rows.withColumn("split", name).filter("split is not null").drop(place)


def matched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The join on a key that every left row must find; one that doesn't ends the job."""
    there = unused("there", left, right)
    return checked(left.join(right.withColumn(there, F.lit(True)), on, "left"), F.col(there), f"a {on} has no partner").drop(there)


def rounds(df: DataFrame, group: str, order: Sequence[str], per_group: int | None = None) -> DataFrame:
    """df with round: the place of each row within its group; per_group demands that many rows of each."""
    rows = df.withColumn("round", F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1)
    if per_group is not None:
        many = unused("many", rows)
        rows = checked(rows.withColumn(many, F.count("*").over(W.partitionBy(group))), F.col(many) == per_group, f"not {per_group} rows for each {group}").drop(many)
    return rows


# Arrays: tokens, tensors and boxes


def token_ids(ids: Column, most: int = 254, bos: int = 0, eos: int = 2, shift: int = 1) -> Column:
    """Cut to `most`, between begin and end marks; ids move up by `shift`, and so does the begin mark."""
    cut = F.slice(ids, 1, most)
    return F.concat(F.transform(F.concat(F.array(F.lit(bos)), cut), lambda t: (t + shift).cast("int")), F.array(F.lit(eos)))


def padded(ids: Column, size: int, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def embedded(df: DataFrame, ids: str, table: DataFrame, key: str = "token", value: str = "vector", row: str = "row_id", out: str = "vectors") -> DataFrame:
    """df with the vectors of its ids in order; ids that the table lacks have none. The table is joined by key, of whatever size it is."""
    each = df.select(row, F.posexplode(ids).alias("__p", "__t")).join(table.select(F.col(key).alias("__t"), F.col(value).alias("__v")), "__t")
    got = each.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__v"))), lambda x: x["__v"]).alias(out))
    return df.join(got, row, "left")


def as_float(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("float"))


def normalized(x: Column, mean: float, std: float) -> Column:
    return F.transform(x, lambda v: (v - mean) / std)


def unit_length(x: Column) -> Column:
    """Divided by its length; zeros stay zeros."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(x, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(0.0))


def boxes_resized(boxes: Column, ref: Column) -> Column:
    """Boxes in the frame of a reference box, both as (top, left, bottom, right)."""
    at = lambda i: F.get(ref, F.lit(i))
    size = lambda i: F.when(i % 2 == 0, at(2) - at(0)).otherwise(at(3) - at(1))
    return F.transform(boxes, lambda b: F.transform(b, lambda v, i: (v - F.when(i % 2 == 0, at(0)).otherwise(at(1))) / size(i)))


def boxes_overlap(boxes: Column, ref: Column) -> Column:
    """The share of each box that lies in the reference box; 0 for boxes without area."""

    def share(b: Column) -> Column:
        g = lambda c, i: F.get(c, F.lit(i))
        h = F.greatest(F.lit(0.0), F.least(g(b, 2), g(ref, 2)) - F.greatest(g(b, 0), g(ref, 0)))
        w = F.greatest(F.lit(0.0), F.least(g(b, 3), g(ref, 3)) - F.greatest(g(b, 1), g(ref, 1)))
        area = (g(b, 2) - g(b, 0)) * (g(b, 3) - g(b, 1))
        return F.when(area > 0, h * w / area).otherwise(0.0)

    return F.transform(boxes, share)


def boxes_kept(boxes: Column, labels: Column, least: float = 0.5) -> Column:
    """array of (box, label) of the boxes of which more than `least` lies in the unit square."""
    square = F.array(*[F.lit(float(v)) for v in (0, 0, 1, 1)])
    shares = boxes_overlap(boxes, square)
    pairs = F.arrays_zip(boxes.alias("box"), labels.alias("label"), shares.alias("share"))
    return F.transform(F.filter(pairs, lambda p: p["share"] > least), lambda p: F.struct(p["box"].alias("box"), p["label"].alias("label")))


def boxes_flipped(boxes: Column, width: Column) -> Column:
    """(left, top, right, bottom) mirrored."""
    g = lambda b, i: F.get(b, F.lit(i))
    return F.transform(boxes, lambda b: F.array(width - g(b, 2), g(b, 1), width - g(b, 0), g(b, 3)))


def boxes_sane(boxes: Column, width: Column, height: Column, least: float = 1.0) -> Column:
    """Boxes of at least `least` in both directions that lie within the image."""
    g = lambda b, i: F.get(b, F.lit(i))
    return F.filter(boxes, lambda b: (g(b, 2) - g(b, 0) >= least) & (g(b, 3) - g(b, 1) >= least) & (g(b, 0) >= 0) & (g(b, 1) >= 0) & (g(b, 2) <= width) & (g(b, 3) <= height))
