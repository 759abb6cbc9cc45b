"""Pipelines: steps as data, lowered to one DataFrame."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import Doc
from ..functions.scorers import LOG_UNITS, WordModel
from ..functions.scratch import cut
from ..functions.text import text_of
from ..operators.registry import OPERATORS
from ..operators.rows import boundary

# Kernels travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules["siltworks"])

#: Texts whose words are held at once.
SLICE = 256


@dataclass(frozen=True)
class Step:
    """An operator with its arguments. A filter keeps rows whose statistic is within low and high, both included.

    fixed: no step may be moved past it. after: tags that must come before it. random: results differ from run to run, so nothing is cached
    at or after it. resource: cpu or gpu.
    """

    tag: str
    op: str
    args: Mapping[str, Any] = field(default_factory=dict)
    low: float | None = None
    high: float | None = None
    fixed: bool = False
    after: tuple[str, ...] = ()
    random: bool = False
    resource: str = "cpu"

    @property
    def operator(self):
        return OPERATORS[self.op]

    def within(self, stat):
        """Works for a Column and for an array."""
        out = None
        for bound, test in ((self.low, lambda: stat >= self.low), (self.high, lambda: stat <= self.high)):
            if bound is not None:
                out = test() if out is None else out & test()
        return out


def lower(df: DataFrame, steps: Sequence[Step], text: str = "text", annotate: bool = False) -> DataFrame:
    """df through the steps, in their order.

    If Spark's functions express every step, mappers in a row make one expression, which is computed once behind a boundary, and filters stay
    Columns; a statistic with two bounds is computed once too. If not, all steps run in one pass over Arrow batches, each on the rows that are
    left, so that texts go to Python and back once and what a text's statistics share is computed once. A perplexity whose model has more
    words than memory should hold is a join by word.
    annotate: keeps all rows and adds each filter's statistic as stat_<tag>.
    """
    df = df.withColumn(text, text_of(text))
    native = all(s.operator.engine == "native" for s in steps)

    def group_of(s: Step) -> str:
        if joined(s):
            return "join"
        return s.operator.kind if native or not (s.operator.one or s.operator.many) else "pass"

    for kind, group in groupby(steps, group_of):
        group = list(group)
        if kind == "join":
            for s in group:
                df = joined_perplexity(df, s, text, annotate)
        elif kind == "pass":
            df = cascade(df, group, text, annotate)
        elif kind == "map":
            value = F.col(text)
            for s in group:
                value = s.operator.build(**s.args)(value)
            df = boundary(df, text, value)
        elif annotate:
            df = df.withColumns({f"stat_{s.tag}": s.operator.build(**s.args)(F.col(text)).cast("double") for s in group})
        else:
            for s in group:
                df = filtered(df, s, s.operator.build(**s.args)(F.col(text)))
    return df


def filtered(df: DataFrame, step: Step, stat) -> DataFrame:
    """The rows whose statistic is within the bounds. BETWEEN computes it once for both; two comparisons would do so twice."""
    if step.low is not None and step.high is not None:
        return df.filter(F.call_function("between", stat, F.lit(step.low), F.lit(step.high)))
    keep = step.within(stat)
    return df if keep is None else df.filter(keep)


def joined(step: Step) -> bool:
    return step.op == "perplexity" and getattr(step.args.get("model"), "tail", None) is not None


def joined_perplexity(df: DataFrame, step: Step, text: str, annotate: bool) -> DataFrame:
    """The perplexity filter with the words of the model's tail joined to those of the texts.

    Frequent words are summed in the pass that splits the texts, so no word that moves is hot. The rows are kept, as they are used twice.
    """
    where, model = df.columns.index(text), step.args["model"]
    known, tail, unknown = WordModel(model.hashes, model.logs, model.unknown), model.tail, model.unknown
    added = T._parse_datatype_string("__n long, __sum long, __others array<struct<w: string, c: long>>")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # a few texts at a time, so that the words of a whole batch are never held at once
                b = whole.slice(at, SLICE)
                got = [known.known_part(t) for t in b.column(where).to_pylist()]
                offsets = pa.array(np.cumsum([0, *[len(g[2]) for g in got]]), pa.int32())
                words = pa.StructArray.from_arrays([pa.array([w for g in got for w in g[2]], pa.string()), pa.array([c for g in got for c in g[2].values()], pa.int64())], ["w", "c"])
                more = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.ListArray.from_arrays(offsets, words)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *added.names])

    rows = cut(df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields])).withColumn("__row", F.monotonically_increasing_id()))
    sums = rows.select("__row", F.explode("__others").alias("o")).select("__row", "o.w", "o.c").join(tail, "w", "left")
    sums = sums.groupBy("__row").agg(F.sum(F.col("c") * F.coalesce("log", F.lit(unknown))).alias("__more"))
    total = F.col("__sum") + F.coalesce("__more", F.lit(0))
    stat = F.when(F.col("__n") > 0, F.round(F.pow(F.lit(10.0), -total / F.lit(float(LOG_UNITS)) / F.col("__n")), 1)).otherwise(F.lit(0.0))
    out = rows.drop("__others").join(sums, "__row", "left").withColumn(f"stat_{step.tag}", stat)
    keep = None if annotate else step.within(F.col(f"stat_{step.tag}"))
    out = out if keep is None else out.filter(keep)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[f"stat_{step.tag}"] * annotate)


def cascade(df: DataFrame, steps: Sequence[Step], text: str, annotate: bool) -> DataFrame:
    """The steps as one pass over batches, some texts at a time. A filter drops rows before the next step sees them."""
    where = df.columns.index(text)
    added = [f"stat_{s.tag}" for s in steps if s.operator.kind == "filter"] if annotate else []
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    schema[text].nullable = True
    work = [(s, s.operator.one, s.operator.many, dict(s.args), s.operator.kind) for s in steps]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, stats = whole.slice(at, SLICE), []
                left, docs = np.arange(b.num_rows), [Doc(t) for t in b.column(where).to_pylist()]
                for s, one, many, args, kind in work:
                    if kind == "map":
                        new = [one(d.text, **args) for d in docs]
                        docs = [d if t == d.text else Doc(t) for d, t in zip(docs, new)]
                        continue
                    stat = np.array([one(d, **args) for d in docs], float) if one else np.asarray(many([d.text for d in docs], **args), float) if docs else np.zeros(0)
                    if annotate:
                        stats.append(stat)
                        continue
                    keep = s.within(stat)
                    if keep is not None and not keep.all():
                        left, docs = left[keep], [d for d, k in zip(docs, keep.tolist()) if k]
                if len(left) < b.num_rows:
                    b = b.take(pa.array(left))
                arrays = [pa.array([d.text for d in docs], pa.string()) if i == where else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(x) for x in stats]], names=[*b.schema.names, *added])

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew where its files give fewer tasks than the cluster has places, as one small file does; larger tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def funnel(df: DataFrame, steps: Sequence[Step], text: str = "text") -> DataFrame:
    """(step, tag, rows_in, rows_out): how many rows each filter sees and keeps in the given order, from one pass over the data."""
    filters = [s for s in steps if s.operator.kind == "filter"]
    rows = lower(df, steps, text, annotate=True)
    alive, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, s in enumerate(filters):
        ok = s.within(F.col(f"stat_{s.tag}"))
        alive = alive & (F.lit(True) if ok is None else ok)
        counts.append(F.count(F.when(alive, 1)).alias(f"n{i + 1}"))
    one = rows.agg(*counts)
    each = [F.struct(F.lit(i).alias("step"), F.lit(s.tag).alias("tag"), F.col(f"n{i}").alias("rows_in"), F.col(f"n{i + 1}").alias("rows_out")) for i, s in enumerate(filters)]
    return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def with_args(steps: Sequence[Step], **by_op: Mapping[str, Any]) -> list[Step]:
    """Steps with more arguments for operators that need them: models, word lists, tokenizer files."""
    return [replace(s, args={**s.args, **by_op[s.op]}) if s.op in by_op else s for s in steps]
