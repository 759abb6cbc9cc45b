"""Profiles: what each step costs and keeps, measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import Doc
from ..operators.rows import boundary
from .order import Cost, cache_point, cheapest, fastest_filters_first, order_count, shrinking_first
from .pipeline import Step, lower


def affine(sizes: Sequence[float], seconds: Sequence[float]) -> tuple[float, float]:
    """(slope, base) by least squares, neither below 0; with fewer than three different sizes the mean is the base."""
    x, y = np.asarray(sizes, float), np.asarray(seconds, float)
    if len(np.unique(x)) < 3:
        return 0.0, float(y.mean()) if len(y) else 0.0
    slope, base = np.polyfit(x, y, 1)
    if slope < 0:
        return 0.0, float(y.mean())
    if base < 0:
        return float((x * y).sum() / (x * x).sum()), 0.0
    return float(slope), float(base)


def sampled(df: DataFrame, steps: Sequence[Step], text: str = "text", rows: int = 200, longest: int = 20_000) -> list[Cost]:
    """Costs of steps that run on one text at a time: timed here, on the first `rows` texts that Spark finds of at most `longest` characters.

    Mappers see what the mappers before them made. Only the order of the steps depends on this, and no result. Native steps without such a
    form have the cost of their prior.
    """
    texts = [r[0] for r in df.select(text).filter(F.length(text).between(1, longest)).limit(rows).collect()]
    docs, out = [Doc(t) for t in texts], []
    size = sum(len(t) for t in texts) / max(1, len(texts))
    for s in steps:
        one, args = s.operator.one, dict(s.args)
        if one is None or not docs or getattr(args.get("model"), "tail", None) is not None:
            out.append(Cost(s.operator.speed * 1e-9))
            continue
        best, values = float("inf"), []
        for _ in range(2):
            for d in docs:  # what statistics share is paid by each of them here
                d.__init__(d.text)
            began = time.perf_counter()
            values = [one(d.text if s.operator.kind == "map" else d, **args) for d in docs]
            best = min(best, time.perf_counter() - began)
        if s.operator.kind == "map":
            docs = [Doc(t) for t in values]
            out.append(Cost(best / len(docs) / max(1.0, size)))
        else:
            keep = s.within(np.array(values, float))
            out.append(Cost(best / len(docs) / max(1.0, size), 0.0, 1.0 if keep is None else float((keep.sum() + 0.5) / (len(docs) + 1))))
    return out


@dataclass(frozen=True)
class PlanOptions:
    """What a planner may do. What it can't decide here (workers, prefetching, backends) is Spark's.

    reorder: move steps at all. policy: cheapest (dynamic programming by cost), fastest (fastest filters first) or shrinking. samples: rows of
    the profile. cache: look for a point after which rows are worth keeping for `passes` passes, read at so many seconds a byte. most_orders:
    beyond so many legal orders, the fastest-first order is taken instead of a search.
    """

    reorder: bool = True
    policy: str = "cheapest"
    samples: int = 200
    cache: bool = False
    passes: int = 2
    read_seconds_a_byte: float = 1e-9
    most_orders: int = 10**15


def plan(df: DataFrame, steps: Sequence[Step], options: PlanOptions = PlanOptions(), text: str = "text") -> tuple[list[Step], int | None]:
    """The steps in the order of the options, and after how many of them to keep the rows (None: nowhere)."""
    steps = list(steps)
    costs = sampled(df, steps, text, options.samples)
    size = 1000.0
    if not options.reorder:
        best = list(range(len(steps)))
    elif options.policy == "shrinking":
        best = shrinking_first(steps, {s.tag: c.keeps * c.grows for s, c in zip(steps, costs)})
    elif options.policy == "fastest" or order_count(steps) > options.most_orders:
        best = fastest_filters_first(steps, {s.tag: c.slope * size + c.base for s, c in zip(steps, costs)})
    elif options.policy == "cheapest":
        best = cheapest(steps, costs, size)
    else:
        raise ValueError(f"cheapest, fastest or shrinking, not {options.policy!r}")
    at = cache_point(best, steps, costs, size, options.read_seconds_a_byte, options.passes) if options.cache else None
    return [steps[i] for i in best], at


def planned(df: DataFrame, steps: Sequence[Step], text: str = "text") -> list[Step]:
    """The steps in the legal order that costs least by a sample."""
    return plan(df, steps, text=text)[0]


def measured(df: DataFrame, steps: Sequence[Step], text: str = "text", rows: int = 2000, parts: int = 3) -> list[Cost]:
    """Costs of the steps on a sample of `rows` rows, chosen by a hash of the text and sorted into `parts` sets by length.

    Each step runs alone on what the mappers before it made. A set's time without the step is taken off.
    """
    sample = df.select(text).filter(F.col(text).isNotNull()).orderBy(F.xxhash64(text)).limit(rows).orderBy(F.length(text))
    texts = [r[0] for r in sample.collect()]  # bounded by `rows`
    spark = df.sparkSession
    sets = [s.tolist() for s in np.array_split(np.array(texts, dtype=object), parts) if len(s)]
    out = []
    for i, step in enumerate(steps):
        sizes, seconds, kept, seen, grows = [], [], 0, 0, []
        for some in sets:
            frame = spark.createDataFrame([(t,) for t in some], f"{text} string").coalesce(1)
            base = lower(frame, [s for s in steps[:i] if s.operator.kind == "map"], text).persist()
            n, size = base.agg(F.count("*"), F.avg(F.octet_length(text))).first()
            best = []
            for run in (lambda: boundary(base, "__x", F.length(text)), lambda: lower(base, [step], text, annotate=step.operator.kind == "filter")):
                took = []
                for _ in range(2):
                    began = time.perf_counter()
                    run().write.format("noop").mode("overwrite").save()
                    took.append(time.perf_counter() - began)
                best.append(min(took))
            sizes.append(size or 0.0)
            seconds.append(max(0.0, best[1] - best[0]) / max(1, n))
            if step.operator.kind == "filter":
                seen, kept = seen + n, kept + lower(base, [step], text).count()
            else:
                after = lower(base, [step], text).agg(F.avg(F.octet_length(text))).first()[0]
                grows.append((after or 0.0) / size if size else 1.0)
            base.unpersist()
        slope, base_s = affine(sizes, seconds)
        out.append(Cost(slope, base_s, kept / seen if seen else 1.0, float(np.mean(grows)) if grows else 1.0))
    return out


def thresholds(df: DataFrame, column: str, retention: Sequence[float], upper: bool) -> DataFrame:
    """(retention, threshold): the bound of a statistic that keeps a share of the rows, by linear interpolation."""
    cut = [F.struct(F.lit(float(r)).alias("retention"), F.percentile(column, F.lit(float(r if upper else 1 - r))).alias("threshold")) for r in retention]
    return df.agg(F.array(*cut).alias("x")).select(F.explode("x").alias("x")).select("x.*")
