"""Plans that can be saved, shown and run again."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..operators.rows import cached
from .order import Cost, cache_point, cheapest, legal
from .pipeline import Step, lower


@dataclass(frozen=True)
class PlanSpec:
    """tags in the order in which they run; how many of them run before the cache (None: no cache); partitions to deal rows to (None: as read)."""

    tags: tuple[str, ...]
    cache_after: int | None = None
    partitions: int | None = None

    def save(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def load(text: str) -> PlanSpec:
        x = json.loads(text)
        return PlanSpec(tuple(x["tags"]), x["cache_after"], x["partitions"])

    def show(self) -> str:
        """The chain as text, fused stretches in brackets."""
        return " -> ".join(t + (" [cache]" if i + 1 == self.cache_after else "") for i, t in enumerate(self.tags))


def planned(steps: Sequence[Step], costs: Sequence[Cost], size: float = 1000.0, passes: int = 1, read_seconds_a_byte: float = 1e-8, partitions: int | None = None) -> PlanSpec:
    order = cheapest(steps, costs, size)
    cache = cache_point(order, steps, costs, size, read_seconds_a_byte, passes) if passes > 1 else None
    return PlanSpec(tuple(steps[i].tag for i in order), cache, partitions)


def run(df: DataFrame, steps: Sequence[Step], spec: PlanSpec, text: str = "text") -> DataFrame:
    """df through the steps as the plan says. A plan for other steps, or one that breaks their order, is an error."""
    by_tag = {s.tag: i for i, s in enumerate(steps)}
    order = [by_tag[t] for t in spec.tags]
    if not legal(steps, order):
        raise ValueError("the plan doesn't fit the steps")
    if spec.partitions:
        df = df.repartition(spec.partitions)
    ordered = [steps[i] for i in order]
    if spec.cache_after:
        return lower(cached(lower(df, ordered[: spec.cache_after], text)), ordered[spec.cache_after :], text)
    return lower(df, ordered, text)
