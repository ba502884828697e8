"""Predicates on points whose coordinates are plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """A rectangle, bounds included; None: unbounded on that side of an axis."""

    low: tuple[float | None, ...]
    high: tuple[float | None, ...]

    def meet(self, other: Box) -> Box:
        pick = lambda f, a, b: tuple(f(x for x in p if x is not None) if any(x is not None for x in p) else None for p in zip(a, b))
        return Box(pick(max, self.low, other.low), pick(min, self.high, other.high))

    def holds(self, axes: Sequence[str | Column]) -> Column:
        cols = [F.col(a) if isinstance(a, str) else a for a in axes]
        tests = [c >= lo for c, lo in zip(cols, self.low) if lo is not None] + [c <= hi for c, hi in zip(cols, self.high) if hi is not None]
        return reduce(Column.__and__, tests, F.lit(True))


def coordinate(point: str | Column, i: int) -> Column:
    """One coordinate of a "lat,long" text."""
    return F.try_element_at(F.split(point, ","), F.lit(i + 1)).try_cast("double")
