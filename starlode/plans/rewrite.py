"""Rewrites that Catalyst doesn't do: eager aggregation, and whether a roll-up may answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.index import Rollup
from .interval import NAMED, Interval
from .model import ModelError


def eager_agg(fact: DataFrame, one_row: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], outer: Sequence[Column] = ()) -> DataFrame:
    """``fact`` beside the row of ``one_row``, grouped by ``keys``: the groups are formed before the
    join, which then carries one row a group. ``one_row`` must have one row at most by its plan, as a
    global aggregate has: with more the result would differ, so ``ModelError`` is raised.
    ``outer``: more columns, of either side. Aggregates read ``fact`` alone."""
    most = one_row._jdf.queryExecution().optimizedPlan().maxRows()
    if not most.isDefined() or int(most.get()) > 1:
        raise ModelError("the other side of an eager aggregation must have one row at most")
    grouped = fact.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return grouped.crossJoin(F.broadcast(one_row)).select(*keys, *aggs, *outer)


GRAINS = [*NAMED, "week", "month", "quarter", "year"]


def grain_divides(fine: str, coarse: str | None) -> bool:
    """Whether whole buckets of ``fine`` make up a bucket of ``coarse`` (None: all)."""
    if coarse in (None, "all") or fine == coarse:
        return True
    if fine not in GRAINS or coarse not in GRAINS:
        return False
    if fine in NAMED and coarse in NAMED:
        return NAMED[coarse] % NAMED[fine] == 0
    if fine in NAMED:
        return True  # days end where weeks, months, quarters and years do
    return (fine, coarse) in {("month", "quarter"), ("month", "year"), ("quarter", "year")}


def interval_aligned(r: Rollup, interval: Interval | None) -> bool:
    """Whether no bucket of the roll-up lies on an edge of the interval, and it covers it."""
    if interval is None:
        return r.interval is None
    if r.interval is not None and not r.interval.covers(interval):
        return False
    for at in (interval.start, interval.end):
        if at is None:
            continue
        day = (at.hour, at.minute, at.second, at.microsecond) == (0, 0, 0, 0)
        if r.grain in NAMED:
            if (at.hour * 3600 + at.minute * 60 + at.second) % NAMED[r.grain] or at.microsecond:
                return False
        elif not (day and {"week": at.weekday() == 0, "month": at.day == 1, "quarter": at.day == 1 and at.month % 3 == 1, "year": at.day == 1 and at.month == 1}[r.grain]):
            return False
    return True


def whole_buckets(r: Rollup, interval: Interval) -> Interval:
    """The part of an interval that a monthly roll-up's whole months make up; empty for other grains."""
    both = interval if r.interval is None else interval.overlap(r.interval)
    if r.grain != "month" or both.start is None or both.end is None or both.empty:
        return Interval(interval.start, interval.start)
    first = both.start.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    if first < both.start:
        first = (first + timedelta(days=32)).replace(day=1)
    return Interval(first, max(first, both.end.replace(day=1, hour=0, minute=0, second=0, microsecond=0)))


def derive(r: Rollup, kind: str, expr: str | None) -> Column | None:
    """The aggregate from the roll-up's metrics, or None if these don't determine it."""
    if kind == "count" and expr is None:
        return F.coalesce(m.merge(), F.lit(0)).cast("bigint") if (m := r.metric("count")) else None
    if kind in ("sum", "min", "max"):
        if m := r.metric(kind, expr):
            return m.merge()
        return {"min": F.min, "max": F.max}[kind](expr) if kind != "sum" and expr in r.dims else None
    if kind == "avg":
        # a mean needs the number of values that aren't null: a count of rows would do only without nulls
        s, n = r.metric("sum", expr), r.metric("sum", f"cast({expr} is not null as int)")
        return s.merge() / n.merge() if s and n else None
    if kind == "approx_distinct":
        if m := r.metric("hll", expr):
            return F.hll_sketch_estimate(m.merge())
        if m := r.metric("theta", expr):
            return F.theta_sketch_estimate(m.merge())
        return F.approx_count_distinct(expr) if expr in r.dims else None
    if kind == "theta_distinct":
        return F.theta_sketch_estimate(m.merge()) if (m := r.metric("theta", expr)) else None
    if kind == "distinct":
        return F.countDistinct(expr) if expr in r.dims else None
    return None
