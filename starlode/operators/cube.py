"""Cubes: a fact table or star with a time column, answered from the star or from a roll-up."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..plans.elimination import items, kind
from ..plans.interval import Interval, bucket
from ..plans.model import Dependencies, FunctionalDependency, ModelError, Role, StarSchema, infer_roles
from ..plans.native import Compiler, NativeQuery, answers
from ..plans.rewrite import derive, grain_divides, interval_aligned, whole_buckets
from ..sources.index import Metric, Rollup, build_rollup, prune


@dataclass(frozen=True)
class Measure:
    """kind: count, sum, min, max, avg, distinct (exact), approx_distinct, theta_distinct (by a theta sketch). expr: SQL over the cube's
    columns; None counts rows. where: SQL that filters what is aggregated."""

    name: str
    kind: str
    expr: str | None = None
    where: str | None = None

    def column(self) -> Column:
        c = F.expr(self.expr) if self.expr is not None else F.lit(1)
        if self.where is not None:
            c = F.when(F.expr(self.where), c)
        how = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "distinct": F.countDistinct, "approx_distinct": F.approx_count_distinct, "theta_distinct": lambda c: F.theta_sketch_estimate(F.theta_sketch_agg(c))}
        if self.kind not in how:
            raise ModelError(f"unknown measure kind '{self.kind}'")
        return how[self.kind](c)


@dataclass
class Options:
    """Limits and switches; unset limits don't guard."""

    max_result_rows: int | None = None
    use_sketches: bool = True
    non_aggregate: str = "push_none"  # push_none: rows come from the star; push_filters, push_project_and_filters: from an index
    broadcast_bytes: int = 32 << 20
    trust_star: bool = True  # edges between whole tables hold as declared (``Cube.validate`` checks them); else each is checked before a join is left out
    query_granularity: str = "none"
    column_mapping: Mapping[str, str] = field(default_factory=dict)


def _names(sql: str | None, known: Iterable[str]) -> set[str]:
    return {c for c in known if sql and re.search(rf"(?<![\w.]){re.escape(c)}(?!\w)", sql)}


class Cube:
    def __init__(
        self, spark: SparkSession, name: str, tables: Mapping[str, DataFrame], star: StarSchema, time_col: str, *, roles: Mapping[str, Role] | None = None,
        dependencies: Iterable[FunctionalDependency] = (), axes: Mapping[str, Sequence[str]] | None = None, options: Options | None = None,
    ):
        self.spark, self.name, self.tables, self.star, self.time_col = spark, name, dict(tables), star, time_col
        if time_col not in tables[star.fact].columns:
            raise ModelError(f"time column '{time_col}' is not in the source")
        self.options = options or Options()
        self.dependencies, self.axes = Dependencies(dependencies), axes or {}
        self.roles = {}
        for t in star.tables:
            own = infer_roles(tables[t], time_col if t == star.fact else tables[t].columns[0], roles)
            self.roles |= own if t == star.fact else {k: (Role.DIMENSION if v is Role.TIME else v) for k, v in own.items()}
        self.rollups: list[Rollup] = []
        self._intact: dict[str, bool] = {}
        self._sizes: dict[str, int | None] = {}
        self.known: dict = {}  # what was counted, until the cache is cleared

    @staticmethod
    def over(spark: SparkSession, name: str, source: DataFrame, time_col: str, **more) -> Cube:
        """A cube over one flat table."""
        return Cube(spark, name, {name: source}, StarSchema.of(name, (), {name: source}), time_col, **more)

    @property
    def columns(self) -> list[str]:
        return [c for t in self.star.tables for c in self.star.columns[t]]

    # --- rows

    def _small(self, table: str) -> bool:
        """Whether Catalyst's own estimate of a table is within the broadcast limit."""
        if table not in self._sizes:
            stats = self.tables[table]._jdf.queryExecution().optimizedPlan().stats()
            self._sizes[table] = int(str(stats.sizeInBytes()))
        return self._sizes[table] <= self.options.broadcast_bytes

    def _is_whole(self, table: str) -> bool:
        """Whether a table is all of its source: columns may be renamed, rows not left out."""
        plan = self.tables[table]._jdf.queryExecution().optimizedPlan()
        while kind(plan) in ("Project", "SubqueryAlias"):
            plan = plan.child()
        return kind(plan) in ("LogicalRelation", "HiveTableRelation", "DataSourceV2Relation")

    def is_intact(self, edge) -> bool:
        """Whether every row of the edge's left table meets exactly one of its right table. That is what
        declaring an edge between whole tables says; of a right table that is a selection of rows, or
        without ``trust_star``, it is found out once, by a pass over the keys of both."""
        if edge.right not in self._intact:
            self._intact[edge.right] = self.options.trust_star and self._is_whole(edge.right) or self.star.intact(edge, self.tables)
        return self._intact[edge.right]

    def validate(self) -> None:
        """Checks every edge on the data (keys set, known and unique), and remembers it."""
        for e in self.star.ordered():
            self._intact[e.right] = self.star.intact(e, self.tables)
        if broken := [f"{e.left} - {e.right}" for e in self.star.ordered() if not self._intact[e.right]]:
            raise ModelError(f"not every row meets exactly one along {', '.join(broken)}")

    def rows(self, columns: Iterable[str] | None = None) -> DataFrame:
        """The star joined as far as ``columns`` need it. Joins that give no column are left out where
        ``is_intact`` says that every row meets exactly one, else kept."""
        columns = self.columns if columns is None else list(columns)
        needed = self.star.needed([*columns, self.time_col])
        edges = [e for e in self.star.ordered() if e in needed or not self.is_intact(e)]
        out = self.tables[self.star.fact]
        for e in edges:
            right = self.tables[e.right]
            out = out.join(F.broadcast(right) if self._small(e.right) else right, [F.col(a) == F.col(b) for a, b in e.keys])
        return out

    def flat(self) -> DataFrame:
        return self.rows(self.columns)

    # --- aggregates

    def add_rollup(self, path: str, grain: str, dims: Sequence[str], measures: Sequence[Measure], interval: Interval | None = None) -> Rollup:
        """Builds and registers a roll-up from which ``measures`` can be derived."""
        metrics: dict[tuple, Metric] = {}

        def add(kind: str, expr: str | None) -> None:
            metrics.setdefault((kind, expr), Metric(f"m{len(metrics)}_{kind}", kind, expr))

        add("count", None)
        for m in measures:
            if m.kind in ("sum", "avg"):
                add("sum", m.expr)
            if m.kind == "avg":
                add("sum", f"cast({m.expr} is not null as int)")
            if m.kind in ("min", "max"):
                add(m.kind, m.expr)
            if m.kind == "approx_distinct":
                add("hll", m.expr)
            if m.kind == "theta_distinct":
                add("theta", m.expr)
        needed = {c for m in measures for c in _names(m.expr, self.columns)} | set(dims)
        r = build_rollup(self.rows(needed), path, self.time_col, grain, dims, list(metrics.values()), interval)
        self.rollups.append(r)
        return r

    def answer_from(self, dims: Sequence[str], measures: Sequence[Measure], where: str | None, interval: Interval | None, grain: str | None) -> Rollup | None:
        """A roll-up that determines the answer: all dimensions and filtered columns are its, buckets
        fit, and each measure can be derived."""
        if where is not None and not self._deterministic(where):
            return None
        for r in self.rollups:
            if set(dims) <= set(r.dims) and _names(where, self.columns) <= set(r.dims) and grain_divides(r.grain, grain) and interval_aligned(r, interval):
                if all(m.where is None and derive(r, m.kind, m.expr) is not None for m in measures):
                    if self.options.use_sketches or all(m.kind not in ("approx_distinct", "theta_distinct") for m in measures):
                        return r
        return None

    def _deterministic(self, where: str) -> bool:
        """Whether a filter says the same of a roll-up's row as of each of its rows, by its analysed form."""
        plan = self.rows(_names(where, self.columns)).where(where)._jdf.queryExecution().analyzed()
        return all(e.deterministic() for e in items(plan.expressions()))

    def query(
        self, dims: Sequence[str] = (), measures: Sequence[Measure] = (), *, where: str | None = None, interval: Interval | None = None, grain: str | None = None, having: str | None = None,
        order: Sequence[str] = (), limit: int | None = None, sets: Sequence[Sequence[str]] | None = None, rollups: bool = True,
    ) -> DataFrame:
        """Groups by ``dims`` (and the time bucket ``grain``, as column ``bucket``). ``sets``: grouping
        sets of dims. ``order``: names, "-" before it for descending. The whole is ordered and
        limited, never its parts."""
        unknown = [d for d in dims if d not in self.columns]
        if unknown:
            raise ModelError(f"unknown dimensions: {', '.join(unknown)}")
        r = self.answer_from(dims, measures, where, interval, grain) if rollups and sets is None and measures else None
        if r is not None:
            rows = r.read(self.spark, interval)
            aggs = [derive(r, m.kind, m.expr).alias(m.name) for m in measures]
        else:
            needed = set(dims) | {c for m in measures for c in _names(m.expr, self.columns) | _names(m.where, self.columns)} | _names(where, self.columns)
            rows = self.rows(needed)
            aggs = [m.column().alias(m.name) for m in measures]
        if interval is not None:
            rows = prune(rows, interval).where(interval.holds(F.col(self.time_col)))
        if where is not None:
            rows = rows.where(where)
        keys: list[Column | str] = list(dims)
        if (b := bucket(F.col(self.time_col), grain)) is not None:
            keys.append(b.alias("bucket"))
        if sets is not None:
            out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*aggs, F.grouping_id().alias("grouping_id"))
        elif measures:
            out = rows.groupBy(*keys).agg(*aggs)
        else:
            out = rows.select(*keys).distinct()
        if having is not None:
            out = out.where(having)
        if order:
            out = out.orderBy(*(F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order))
        if limit is not None:
            out = out.limit(limit)
        return self.guarded(out)

    def query_with_rest(self, dims: Sequence[str], measures: Sequence[Measure], interval: Interval, where: str | None = None) -> DataFrame:
        """``query`` over an interval that a roll-up covers in part: its whole buckets come from there, what is
        before and after from the rows. Counts, sums, minima and maxima, which can be put together."""
        if any(m.kind not in ("count", "sum", "min", "max") for m in measures):
            raise ModelError("only counts, sums, minima and maxima can be put together of parts")
        parts = []
        for r in self.rollups:
            inner = whole_buckets(r, interval)
            if not inner.empty and self.answer_from(dims, measures, where, inner, None) is not None:
                parts = [i for i in (Interval(interval.start, inner.start), inner, Interval(inner.end, interval.end)) if not i.empty]
                break
        found = [self.query(dims, measures, where=where, interval=i) for i in parts or [interval]]
        together = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        every = reduce(DataFrame.unionByName, found).groupBy(*dims)
        return self.guarded(every.agg(*(together[m.kind](m.name).alias(m.name) for m in measures)))

    def guarded(self, out: DataFrame, most: int | None = None) -> DataFrame:
        """``out``, which fails when it runs if it has more than ``most`` (``max_result_rows``) rows."""
        if (most := self.options.max_result_rows if most is None else most) is None:
            return out
        # a limit's rows are in one partition, so these numbers count them
        numbered = out.limit(most + 1).withColumn("__row", F.monotonically_increasing_id())
        fits = F.when(F.col("__row") < most, True).otherwise(F.raise_error(F.lit(f"more than {most} result rows")).cast("boolean"))
        return numbered.where(fits).drop("__row")

    def native(self, query: str | Mapping | NativeQuery) -> DataFrame:
        """A JSON query's result: from the first roll-up that determines it, else from the star."""
        q = query if isinstance(query, NativeQuery) else NativeQuery.parse(query)
        for r in self.rollups:
            if answers(r, q, self.time_col):
                return self.guarded(Compiler(r.read(self.spark), self.time_col, self.axes, r).compile(q))
        text = q.to_json()
        used = [c for c in self.columns if f'"{c}"' in text or re.search(rf"\b{re.escape(c)}\b", text)]
        whole = q.kind in ("segmentMetadata", "select") and not (q.dimensions or q.metrics) or q.kind == "search" and not q.search_dimensions
        used += [a for p, axes in self.axes.items() if p in text for a in axes]
        return self.guarded(Compiler(self.rows(None if whole else used), self.time_col, self.axes).compile(q))

    def pages(self, query: str | Mapping | NativeQuery) -> Iterable[DataFrame]:
        """The pages of a select query, until one is empty. Each begins at the last row of the one before
        (a filter, not an offset that grows) and skips the rows equal to it that were given already."""
        spec = json.loads((query if isinstance(query, NativeQuery) else NativeQuery.parse(query)).to_json())
        while page := (df := self.native(spec)).collect():
            yield self.spark.createDataFrame(page, df.schema)
            last = page[-1]
            same = next((i for i, row in enumerate(reversed(page)) if row != last), len(page))
            after = {k: v if v is None or isinstance(v, (bool, int, float, str)) else str(v) for k, v in last.asDict().items()}
            if same == len(page) and spec["pagingSpec"].get("after") == after:
                same += spec["pagingSpec"]["skip"]
            spec["pagingSpec"] = spec["pagingSpec"] | {"pagingIdentifiers": {}, "after": after, "skip": same}

    # --- facts about it

    def distinct_counts(self, columns: Iterable[str]) -> dict[str, int]:
        """Estimated numbers of values, counted once where each column lies: no join."""
        columns = list(columns)
        for t in {self.star.owner(c) for c in columns if c not in self.known}:
            own = [c for c in columns if c not in self.known and self.star.owner(c) == t]
            self.known |= self.tables[t].agg(*(F.approx_count_distinct(c).alias(c) for c in own)).first().asDict()
        return {c: self.known[c] for c in columns}

    def extent(self) -> Row:
        """n rows, their first and last time a and b, and m months of the fact, counted once."""
        if "extent" not in self.known:
            t = F.col(self.time_col)
            self.known["extent"] = self.tables[self.star.fact].agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"), F.countDistinct(F.date_trunc("month", t)).alias("m")).first()
        return self.known["extent"]

    def estimate_cardinality(self, dims: Sequence[str], distinct: Mapping[str, int] | None = None) -> int:
        return self.dependencies.estimate(dims, distinct or self.distinct_counts(dims))
