"""The semantic model: column roles, functional dependencies, star schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ModelError(ValueError):
    """A cube or star schema that can't be used as declared."""


class Role(Enum):
    TIME = "time"
    DIMENSION = "dimension"
    METRIC = "metric"


@dataclass(frozen=True)
class Column:
    """A source column and what an index may hold for it."""

    name: str
    role: Role
    hll: str | None = None  # name of a metric with a HyperLogLog sketch of it
    theta: str | None = None  # the same with a theta sketch
    axis: tuple[str, int] | None = None  # (point, which coordinate)
    cardinality: int | None = None


def infer_roles(df: DataFrame, time_col: str, declared: Mapping[str, Role] | None = None) -> dict[str, Role]:
    """Roles of the top-level columns that can be mapped; declared ones win, then text, dates and
    booleans are dimensions and numbers metrics. Nested and binary columns get none."""
    if time_col not in df.columns:
        raise ModelError(f"time column '{time_col}' is not in the source")
    out = {}
    for f in df.schema:
        if f.name == time_col:
            out[f.name] = Role.TIME
        elif declared and f.name in declared:
            out[f.name] = declared[f.name]
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = Role.METRIC
        elif isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            out[f.name] = Role.DIMENSION
    return out


@dataclass(frozen=True)
class FunctionalDependency:
    """``left`` determines ``right``; ``one_to_one``: and the other way round."""

    left: str
    right: str
    one_to_one: bool = False


class Dependencies:
    """The transitive closure of functional dependencies."""

    def __init__(self, given: Iterable[FunctionalDependency] = ()):
        self.given = tuple(given)
        self.of: dict[str, set[str]] = {}
        for d in self.given:
            self.of.setdefault(d.left, set()).add(d.right)
            if d.one_to_one:
                self.of.setdefault(d.right, set()).add(d.left)
        changed = True
        while changed:
            changed = False
            for left, rights in self.of.items():
                more = set().union(*(self.of.get(r, set()) for r in rights)) - {left}
                if not more <= rights:
                    rights |= more
                    changed = True

    def determines(self, left: str, right: str) -> bool:
        return left == right or right in self.of.get(left, set())

    def estimate(self, dims: Iterable[str], distinct: Mapping[str, int]) -> int:
        """How many groups ``dims`` may form: determined ones add nothing to their group's base."""
        left = list(dict.fromkeys(dims))
        bases = [d for d in left if not any(o != d and self.determines(o, d) and not (self.determines(d, o) and left.index(d) < left.index(o)) for o in left)]
        return prod(max(1, distinct[b]) for b in bases)

    def violated(self, df: DataFrame) -> list[FunctionalDependency]:
        """Which of the given dependencies ``df`` breaks."""
        out = []
        for d in self.given:
            ways = [(d.left, d.right), (d.right, d.left)] if d.one_to_one else [(d.left, d.right)]
            if any(not df.groupBy(a).agg(F.countDistinct(b).alias("n")).where("n > 1").isEmpty() for a, b in ways):
                out.append(d)
        return out


@dataclass(frozen=True)
class Edge:
    """An n:1 (or 1:1) equi-join from ``left`` outward to ``right``."""

    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    one_to_one: bool = False


@dataclass(frozen=True)
class StarSchema:
    """A tree of tables around a fact table. ``columns``: each table's column names."""

    fact: str
    edges: tuple[Edge, ...] = ()
    columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(fact: str, edges: Iterable[Edge], tables: Mapping[str, DataFrame]) -> StarSchema:
        star = StarSchema(fact, tuple(edges), {k: tuple(v.columns) for k, v in tables.items()})
        star.validate()
        return star

    @staticmethod
    def from_json(spec: Mapping, tables: Mapping[str, DataFrame]) -> StarSchema:
        """The option format: factTable and relations of leftTable, rightTable, relationType ("n-1"
        or "1-1") and joinCondition (leftAttribute, rightAttribute)."""
        edges = []
        for r in spec.get("relations", ()):
            if (kind := r.get("relationType", "n-1")) not in ("n-1", "1-1"):
                raise ModelError(f"unknown relation type '{kind}'")
            edges.append(Edge(r["leftTable"], r["rightTable"], tuple((c["leftAttribute"], c["rightAttribute"]) for c in r["joinCondition"]), kind == "1-1"))
        return StarSchema.of(spec["factTable"], edges, tables)

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys([self.fact, *(t for e in self.edges for t in (e.left, e.right))]))

    def validate(self) -> None:
        seen: set[frozenset] = set()
        parents: dict[str, Edge] = {}
        for e in self.edges:
            if frozenset((e.left, e.right)) in seen:
                raise ModelError(f"multiple relations between '{e.left}' and '{e.right}'")
            seen.add(frozenset((e.left, e.right)))
            if e.right in parents or e.right == self.fact:
                raise ModelError(f"multiple join paths to table '{e.right}'")
            parents[e.right] = e
        for t in self.tables:
            if t not in self.columns:
                raise ModelError(f"unknown table '{t}'")
            path, at = set(), t
            while at != self.fact:
                if at in path or at not in parents:
                    raise ModelError(f"table '{t}' can't be reached from '{self.fact}'")
                path.add(at)
                at = parents[at].left
        owners: dict[str, list[str]] = {}
        for t in self.tables:
            for c in self.columns[t]:
                owners.setdefault(c, []).append(t)
        for c, ts in owners.items():
            if len(ts) > 1:
                raise ModelError(f"Column {c} is not unique across Star Schema; in tables {ts[-1]}, {ts[0]}")
        for e in self.edges:
            for a, b in e.keys:
                if a not in self.columns[e.left] or b not in self.columns[e.right]:
                    raise ModelError(f"join key {a} = {b} isn't in tables {e.left}, {e.right}")

    def owner(self, column: str) -> str:
        for t in self.tables:
            if column in self.columns[t]:
                return t
        raise ModelError(f"no table of the star has a column '{column}'")

    def path(self, table: str) -> list[Edge]:
        """The edges from the fact to ``table``, in that order."""
        parents, out = {e.right: e for e in self.edges}, []
        while table != self.fact:
            out.append(parents[table])
            table = parents[table].left
        return out[::-1]

    def needed(self, columns: Iterable[str]) -> list[Edge]:
        """The edges that must be joined to have ``columns``."""
        wanted = {e for c in columns for e in self.path(self.owner(c))}
        return [e for e in self.ordered() if e in wanted]

    def ordered(self) -> list[Edge]:
        out, reached, left = [], {self.fact}, list(self.edges)
        while left:
            for e in left:
                if e.left in reached:
                    reached.add(e.right)
                    out.append(e)
                    left.remove(e)
                    break
        return out

    def is_star_join(self, pairs: Iterable[tuple[str, str]]) -> bool:
        """Whether equated columns are exactly the keys of one edge, in either direction."""
        given = {frozenset(p) for p in pairs}
        return any(given == {frozenset(k) for k in e.keys} for e in self.edges)

    def intact(self, edge: Edge, tables: Mapping[str, DataFrame]) -> bool:
        """Whether every left row meets exactly one right row: keys are set, known and unique. Only
        then may the join be left out where nothing of the right side is asked for."""
        left, right = tables[edge.left], tables[edge.right]
        keys = [b for _, b in edge.keys]
        if not right.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return False
        on = [left[a] == right[b] for a, b in edge.keys]
        return left.select(*(a for a, _ in edge.keys)).join(right.select(*keys), on, "left_anti").isEmpty()
