"""Star joins that SQL text or DataFrames write out, left out where they give no column.

Catalyst keeps an inner join whose other side is asked for nothing, as it can't know that every row
meets exactly one. A cube's star says so. This works on Catalyst's optimised plan, in which columns are
resolved and pruned: names in literals, quoted names and aliases don't matter. A join goes if

* it is an inner equi-join whose pairs are exactly the keys of an edge of a star, by source files and
  source columns, whatever they are called above;
* nothing above needs a column of the edge's right table, and that table is whole: no filter but "key
  is not null", no limit, no aggregate;
* the edge is intact: declared, or checked (``Cube.is_intact``).

Joins further out go first, so a snowflake's branch goes as a whole. What stays is given back to Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

Source = tuple[tuple[str, ...], str]  # files, column
#: Nodes whose output is part of their child's: they need what is above them and their own expressions.
PASSING = ("Filter", "Sort", "GlobalLimit", "LocalLimit", "SubqueryAlias")


def kind(node) -> str:
    return node.getClass().getSimpleName()


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def ids(attributes) -> set[int]:
    return {a.exprId().id() for a in items(attributes)}


def references(expressions: Iterable) -> set[int]:
    return set().union(*(ids(e.references().toSeq()) for e in expressions))


def conjuncts(condition) -> list:
    return [*conjuncts(condition.left()), *conjuncts(condition.right())] if kind(condition) == "And" else [condition]


def grouped(plan) -> list[str] | None:
    """The names of the columns that the topmost aggregate groups by; None if there is none."""
    if kind(plan) == "Aggregate":
        return [a.name() for e in items(plan.groupingExpressions()) for a in items(e.references().toSeq())]
    return next((g for c in items(plan.children()) if (g := grouped(c)) is not None), None)


def sources(plan) -> set[tuple[str, ...]]:
    """The files of all relations that a plan reads."""
    own = {f} if kind(plan) == "LogicalRelation" and (f := files(plan)) is not None else set()
    return own.union(*(sources(c) for c in items(plan.children())))


def joins(plan) -> int:
    return (kind(plan) == "Join") + sum(joins(c) for c in items(plan.children()))


def files(relation) -> tuple[str, ...] | None:
    own = relation.relation()
    return tuple(sorted(p.toString() for p in items(own.location().rootPaths()))) if kind(own) == "HadoopFsRelation" else None


def source(plan, at: int) -> Source | None:
    """The file column that an output column of ``plan`` is, unless something may have made it null."""
    how = kind(plan)
    if how == "LogicalRelation":
        found = next((a for a in items(plan.output()) if a.exprId().id() == at), None)
        return None if found is None or (own := files(plan)) is None else (own, found.name())
    if how in ("Project", "Aggregate"):
        given = items(plan.projectList() if how == "Project" else plan.aggregateExpressions())
        given = next((x for x in given if x.exprId().id() == at), None)
        if given is not None and kind(given) == "Alias":
            given = given.child()
        return source(plan.child(), given.exprId().id()) if given is not None and kind(given) == "AttributeReference" else None
    if how in PASSING:
        return source(plan.child(), at)
    if how == "Join":
        for side, fine in ((plan.left(), ("Inner", "LeftOuter", "LeftSemi", "LeftAnti")), (plan.right(), ("Inner",))):
            if at in ids(side.output()):
                return source(side, at) if plan.joinType().toString() in fine else None
    return None


class Edges:
    """The edges of a cube's star by the sources of their keys."""

    def __init__(self, cube):
        self.cube, self.known, self.keys = cube, {}, set()
        for e in cube.star.edges:
            pairs = frozenset((self._of(e.left, a), self._of(e.right, b)) for a, b in e.keys)
            if all(x is not None for pair in pairs for x in pair):
                self.known.setdefault(pairs, e)
                self.keys |= {x for pair in pairs for x in pair}

    def _of(self, table: str, column: str) -> Source | None:
        plan = self.cube.tables[table]._jdf.queryExecution().optimizedPlan()
        at = next(a.exprId().id() for a in items(plan.output()) if a.name() == column)
        return source(plan, at)

    def is_whole(self, plan) -> bool:
        """Whether ``plan`` has every row of one table."""
        how = kind(plan)
        if how == "Filter":
            for c in conjuncts(plan.condition()):
                if kind(c) != "IsNotNull" or kind(c.child()) != "AttributeReference" or source(plan.child(), c.child().exprId().id()) not in self.keys:
                    return False
        return how == "LogicalRelation" or how in ("Project", "Filter", "SubqueryAlias") and self.is_whole(plan.child())

    def allow(self, near, far, pairs: list[tuple[int, int]]) -> bool:
        """Whether ``far`` may go, joined to ``near`` where these columns of both are equal."""
        found = frozenset((source(near, a), source(far, b)) for a, b in pairs)
        edge = self.known.get(found)
        return edge is not None and self.is_whole(far) and self.cube.is_intact(edge)


def pairs_of(condition, near: set[int], far: set[int]) -> list[tuple[int, int]] | None:
    """The equated columns of both sides, or None if the condition says anything else."""
    out = []
    for c in conjuncts(condition):
        if kind(c) != "EqualTo" or not {kind(c.left()), kind(c.right())} <= {"AttributeReference"}:
            return None
        a, b = c.left().exprId().id(), c.right().exprId().id()
        if a in far and b in near:
            a, b = b, a
        if not (a in near and b in far):
            return None
        out.append((a, b))
    return out


class Elimination:
    def __init__(self, spark: SparkSession, edges: Iterable[Edges]):
        self.jvm, self.edges = spark.sparkContext._jvm, list(edges)

    def with_children(self, plan, children: list):
        old = items(plan.children())
        return plan if all(a is b for a, b in zip(old, children)) else plan.withNewChildren(self.jvm.PythonUtils.toSeq(children))

    def walk(self, plan, needed: set[int]):
        """``plan`` without joins that may go; above it, only ``needed`` columns are used."""
        how, children = kind(plan), items(plan.children())
        if how == "Join" and plan.joinType().toString() == "Inner" and plan.condition().isDefined():
            left, right = children
            condition = plan.condition().get()
            for near, far in ((left, right), (right, left)):
                ours, theirs = ids(near.output()), ids(far.output())
                if needed & theirs or (pairs := pairs_of(condition, ours, theirs)) is None:
                    continue
                rest = self.walk(far, {b for _, b in pairs})
                if any(e.allow(near, rest, pairs) for e in self.edges):
                    return self.walk(near, needed & ours)
        if how == "Project":
            kept = [x for x in items(plan.projectList()) if x.exprId().id() in needed]
            if len(kept) < plan.projectList().size():
                plan = self.jvm.org.apache.spark.sql.catalyst.plans.logical.Project(self.jvm.PythonUtils.toSeq(kept), plan.child())
        if how == "Join":
            used = needed | (references([plan.condition().get()]) if plan.condition().isDefined() else set())
        elif how in ("Project", "Aggregate"):
            used = references(items(plan.expressions()))
        elif how in PASSING:
            used = needed | references(items(plan.expressions()))
        else:
            used = set().union(*(ids(c.output()) for c in children))
        return self.with_children(plan, [self.walk(c, used & ids(c.output())) for c in children])


def eliminate(df: DataFrame, edges: Iterable[Edges]) -> DataFrame:
    """``df`` without star joins that give it nothing; ``df`` itself if there are none."""
    edges, spark = list(edges), df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    n = joins(plan)
    if not n or not edges or "dynamicpruning" in plan.toString():
        return df
    new = Elimination(spark, edges).walk(plan, ids(plan.output()))
    if joins(new) == n:
        return df
    return DataFrame(spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, new), spark)
