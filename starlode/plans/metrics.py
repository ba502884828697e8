"""What a query's execution did, from Spark's own SQL metrics; it needs no listener."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .elimination import items, kind

METRICS = "node int, operator string, metric string, value long"


def executed(df: DataFrame) -> list[tuple[int, str, str, int]]:
    """(node, operator, metric, value) of each operator of a plan that has run, as adaptive execution left
    it, above before below; metrics that are 0 are left out. Times are in Spark's units (ms or ns)."""
    out: list[tuple[int, str, str, int]] = []
    number = 0

    def visit(plan) -> None:
        nonlocal number
        own = number
        number += 1
        found = plan.metrics().iterator()
        while found.hasNext():
            m = found.next()
            if (value := m._2().value()) > 0:
                out.append((own, plan.nodeName().strip(), m._1(), int(value)))
        how = kind(plan)
        if how == "AdaptiveSparkPlanExec":
            visit(plan.executedPlan())
        elif how.endswith("QueryStageExec"):
            visit(plan.plan())
        else:
            for child in items(plan.children()):
                visit(child)

    visit(df._jdf.queryExecution().executedPlan())
    return out


def files(df: DataFrame):
    """The file indexes that a DataFrame reads."""

    def visit(plan):
        if kind(plan) == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation":
            yield plan.relation().location()
        for child in items(plan.children()):
            yield from visit(child)

    return list(visit(df._jdf.queryExecution().analyzed()))


def version(df: DataFrame) -> frozenset[tuple[str, int, int]]:
    """(path, time of change, length) of what lies directly in the folders that ``df`` reads, and of files it
    reads themselves: one listing a folder, no file is opened. A folder changes with its entries."""
    sc, out = df.sparkSession.sparkContext, set()
    for location in files(df):
        for root in items(location.rootPaths()):
            fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
            if fs.exists(root):
                out |= {(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in (fs.getFileStatus(root), *fs.listStatus(root))}
    return frozenset(out)


def refresh(df: DataFrame) -> None:
    """Makes ``df``, and what is derived from it, list its files again."""
    for location in files(df):
        location.refresh()
