"""An engine around a Spark session: cubes by name, commands, metadata views, history, plug-ins."""

from __future__ import annotations

import json
import re
import socket
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.script import Unsupported
from .operators.cube import Cube, Measure
from .plans import cost, metrics
from .plans.elimination import Edges, eliminate, grouped, sources
from .plans.interval import Interval
from .plans.model import FunctionalDependency, ModelError, StarSchema
from .plans.native import NativeQuery
from .sources import index

HISTORY = 500
QUERIES = "started timestamp_ntz, kind string, query string, planning_ms double, run_ms double, n_rows long"
CLEAR = re.compile(r"\s*clear\s+(?:\w+\s+)?cache(?:\s+(\S+))?\s*;?\s*$", re.I)
EXECUTE = re.compile(r"\s*on\s+(?:cube|\w*datasource)\s+(\S+)\s+(?:using\s+\w+\s+)?execute\s+(?:query\s+)?(\{.*\})\s*;?\s*$", re.I | re.S)
CREATE = re.compile(r"\s*create\s+cube\s+(\S+)\s+on\s+(\S+)\s+options\s+(\{.*\})\s*;?\s*$", re.I | re.S)
ROLLUP = re.compile(r"\s*create\s+rollup\s+on\s+cube\s+(\S+)\s+at\s+'([^']+)'\s+options\s+(\{.*\})\s*;?\s*$", re.I | re.S)
INDEX = re.compile(r"\s*create\s+index\s+on\s+cube\s+(\S+)\s+at\s+'([^']+)'\s*;?\s*$", re.I)
INSERT = re.compile(r"\s*insert\s+overwrite\s+index\s+on\s+cube\s+(\S+)\s+(select\b.*)$", re.I | re.S)
REFRESH = re.compile(r"\s*refresh\s+cubes?(?:\s+(\S+?))?\s*;?\s*$", re.I)
DROP = re.compile(r"\s*drop\s+(cube|index\s+on\s+cube)\s+(\S+?)\s*;?\s*$", re.I)
EXPLAIN = re.compile(r"\s*explain\s+(?:\w+\s+)?rewrite\s+(.+)$", re.I | re.S)


class Plugin(Protocol):
    """Hooks; each may be left out."""

    def functions(self, spark: SparkSession) -> None: ...
    def rewrites(self, text: str) -> str: ...
    def commands(self, engine: Engine, text: str) -> DataFrame | None: ...


class Engine:
    def __init__(self, spark: SparkSession, plugins: Iterable[Plugin] = ()):
        self.spark, self.cubes, self.plugins = spark, {}, list(plugins)
        self.history: deque[tuple] = deque(maxlen=HISTORY)
        self.roots: dict[str, str] = {}
        self.edges: dict[str, Edges] = {}
        self.versions: dict[str, frozenset] = {}
        self.server = None
        self.tag: str | None = None
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        dates.register(spark)
        for p in self.plugins:
            if hasattr(p, "functions"):
                p.functions(spark)
        self._view("cube_metrics", [], metrics.METRICS)
        self._views()

    # --- cubes

    def add(self, cube: Cube) -> Cube:
        """Registers a cube, and its flat view under the last part of its name. Two databases' cubes of
        one name can't share a view, so the second is refused."""
        name, view = self.qualified(cube.name), cube.name.split(".")[-1]
        if any(q != name and q.split(".")[-1] == view for q in self.cubes):
            raise ModelError(f"another cube has the view '{view}'")
        self.cubes[name], self.edges[name] = cube, Edges(cube)
        self.versions[name] = self._version(cube)
        cube.flat().createOrReplaceTempView(view)
        self._views()
        return cube

    def drop(self, name: str) -> None:
        """Forgets a cube and its view; its copies and roll-ups stay where they are."""
        q = self.qualified(name)
        self.cube(name)
        del self.cubes[q], self.edges[q], self.versions[q]
        self.roots.pop(q, None)
        self.spark.catalog.dropTempView(q.split(".")[-1])
        self._views()

    def qualified(self, name: str) -> str:
        return name if "." in name else f"{self.spark.catalog.currentDatabase()}.{name}"

    def cube(self, name: str) -> Cube:
        if (q := self.qualified(name)) not in self.cubes:
            raise KeyError(f"no cube '{name}'; known: {', '.join(self.cubes) or 'none'}")
        return self.cubes[q]

    def index(self, name: str, path: str) -> DataFrame:
        """Builds a month-partitioned copy of a cube and remembers it for the segment views."""
        c = self.cube(name)
        df = index.build_index(c.flat(), path, c.time_col)
        self.roots[self.qualified(name)] = path
        self._views()
        return df

    # --- SQL

    def sql(self, text: str) -> DataFrame:
        """Commands first, then plug-ins, then Spark's own SQL, without the star joins that the result
        doesn't need: those of a cube's view and those that the text writes over a cube's tables."""
        began = time.perf_counter()
        if self.tag is not None:  # a tag is of one statement
            self.spark.removeTag(self.tag)
            self.tag = None
        kind, out = self._command(text)
        if out is None:
            for p in self.plugins:
                if hasattr(p, "commands") and (out := p.commands(self, text)) is not None:
                    kind = "plugin"
                    break
        if out is None:
            for p in self.plugins:
                if hasattr(p, "rewrites"):
                    text = p.rewrites(text)
            out = self.accelerated(self.spark.sql(text))
        self._remember(kind, text, began)
        return out

    def accelerated(self, df: DataFrame) -> DataFrame:
        """``df`` without star joins of any cube that give it nothing."""
        return eliminate(df, self.edges.values())

    def run(self, text: str, attempts: int = 1) -> list[Row]:
        """A statement's rows; its running time and how many they are go into the history, what its operators
        did into the view ``cube_metrics``. ``attempts``: how often it may run if Spark's own retries of
        tasks and stages haven't helped."""
        df = self.sql(text)
        rows, seconds = timed(lambda: retried(df.collect, attempts))
        self._view("cube_metrics", metrics.executed(df), metrics.METRICS)
        self.history[-1] = (*self.history[-1][:4], seconds * 1000, len(rows))
        self._view("cube_queries", list(self.history), QUERIES)
        return rows

    def _remember(self, kind: str, text: str, began: float) -> None:
        self.history.append((datetime.now(timezone.utc).replace(tzinfo=None), kind, text.strip(), (time.perf_counter() - began) * 1000, None, None))
        self._view("cube_queries", list(self.history), QUERIES)

    def _command(self, text: str) -> tuple[str, DataFrame | None]:
        if m := CLEAR.match(text):
            self.clear_cache(m[1])
            return "clear", self.spark.createDataFrame([(m[1] or "all",)], "cleared string")
        if m := REFRESH.match(text):
            return "refresh", self.spark.createDataFrame([(q,) for q in self.refresh(m[1])], "cube string")
        if m := EXECUTE.match(text):
            q = NativeQuery.parse(m[2])
            return "native", self._native(self.cube(m[1]), q)
        done = lambda what, name: (what, self.spark.createDataFrame([(name,)], "cube string"))
        if m := CREATE.match(text):
            return done("create", self.add(self._cube_of(m[1], m[2], json.loads(m[3]))).name)
        if m := ROLLUP.match(text):
            o = json.loads(m[3])
            measures = [Measure(x["name"], x["kind"], x.get("expr")) for x in o["measures"]]
            self.cube(m[1]).add_rollup(m[2], o["grain"], o["dimensions"], measures, Interval.parse(o["interval"]) if "interval" in o else None)
            self._views()
            return done("rollup", m[1])
        if m := INDEX.match(text):
            self.index(m[1], m[2])
            return done("index", m[1])
        if m := INSERT.match(text):
            index.insert_overwrite(self.accelerated(self.spark.sql(m[2])), self.roots[self.qualified(m[1])], self.cube(m[1]).time_col)
            self._views()
            return done("insert", m[1])
        if m := DROP.match(text):
            if m[1].lower() == "cube":
                self.drop(m[2])
            else:
                index.drop(self.spark, self.roots.pop(self.qualified(m[2])))
                self._views()
            return done("drop", m[2])
        if m := EXPLAIN.match(text):
            return "explain", self.explain_rewrite(m[1])
        return "sql", None

    def _cube_of(self, name: str, source: str, options: dict) -> Cube:
        """A cube from a statement's options: timeColumn; starSchema (factTable, relations) or none for one
        flat table; functionalDependencies of col1, col2 and type ("n-1" or "1-1"); maxResultRows."""
        spec = options.get("starSchema") or {"factTable": source}
        names = dict.fromkeys([spec["factTable"], *(t for r in spec.get("relations", ()) for t in (r["leftTable"], r["rightTable"]))])
        tables = {t: self.spark.table(t) for t in names}
        known = [FunctionalDependency(d["col1"], d["col2"], d.get("type") == "1-1") for d in options.get("functionalDependencies", ())]
        cube = Cube(self.spark, name, tables, StarSchema.from_json(spec, tables), options["timeColumn"], dependencies=known)
        cube.options.max_result_rows = options.get("maxResultRows")
        return cube

    def _native(self, cube: Cube, q: NativeQuery) -> DataFrame:
        """A native query under its context: ``queryId`` names it for ``cancel`` until the next statement
        of this engine, ``timeout`` (milliseconds from now) cancels it, ``maxResults`` fails it."""
        known = {"queryId", "timeout", "maxResults", "priority", "useCache", "populateCache", "bySegment", "finalize", "chunkPeriod", "skipEmptyBuckets"}
        if unknown := sorted(set(q.context) - known):
            raise ValueError(f"unknown query context: {', '.join(unknown)}")
        if q.context.get("bySegment"):
            raise Unsupported("results by segment can't be given: rows of all partitions are one result")
        timeout = q.context.get("timeout")
        if "queryId" in q.context or timeout:
            self.tag = re.sub(r"\W", "_", str(q.context.get("queryId") or f"native-{uuid.uuid4().hex}"))
            self.spark.addTag(self.tag)
        if "priority" in q.context:  # a pool of the fair scheduler, if the session has one
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"priority-{q.context['priority']}")
        if timeout:
            timer = threading.Timer(float(timeout) / 1000, self.spark.interruptTag, [self.tag])
            timer.daemon = True
            timer.start()
        out = cube.native(q)
        return out if q.context.get("maxResults") is None else cube.guarded(out, int(q.context["maxResults"]))

    def cancel(self, query_id: str) -> None:
        self.spark.interruptTag(re.sub(r"\W", "_", query_id))

    def clear_cache(self, name: str | None = None) -> None:
        """Forgets what is known of a cube's tables (or of all), and cached files of its views."""
        for q, c in self.cubes.items():
            if name in (None, q, q.split(".")[-1]):
                c._intact.clear()
                c._sizes.clear()
                c.known.clear()
        if name is None:
            self.spark.catalog.clearCache()
        elif self.spark.catalog.tableExists(name):
            self.spark.catalog.refreshTable(name)

    @staticmethod
    def _version(cube: Cube) -> frozenset:
        return frozenset().union(*map(metrics.version, cube.tables.values()))

    def refresh(self, name: str | None = None) -> list[str]:
        """The cubes (or that one, if it is) whose tables' files changed since they were added or refreshed.
        Their tables are listed again, what was counted of them is forgotten, and roll-ups no longer answer,
        as they hold what was there before; ``add_rollup`` builds new ones."""
        changed = []
        for q in [self.qualified(name)] if name else list(self.cubes):
            cube = self.cube(q)
            if (now := self._version(cube)) == self.versions[q]:
                continue
            self.versions[q] = now
            for t in cube.tables.values():
                metrics.refresh(t)
            cube.rollups.clear()
            self.clear_cache(q)
            changed.append(q)
        if changed:
            self._views()
        return changed

    def watch(self, seconds: float) -> Callable[[], None]:
        """Refreshes all cubes every ``seconds`` in a thread of its own; the result ends that."""
        end = threading.Event()

        def look() -> None:
            while not end.wait(seconds):
                self.refresh()

        threading.Thread(target=look, daemon=True, name="starlode-watch").start()
        return end.set

    # --- server

    def serve(self):
        """Spark's Thrift server over this session: JDBC and ODBC clients see the cubes' views and the metadata
        views. The session needs the Hive catalog, ``spark.sql.hive.thriftServer.singleSession``, without
        which clients don't see temporary views, and ``spark.hadoop.hive.server2.thrift.port``; all three
        are read when it starts. Commands and the leaving out of joins are of ``Engine.sql`` only."""
        conf, jvm = self.spark.sparkContext.getConf(), self.spark._jvm
        host, port = conf.get("spark.hadoop.hive.server2.thrift.bind.host", "127.0.0.1"), conf.get("spark.hadoop.hive.server2.thrift.port")
        if conf.get("spark.sql.catalogImplementation") != "hive" or conf.get("spark.sql.hive.thriftServer.singleSession") != "true" or not port:
            raise ValueError("the server needs spark.sql.catalogImplementation=hive, spark.sql.hive.thriftServer.singleSession=true and spark.hadoop.hive.server2.thrift.port")
        self.server = jvm.org.apache.spark.sql.hive.thriftserver.HiveThriftServer2.startWithContext(self.spark._jsparkSession.sqlContext())
        end = time.monotonic() + 30
        while True:  # it begins to listen in a thread of its own
            try:
                socket.create_connection((host, int(port)), 1).close()
                return self.server
            except OSError:
                if time.monotonic() > end:
                    raise
                time.sleep(0.1)

    def explain_rewrite(self, text: str) -> DataFrame:
        """plan: Spark's formatted plan; then, for each cube the text names, the cost of each way."""
        df = self.accelerated(self.spark.sql(text))
        q = df._jdf.queryExecution()
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        rows = [("plan", None, None, None, q.explainString(mode))]
        plan = q.optimizedPlan()
        names = grouped(plan) or []
        for name, c in self.cubes.items():
            if not sources(plan) & sources(c.tables[c.star.fact]._jdf.queryExecution().optimizedPlan()):
                continue
            dims = [d for d in c.columns if d in names]
            edge = c.extent()
            groups = c.estimate_cardinality(dims) if dims else 1
            span = (edge["b"] - edge["a"]).total_seconds() * 1000 if edge["n"] else 0
            threads = self.spark.sparkContext.defaultParallelism
            for p in cost.plans(edge["n"], groups, span, span, max(1, edge["m"]), threads, "groupBy" if dims else "timeseries"):
                rows.append(("cost", name, p.way, float(p.cost), f"{p.segments_per_query} segments a query"))
        return self.spark.createDataFrame(rows, "kind string, cube string, way string, cost double, detail string")

    # --- views

    def _view(self, name: str, rows: list, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).createOrReplaceTempView(name)

    def _views(self) -> None:
        relations = [(q, c.star.fact, c.time_col, json.dumps([[e.left, e.right] for e in c.star.edges]), len(c.rollups), c.options.max_result_rows) for q, c in self.cubes.items()]
        self._view("cube_relations", relations, "name string, fact string, time_column string, edges string, rollups int, max_result_rows int")
        sc = self.spark.sparkContext
        executors = [(f"{x.host()}:{x.port()}", self.spark.version, sc.defaultParallelism, x.numRunningTasks(), x.cacheSize()) for x in sc._jsc.sc().statusTracker().getExecutorInfos()]
        self._view("cube_servers", executors, "server string, version string, threads int, running_tasks int, cached_bytes long")
        self._view("cube_queries", list(self.history), QUERIES)
        parts = None
        for q, path in self.roots.items():
            own = index.segments(self.spark.read.parquet(path), self.cubes[q].time_col).select(F.lit(q).alias("cube"), "*")
            parts = own if parts is None else parts.unionByName(own)
        if parts is None:
            parts = self.spark.createDataFrame([], "cube string, seg string, n_rows long, first_time timestamp_ntz, last_time timestamp_ntz, n_files long")
        parts.createOrReplaceTempView("cube_segments")
        parts.select("cube", "seg", F.lit(self.spark.sparkContext.master).alias("server")).createOrReplaceTempView("cube_assignments")


def pages(df: DataFrame, order: list[str], size: int) -> Iterable[list]:
    """``df`` in pages of ``size`` rows, fetched partition by partition. ``order`` makes them stable."""
    page: list = []
    for row in df.orderBy(*order).toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def retried(action: Callable[[], object], attempts: int, first: float = 0.5, most: float = 30.0, wait: Callable[[float], object] = time.sleep) -> object:
    """What an action returns, tried up to ``attempts`` times, after waits that double from ``first`` to ``most``
    seconds. Only failures of its execution are tried again: a query that can't be analysed, raises
    by itself or was cancelled fails at once."""
    for k in range(attempts - 1):
        try:
            return action()
        except Exception as e:
            if not transient(e):
                raise
            wait(min(most, first * 2**k))
    return action()


def transient(e: Exception) -> bool:
    """Whether a failure may be one of machines: lost executors, fetch failures, connections."""
    return isinstance(e, (ConnectionError, TimeoutError)) or any(x in str(e) for x in ("ExecutorLostFailure", "FetchFailed", "Connection reset", "Connection refused", "SocketTimeoutException"))


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """What an action returns, and its seconds."""
    began = time.perf_counter()
    return action(), time.perf_counter() - began
