"""JSON queries (groupBy, timeseries, topN, search, select, timeBoundary, segmentMetadata) compiled to
DataFrames. Specifications carry their kind in ``type`` / ``queryType`` or in ``jsonClass``."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import script
from ..functions.extraction import extract
from ..functions.script import Unsupported
from ..functions.spatial import Box
from ..sources.index import Rollup, prune
from .interval import Interval, bucket
from .rewrite import derive, grain_divides, interval_aligned

TIME = "__time"
KINDS = ("groupBy", "timeseries", "topN", "search", "select", "timeBoundary", "segmentMetadata")
_CLASSES = {
    "group": "groupBy", "timeseries": "timeseries", "topn": "topN", "search": "search", "select": "select",
    "selector": "selector", "regexfilter": "regex", "stringcontains": "contains", "notfilter": "not", "extractionfilter": "extraction", "javascriptfilter": "javascript", "bound": "bound", "spatial": "spatial",
    "defaultdimension": "default", "extractiondimension": "extraction", "cardinality": "cardinality", "hyperuniqueaggregation": "hyperUnique", "javascriptaggregation": "javascript", "filteredaggregation": "filtered",
    "fieldaccess": "fieldAccess", "constant": "constant", "arithmetic": "arithmetic", "hyperuniquecardinality": "hyperUniqueCardinality", "numerictopn": "numeric", "lexiographictopn": "lexicographic", "alphanumerictopn": "alphaNumeric", "invertedtopn": "inverted",
    "javascriptextraction": "javascript", "javascriptpostaggregation": "javascript", "regexextraction": "regex", "partialextraction": "partial", "searchqueryextraction": "searchQuery", "timeformatextraction": "timeFormat", "timeparsingextraction": "time", "inextraction": "lookup", "durationgranularity": "duration", "periodgranularity": "period",
}


def typed(spec: Any) -> Any:
    """``spec`` with each object's ``type`` filled in from its ``jsonClass``, throughout."""
    if isinstance(spec, list):
        return [typed(x) for x in spec]
    if not isinstance(spec, dict):
        return spec
    out = {k: typed(v) for k, v in spec.items()}
    if "type" not in out and (name := out.get("jsonClass")):
        low = name.lower()
        if kind := next((v for k, v in sorted(_CLASSES.items(), key=lambda x: -len(x[0])) if low.startswith(k)), None):
            out.setdefault("queryType" if low.split("spec")[0].endswith("query") or kind in KINDS[:5] and "queryType" in spec else "type", kind)
    return out


@dataclass
class NativeQuery:
    kind: str
    dimensions: list = field(default_factory=list)
    granularity: Any = "all"
    filter: dict | None = None
    aggregations: list = field(default_factory=list)
    post_aggregations: list = field(default_factory=list)
    having: dict | None = None
    limit: dict | None = None
    intervals: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    metric: Any = None
    threshold: int | None = None
    metrics: list[str] = field(default_factory=list)
    search_dimensions: list[str] = field(default_factory=list)
    query: dict | None = None
    sort: dict | None = None
    descending: bool = False
    paging: dict | None = None
    context: dict = field(default_factory=dict)
    source: str | None = None
    include: list[str] | None = None

    @staticmethod
    def parse(text: str | Mapping) -> NativeQuery:
        spec = typed(json.loads(text) if isinstance(text, str) else json.loads(json.dumps(text)))
        kind = spec.get("queryType") or spec.get("type")
        if kind not in KINDS:
            raise ValueError(f"unknown query type: {kind!r}")
        dims = spec.get("dimensions") or ([spec["dimension"]] if "dimension" in spec else [])
        intervals, segments = spec.get("intervals") or [], []
        if isinstance(intervals, dict):
            segments = [s if isinstance(s, str) else s["itvl"] for s in intervals.get("segments", ())]
            intervals = []
        return NativeQuery(
            kind, dims, spec.get("granularity", "all"), spec.get("filter"), spec.get("aggregations") or [], spec.get("postAggregations") or [], spec.get("having"), spec.get("limitSpec"),
            [intervals] if isinstance(intervals, str) else list(intervals), segments, spec.get("metric"), spec.get("threshold") or spec.get("limit"), spec.get("metrics") or [],
            spec.get("searchDimensions") or [], spec.get("query"), spec.get("sort"), bool(spec.get("descending")), spec.get("pagingSpec"), spec.get("context") or {}, spec.get("dataSource"),
            spec["toInclude"].get("columns") if (spec.get("toInclude") or {}).get("type") == "list" else None,
        )

    def to_json(self) -> str:
        names = {"dimensions": self.dimensions, "filter": self.filter, "aggregations": self.aggregations, "postAggregations": self.post_aggregations, "having": self.having, "limitSpec": self.limit, "metric": self.metric, "metrics": self.metrics, "searchDimensions": self.search_dimensions, "query": self.query, "sort": self.sort, "pagingSpec": self.paging, "context": self.context, "dataSource": self.source}
        out = {"queryType": self.kind, "granularity": self.granularity, **{k: v for k, v in names.items() if v}}
        if self.kind == "topN" and self.dimensions:
            out["dimension"] = out.pop("dimensions")[0]
        if self.threshold is not None:
            out["limit" if self.kind == "search" else "threshold"] = self.threshold
        if self.descending:
            out["descending"] = True
        if self.include is not None:
            out["toInclude"] = {"type": "list", "columns": self.include}
        out["intervals"] = {"type": "segments", "segments": [{"itvl": s} for s in self.segments]} if self.segments else self.intervals
        return json.dumps(out)


#: ISO periods and the roll-up grains they are.
PERIODS = {"PT1M": "minute", "PT1H": "hour", "P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year"}


def named_grain(granularity: Any) -> str | None:
    """The roll-up grain that a granularity is, None if it is none of them (or has a zone or origin)."""
    if granularity in (None, "all") or isinstance(granularity, str):
        return granularity or "all"
    if granularity.get("type") == "period" and not granularity.get("origin") and granularity.get("timeZone") in (None, "UTC", "Etc/UTC"):
        return PERIODS.get(granularity.get("period"))
    return None


def answers(r: Rollup, q: NativeQuery, time_col: str) -> bool:
    """Whether a roll-up determines a query's answer: plain dimensions and filters are its, buckets and
    intervals fit, aggregations can be derived."""
    if q.kind not in ("groupBy", "timeseries", "topN") or not q.aggregations or (grain := named_grain(q.granularity)) is None:
        return False
    intervals = [Interval.parse(s) for s in [*q.intervals, *q.segments]]
    if not grain_divides(r.grain, grain) or not all(interval_aligned(r, i) for i in intervals or [None]):
        return False

    def columns(spec: Any) -> set[str]:
        if isinstance(spec, list):
            return set().union(*map(columns, spec))
        return ({spec["dimension"]} if "dimension" in spec else set()).union(*map(columns, (v for v in spec.values() if isinstance(v, (list, dict))))) if isinstance(spec, dict) else set()

    used = {d if isinstance(d, str) else d["dimension"] for d in q.dimensions} | columns(q.filter or {})
    return used <= set(r.dims) and all(_derived(r, a) is not None for a in q.aggregations)


def _derived(r: Rollup, spec: Mapping) -> Column | None:
    if spec["type"] == "count":
        return derive(r, "count", None)
    m = re.fullmatch(r"(long|double)(Sum|Min|Max)", spec["type"])
    c = derive(r, m[2].lower(), spec["fieldName"]) if m else None
    return None if c is None else c.cast("bigint" if m[1] == "long" else "double")


def natural(c: Column) -> Column:
    """A sort key for text with numbers in it: runs of digits by value, everything else as it is. Each run
    is written without leading zeros after its length in three digits, so longer numbers come later."""
    parts = F.regexp_extract_all(c.cast("string"), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    key = lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), F.concat(F.lit("0"), F.lpad(F.length(number(x)).cast("string"), 3, "0"), number(x))).otherwise(F.concat(F.lit("1"), x))
    return F.transform(parts, key)


def from_row(df: DataFrame, names: Sequence[str], last: Mapping[str, Any], descending: bool) -> Column:
    """What doesn't come before a page's last row in the order of ``names`` (nulls first, the first name
    descending if asked): a filter, so later pages don't sort what earlier ones gave."""
    out = F.lit(True)
    for name in reversed(names):
        c, v = F.col(f"`{name}`"), F.lit(last[name]).cast(df.schema[name].dataType)
        down = descending and name == names[0]
        if last[name] is None:
            later = F.lit(False) if down else c.isNotNull()
        else:
            later = (c < v) | c.isNull() if down else c > v
        out = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(v) & out)
    return out


class Compiler:
    """Compiles native queries over one flat DataFrame. ``axes``: the columns of each point. ``rollup``: what
    ``df`` is the contents of, if its metrics are to be merged."""

    def __init__(self, df: DataFrame, time_col: str, axes: Mapping[str, Sequence[str]] | None = None, rollup: Rollup | None = None):
        self.df, self.time, self.axes, self.rollup = df, time_col, axes or {}, rollup

    def col(self, name: str) -> Column:
        if name == TIME:
            name = self.time
        if name not in self.df.columns:
            raise ValueError(f"no column '{name}' in the cube")
        return F.col(f"`{name}`")

    def filter(self, spec: Mapping | None) -> Column:
        if spec is None:
            return F.lit(True)
        kind = spec["type"]
        if kind in ("and", "or"):
            parts = [self.filter(x) for x in spec["fields"]]
            return reduce(Column.__and__ if kind == "and" else Column.__or__, parts, F.lit(kind == "and")) if parts else F.lit(True)
        if kind == "not":
            return ~self.filter(spec["field"])
        if kind == "noop":
            return F.lit(True)
        if kind == "spatial":
            b = spec["bound"]
            return Box(tuple(b["minCoords"]), tuple(b["maxCoords"])).holds([self.col(c) for c in self.axes[spec["dimension"]]])
        c = self.col(spec["dimension"])
        if kind == "selector":
            # a missing value asks for null or empty
            return F.coalesce(c.cast("string"), F.lit("")) == "" if spec.get("value") in (None, "") else c.cast("string") == spec["value"]
        if kind == "in":
            return c.cast("string").isin(*spec["values"])
        if kind == "regex":
            return F.rlike(c.cast("string"), F.lit(spec["pattern"]))
        if kind in ("contains", "search"):
            v = spec.get("value") or spec["query"]["value"]
            return F.contains(F.lower(c.cast("string")), F.lit(v.lower()))
        if kind == "extraction":
            return extract(spec["extractionFn"], c).cast("string") == spec["value"]
        if kind == "bound":
            return self._bound(spec, c)
        if kind == "javascript":
            return script.holds(spec["function"], c)
        raise Unsupported(f"filter '{kind}' can't be evaluated here")

    def _bound(self, spec: Mapping, c: Column) -> Column:
        numeric = spec.get("alphaNumeric") or spec.get("ordering") == "numeric"
        value = (lambda v: F.lit(float(v))) if numeric else (lambda v: F.lit(str(v)))
        c, out = c.cast("double" if numeric else "string"), F.lit(True)
        if spec.get("lower") is not None:
            out = out & (c > value(spec["lower"]) if spec.get("lowerStrict") else c >= value(spec["lower"]))
        if spec.get("upper") is not None:
            out = out & (c < value(spec["upper"]) if spec.get("upperStrict") else c <= value(spec["upper"]))
        return out

    def dimension(self, spec: Mapping | str) -> tuple[str, Column]:
        if isinstance(spec, str):
            return spec, self.col(spec)
        name = spec.get("outputName") or spec["dimension"]
        return name, extract(spec.get("extractionFn"), self.col(spec["dimension"]))

    def aggregation(self, spec: Mapping) -> Column:
        kind = spec["type"]
        if kind == "filtered":
            return self._function(spec["aggregator"], self.filter(spec["filter"])).alias(spec["aggregator"].get("name") or spec["name"])
        return self._function(spec, None).alias(spec["name"])

    def _function(self, spec: Mapping, where: Column | None) -> Column:
        kind = spec["type"]
        if self.rollup is not None:
            return _derived(self.rollup, spec)
        only = (lambda c: c) if where is None else (lambda c: F.when(where, c))
        if kind == "count":
            return F.count(only(F.lit(1)))
        if kind in ("cardinality", "hyperUnique"):
            names = spec.get("fieldNames") or [spec["fieldName"]]
            cols = [self.col(n) for n in names]
            return F.approx_count_distinct(only(cols[0] if len(cols) == 1 else F.struct(*cols)))
        if m := re.fullmatch(r"(long|double)(Sum|Min|Max)", kind):
            c = only(self.col(spec["fieldName"]).cast("bigint" if m[1] == "long" else "double"))
            return {"Sum": F.sum, "Min": F.min, "Max": F.max}[m[2]](c)
        if kind == "javascript":
            return script.aggregated(spec, [self.col(n) for n in spec["fieldNames"]], only)
        raise Unsupported(f"aggregation '{kind}' can't be evaluated here")

    def post(self, spec: Mapping) -> Column:
        kind = spec["type"]
        if kind == "fieldAccess":
            return F.col(f"`{spec['fieldName']}`")
        if kind == "constant":
            return F.lit(float(spec["value"]))
        if kind == "hyperUniqueCardinality":
            return F.col(f"`{spec['fieldName']}`").cast("double")
        if kind == "arithmetic":
            first, *rest = [self.post(x).cast("double") for x in spec["fields"]]
            for x in rest:
                first = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))}[spec["fn"]](first, x)
            return first
        if kind == "javascript":
            return script.of_numbers(spec["function"], [F.col(f"`{n}`") for n in spec["fieldNames"]])
        raise Unsupported(f"post-aggregation '{kind}' can't be evaluated here")

    def having(self, spec: Mapping) -> Column:
        kind = spec["type"]
        if kind in ("and", "or"):
            return reduce(Column.__and__ if kind == "and" else Column.__or__, [self.having(x) for x in spec["havingSpecs"]])
        if kind == "not":
            return ~self.having(spec["havingSpec"])
        c = F.col(f"`{spec['aggregation']}`")
        return {"greaterThan": c > spec["value"], "lessThan": c < spec["value"], "equalTo": c == spec["value"]}[kind]

    def rows(self, q: NativeQuery) -> DataFrame:
        out = self.df
        intervals = [Interval.parse(s) for s in [*q.intervals, *q.segments]]
        if intervals:
            starts, ends = [i.start for i in intervals], [i.end for i in intervals]
            out = prune(out, Interval(None if None in starts else min(starts), None if None in ends else max(ends)))
            out = out.where(reduce(Column.__or__, (i.holds(self.col(TIME)) for i in intervals)))
        return out if q.filter is None else out.where(self.filter(q.filter))

    def compile(self, q: NativeQuery) -> DataFrame:
        return getattr(self, f"_{q.kind.lower()}")(q)

    def _grouped(self, q: NativeQuery, dims: Sequence[Mapping | str]) -> DataFrame:
        keys = [c.alias(n) for n, c in map(self.dimension, dims)]
        if (b := bucket(self.col(TIME), q.granularity)) is not None:
            keys.insert(0, b.alias("timestamp"))
        aggregations = [self.aggregation(a) for a in q.aggregations]
        rows = self.rows(q)
        out = rows.groupBy(*keys).agg(*aggregations) if aggregations else rows.select(*keys).distinct()
        for p in q.post_aggregations:
            out = out.withColumn(p["name"], self.post(p))
        return out if q.having is None else out.where(self.having(q.having))

    def _order(self, columns: Sequence[Mapping | str]) -> list[Column]:
        out = []
        for c in columns:
            name, down = (c, False) if isinstance(c, str) else (c["dimension"], c.get("direction", "ascending").lower().startswith("desc"))
            out.append(F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc())
        return out

    def _groupby(self, q: NativeQuery) -> DataFrame:
        out = self._grouped(q, q.dimensions)
        if q.limit:
            if q.limit.get("columns"):
                out = out.orderBy(*self._order(q.limit["columns"]))
            if q.limit.get("limit"):
                out = out.limit(int(q.limit["limit"]))
        return out

    def _timeseries(self, q: NativeQuery) -> DataFrame:
        out = self._grouped(q, ())
        return out.orderBy(F.desc("timestamp") if q.descending else "timestamp") if "timestamp" in out.columns else out

    def _topn(self, q: NativeQuery) -> DataFrame:
        """Exact, unlike an index's. Per time bucket if there is a granularity."""
        name, _ = self.dimension(q.dimensions[0])
        down, metric, column = True, q.metric, None
        while isinstance(metric, Mapping) and metric["type"] == "inverted":
            down, metric = not down, metric["metric"]
        if isinstance(metric, Mapping) and metric["type"] in ("lexicographic", "alphaNumeric"):
            column, down = F.col(f"`{name}`"), not down
            if metric["type"] == "alphaNumeric":
                column = natural(column)
        else:
            column = F.col(f"`{metric if isinstance(metric, str) else metric['metric']}`")
        order = [column.desc() if down else column.asc(), F.col(f"`{name}`").asc()]
        out = self._grouped(q, q.dimensions[:1])
        if "timestamp" not in out.columns:
            return out.orderBy(*order).limit(int(q.threshold))
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(*order))
        return out.withColumn("__rank", rank).where(F.col("__rank") <= int(q.threshold)).drop("__rank")

    def _search(self, q: NativeQuery) -> DataFrame:
        """dimension, value and count of the values that hold the text, whatever its case: one pass,
        which makes a row per row and searched dimension that matches."""
        dims = q.search_dimensions or [f.name for f in self.df.schema if f.dataType.simpleString() == "string"]
        query = q.query or {"type": "insensitive_contains", "value": ""}
        value, kind = str(query["value"]), query.get("type", "insensitive_contains")
        test = (lambda c: F.contains(c, F.lit(value))) if kind == "contains" and query.get("caseSensitive") else (lambda c: F.contains(F.lower(c), F.lit(value.lower())))
        pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), self.col(d).cast("string").alias("value")) for d in dims))
        found = self.rows(q).select(F.explode(F.filter(pairs, lambda p: test(p["value"]))).alias("p"))
        out = found.groupBy("p.dimension", "p.value").agg(F.count("*").alias("count"))
        by = [F.length("value"), "value", "dimension"] if (q.sort or {}).get("type") == "strlen" else ["value", "dimension"]
        return out.orderBy(*by).limit(int(q.threshold)) if q.threshold else out

    def _select(self, q: NativeQuery) -> DataFrame:
        names = [self.dimension(d) for d in q.dimensions] + [(m, self.col(m)) for m in q.metrics]
        if not names:
            names = [(c, F.col(f"`{c}`")) for c in self.df.columns]
        out = self.rows(q).select(self.col(TIME).alias("timestamp"), *(c.alias(n) for n, c in names if n != TIME))
        if q.paging and q.paging.get("threshold"):
            at = max([0, *(int(v) + 1 for v in (q.paging.get("pagingIdentifiers") or {}).values())])
            others = [c for c in out.columns if c != "timestamp"]
            if after := q.paging.get("after"):
                out, at = out.where(from_row(out, ["timestamp", *others], after, q.descending)), int(q.paging.get("skip", 0))
            order = [F.col("timestamp").desc() if q.descending else F.col("timestamp"), *(F.col(f"`{c}`") for c in others)]
            out = out.orderBy(*order).offset(at).limit(int(q.paging["threshold"]))
        return out

    def _timeboundary(self, q: NativeQuery) -> DataFrame:
        return self.rows(q).agg(F.min(self.col(TIME)).alias("minTime"), F.max(self.col(TIME)).alias("maxTime"))

    def _segmentmetadata(self, q: NativeQuery) -> DataFrame:
        """column, type, cardinality (estimated) and nulls of each column (``toInclude``: of those listed), in
        one pass."""
        rows, fields = self.rows(q), [f for f in self.df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
        if q.include is not None:
            fields = [f for f in fields if f.name in q.include]
        parts = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.approx_count_distinct(f"`{f.name}`").alias("cardinality"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls")) for f in fields]
        return rows.agg(F.array(*parts).alias("a")).select(F.inline("a"))
