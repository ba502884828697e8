"""Star validation, dependencies, intervals, costs and native queries, without or with few rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from starlode.functions.script import Unsupported
from starlode.functions.spatial import Box, coordinate
from starlode.operators.cube import Cube, Measure, Options
from starlode.plans import cost
from starlode.plans.interval import Interval, Period, bucket, buckets, instant
from starlode.plans.model import Dependencies, Edge, FunctionalDependency, ModelError, StarSchema, infer_roles
from starlode.plans.native import Compiler, NativeQuery
from starlode.plans.rewrite import eager_agg, grain_divides
from starlode.queries import star


def schema(edges, **columns):
    s = StarSchema("f", tuple(Edge(a, b, ((x, y),)) for a, b, x, y in edges), {k: tuple(v) for k, v in columns.items()})
    s.validate()
    return s


def test_star_is_a_tree_with_unique_columns():
    good = schema([("f", "a", "ak", "a_key"), ("a", "b", "bk", "b_key")], f=["ak", "x"], a=["a_key", "bk"], b=["b_key", "y"])
    assert [e.right for e in good.needed(["y"])] == ["a", "b"]
    assert [e.right for e in good.needed(["bk"])] == ["a"]
    assert good.is_star_join([("a_key", "ak")]) and not good.is_star_join([("ak", "b_key")])
    with pytest.raises(ModelError, match="multiple join paths to table 'b'"):
        schema([("f", "a", "ak", "a_key"), ("a", "b", "bk", "b_key"), ("f", "b", "x", "b_key")], f=["ak", "x"], a=["a_key", "bk"], b=["b_key"])
    with pytest.raises(ModelError, match="Column x is not unique across Star Schema; in tables a, f"):
        schema([("f", "a", "ak", "a_key")], f=["ak", "x"], a=["a_key", "x"])
    with pytest.raises(ModelError, match="can't be reached"):
        schema([("a", "b", "bk", "b_key")], f=["x"], a=["bk"], b=["b_key"])
    with pytest.raises(ModelError, match="multiple relations"):
        schema([("f", "a", "ak", "a_key"), ("a", "f", "a_key", "ak")], f=["ak"], a=["a_key"])


def test_dependencies_close_transitively():
    d = Dependencies([FunctionalDependency("name", "nation"), FunctionalDependency("nation", "region"), FunctionalDependency("name", "phone", True)])
    assert d.determines("name", "region") and d.determines("phone", "region") and not d.determines("region", "name")
    n = {"name": 100, "nation": 10, "region": 5, "phone": 100, "flag": 3}
    assert d.estimate(["nation", "region"], n) == 10
    assert d.estimate(["name", "phone", "region", "flag"], n) == 300
    assert d.estimate([], n) == 1


def test_dependencies_are_checked(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "x string, y int")
    assert len(Dependencies([FunctionalDependency("x", "y")]).violated(df)) == 1
    assert not Dependencies([FunctionalDependency("x", "y")]).violated(df.where("y = 1"))


def test_intervals():
    a = Interval.parse("1996-01-01T00:00:00.000Z/1997-01-01")
    b = a.narrowed(">", datetime(1996, 6, 1)).narrowed("<=", datetime(1996, 7, 1))
    assert (b.start, b.end) == (datetime(1996, 6, 1, 0, 0, 0, 1000), datetime(1996, 7, 1, 0, 0, 0, 1000))
    assert a.covers(b) and not b.covers(a) and a.months() == ("1996-01", "1996-12")
    assert a.overlap(Interval.parse("1998-01-01/1999-01-01")).empty
    assert Interval.parse("1996-01-01/P2D").end == datetime(1996, 1, 3)
    assert instant("1996-01-01T02:00:00+02:00") == datetime(1996, 1, 1)
    assert Period.parse("P1Y2M").months == 2
    with pytest.raises(ValueError):
        Period.parse("1D")
    assert buckets("all", a) == 1 and buckets("day", a) == 366 and buckets({"type": "period", "period": "P1M"}, a) == 12


def test_buckets_with_zone_and_origin(spark):
    df = spark.sql("select timestamp_ntz'1996-01-01 03:30:00' as t")
    at = lambda g: df.select(bucket(F.col("t"), g)).first()[0]
    assert at({"type": "period", "period": "P1D", "timeZone": "America/New_York"}) == datetime(1995, 12, 31, 5)
    assert at({"type": "period", "period": "P1M"}) == datetime(1996, 1, 1)
    assert at({"type": "duration", "duration": 3600000, "origin": "1970-01-01T00:15:00"}) == datetime(1996, 1, 1, 3, 15)
    assert at("fifteen_minute") == datetime(1996, 1, 1, 3, 30)


def test_costs():
    assert cost.scaled_ratio(1, 1000, 3) == pytest.approx(0.003)
    assert cost.waves(10, 5, 2) == 2 or cost.waves(10, 5, 2) == 1
    p = cost.plans(1_000_000, 100, 50, 100, 24, 8)
    assert p == sorted(p, key=lambda x: x.cost) and {x.way for x in p} == {"merged", "by_segment"}
    assert all(x.way == "by_segment" for x in cost.plans(1000, 10, 1, 1, 4, 2, "select"))
    f = {"type": "and", "fields": [{"type": "selector", "dimension": "d"}, {"type": "not", "field": {"type": "in", "dimension": "d", "values": [1, 2]}}]}
    assert cost.selectivity(f, {"d": 10}) == pytest.approx(0.08)
    assert cost.output_rows(["a", "b"], {"a": 10, "b": 5}, 30, {"a": 1}) == 5


def test_grains():
    assert grain_divides("month", "quarter") and grain_divides("hour", "week") and grain_divides("day", None)
    assert not grain_divides("week", "month") and not grain_divides("month", "day")


def test_native_round_trip_and_errors(spark, sf):
    spec = {"jsonClass": "GroupByQuerySpec", "queryType": "groupBy", "dimensions": [{"jsonClass": "DefaultDimensionSpec", "dimension": "l_returnflag", "outputName": "f"}], "aggregations": [{"jsonClass": "FunctionAggregationSpec", "type": "count", "name": "n"}], "filter": {"jsonClass": "SelectorFilterSpec", "dimension": "l_linestatus", "value": "F"}, "intervals": {"type": "segments", "segments": [{"itvl": "1996-01-01/1997-01-01"}]}}
    q = NativeQuery.parse(json.dumps(spec))
    again = NativeQuery.parse(q.to_json())
    cube = star(spark, sf)
    assert sorted(cube.native(q).collect()) == sorted(cube.native(again).collect())
    assert q.segments == ["1996-01-01/1997-01-01"] and q.filter["type"] == "selector"
    with pytest.raises(ValueError, match="unknown query type"):
        NativeQuery.parse("{}")
    with pytest.raises(Unsupported):
        Compiler(cube.flat(), "l_shipdate").filter({"type": "javascript", "dimension": "l_returnflag", "function": "function(x) { for (;;) { return true } }"})
    with pytest.raises(ValueError, match="no column"):
        Compiler(cube.flat(), "l_shipdate").filter({"type": "selector", "dimension": "nothing", "value": "1"})


def test_null_is_not_empty_in_sql_but_is_in_native_selectors(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "x string").withColumn("t", F.lit(datetime(2000, 1, 1)))
    assert df.where("x is null").count() == 1
    assert df.where(Compiler(df, "t").filter({"type": "selector", "dimension": "x", "value": ""})).count() == 2


def test_rollup_answers_only_what_it_determines(spark, sf, tmp_path):
    cube = star(spark, sf)
    m = [Measure("n", "count"), Measure("a", "avg", "l_quantity"), Measure("d", "distinct", "l_suppkey")]
    cube.add_rollup(str(tmp_path / "r"), "month", ["cn_name"], m[:2])
    year = Interval.parse("1996-01-01/1997-01-01")
    assert cube.answer_from(["cn_name"], m[:2], None, year, "year")
    assert not cube.answer_from(["cn_name"], m, None, year, "year")  # distinct suppliers aren't in it
    assert not cube.answer_from(["cn_name"], m[:2], None, year, "day")
    assert not cube.answer_from(["cn_name"], m[:2], None, Interval.parse("1996-01-02/1997-01-01"), None)
    assert not cube.answer_from(["cn_name"], m[:2], "l_quantity > 3", None, None)
    both = [sorted((r.cn_name, r.n, round(r.a, 6)) for r in cube.query(["cn_name"], m[:2], interval=year, rollups=x).collect()) for x in (True, False)]
    assert both[0] == both[1] and both[0]


def test_joins_go_only_where_keys_are_intact(spark, sf):
    cube = star(spark, sf)
    assert "Join" not in cube.rows(["l_returnflag"])._jdf.queryExecution().optimizedPlan().toString()
    orders = cube.tables["orders"].where("o_orderkey % 2 = 0")
    broken = Cube(spark, "broken", cube.tables | {"orders": orders}, cube.star, "l_shipdate")
    n = broken.query([], [Measure("n", "count")]).first().n
    assert n == cube.tables["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey")).count()


def test_cube_guards_and_sets(spark, sf):
    cube = star(spark, sf)
    cube.options = Options(max_result_rows=2)
    with pytest.raises(Exception, match="more than 2 result rows"):
        cube.query(["l_returnflag"], [Measure("n", "count")]).collect()
    assert len(cube.query(["l_linestatus"], [Measure("n", "count")]).collect()) == 2
    assert cube.query(["l_returnflag"], [Measure("n", "count")], limit=2).count() == 2
    with pytest.raises(ModelError, match="unknown dimensions"):
        cube.query(["nothing"])
    with pytest.raises(ModelError, match="time column"):
        infer_roles(cube.tables["part"], "l_shipdate")


def test_eager_aggregation_equals_the_plain_form(spark, sf):
    li, one = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.range(5).agg(F.max("id").alias("m"))
    eager = eager_agg(li, one, ["l_returnflag"], {"n": F.count("*")}, [F.col("m")])
    plain = li.crossJoin(one).groupBy("l_returnflag", "m").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, eager.select("l_returnflag", "n", "m").collect())) == sorted(map(tuple, plain.select("l_returnflag", "n", "m").collect()))


def test_points(spark):
    df = spark.createDataFrame([("1.5,2",), ("9,9",), (None,), ("x",)], "p string")
    box = Box((1.0, None), (5.0, 3.0))
    assert [r.p for r in df.where(box.holds([coordinate("p", 0), coordinate("p", 1)])).collect()] == ["1.5,2"]
