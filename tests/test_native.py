"""Native queries from roll-ups, pruned copies and pages."""

import pytest
from pyspark.sql import functions as F

from starlode.operators.cube import Cube, Measure
from starlode.plans.native import Compiler, NativeQuery, answers, natural
from starlode.queries import star
from starlode.session import Engine
from starlode.sources import index

COUNT, SUM = {"type": "count", "name": "n"}, {"type": "doubleSum", "name": "s", "fieldName": "l_quantity"}
YEARS = ["1996-01-01/1998-01-01"]


@pytest.fixture(scope="module")
def rolled(spark, sf, tmp_path_factory):
    cube = star(spark, sf)
    cube.add_rollup(str(tmp_path_factory.mktemp("r") / "r"), "month", ["cn_name", "l_returnflag"], [Measure("n", "count"), Measure("q", "sum", "l_quantity"), Measure("lo", "min", "l_tax")])
    return cube


def rounded(df):
    return sorted(repr([round(v, 4) if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize(
    "spec",
    [
        {"queryType": "groupBy", "dimensions": ["cn_name"], "aggregations": [COUNT, SUM, {"type": "doubleMin", "name": "t", "fieldName": "l_tax"}], "intervals": YEARS},
        {"queryType": "groupBy", "dimensions": ["l_returnflag"], "granularity": {"type": "period", "period": "P3M"}, "aggregations": [COUNT], "filter": {"type": "not", "field": {"type": "selector", "dimension": "cn_name", "value": "NATION_3"}}, "intervals": YEARS},
        {"queryType": "timeseries", "granularity": {"type": "period", "period": "P1Y"}, "aggregations": [SUM], "intervals": []},
        {"queryType": "topN", "dimension": "cn_name", "metric": "n", "threshold": 4, "aggregations": [COUNT], "intervals": YEARS},
    ],
)
def test_rollups_answer(spark, sf, rolled, spec):
    got = rolled.native(spec)
    assert any(rolled.rollups[0].path in f for f in got.inputFiles()) and len(got.columns) == len(star(spark, sf).native(spec).columns)
    assert rounded(got) == rounded(star(spark, sf).native(spec))


@pytest.mark.parametrize(
    "change",
    [
        {"dimensions": ["c_name"]}, {"granularity": "day"}, {"granularity": {"type": "period", "period": "P1M", "timeZone": "Asia/Tokyo"}}, {"intervals": ["1996-01-02/1998-01-01"]}, {"aggregations": [{"type": "doubleSum", "name": "s", "fieldName": "l_tax"}]},
        {"aggregations": [{"type": "hyperUnique", "name": "u", "fieldName": "c_name"}]}, {"filter": {"type": "selector", "dimension": "l_linestatus", "value": "F"}}, {"aggregations": [{"type": "filtered", "filter": {"type": "selector", "dimension": "cn_name", "value": "x"}, "aggregator": COUNT}]},
    ],
)
def test_rollups_refuse(rolled, change):
    spec = {"queryType": "groupBy", "dimensions": ["cn_name"], "aggregations": [COUNT], "intervals": YEARS}
    assert answers(rolled.rollups[0], NativeQuery.parse(spec), "l_shipdate")
    assert not answers(rolled.rollups[0], NativeQuery.parse(spec | change), "l_shipdate")


def test_months_are_pruned(spark, sf, tmp_path):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    copy = index.build_index(li, str(tmp_path / "i"), "l_shipdate")
    cube = Cube.over(spark, "copy", copy, "l_shipdate")
    spec = {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [COUNT], "intervals": ["1996-03-01/1996-05-01"]}
    got = cube.native(spec)
    assert "PartitionFilters: [isnotnull(seg" in got._jdf.queryExecution().executedPlan().toString()
    assert rounded(got) == rounded(Cube.over(spark, "raw", li, "l_shipdate").native(spec))


def test_pages_give_every_row_once(spark, sf):
    """Also of rows that are equal in all that is selected, over more than a page."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").limit(200).select("l_shipdate", "l_returnflag", "l_quantity", F.when(F.col("l_quantity") > 20, F.col("l_linestatus")).alias("s"))
    li = spark.createDataFrame(li.collect() + li.limit(3).collect() * 40, li.schema)
    for down in (False, True):
        spec = {"queryType": "select", "dimensions": ["l_returnflag", "s"], "metrics": ["l_quantity"], "pagingSpec": {"threshold": 30}, "descending": down, "intervals": []}
        got = [p.collect() for p in Cube.over(spark, "c", li, "l_shipdate").pages(spec)]
        assert [len(p) for p in got] == [30] * 10 + [20]
        rows = [r for p in got for r in p]
        assert sorted(map(repr, rows)) == sorted(repr(r) for r in li.select(F.col("l_shipdate").alias("timestamp"), "l_returnflag", "s", "l_quantity").collect())
        assert [r.timestamp for r in rows] == sorted((r.timestamp for r in rows), reverse=down)


def test_natural_order(spark):
    words = ["a10", "a9", "a010b", "b1", "10", "9", "a", "007", None]
    got = [r.x for r in spark.createDataFrame([(w,) for w in words], "x string").orderBy(natural(F.col("x")).asc()).collect()]
    assert got == [None, "007", "9", "10", "a", "a9", "a10", "a010b", "b1"]
    df = spark.createDataFrame([("a10",), ("a9",), ("b",)], "x string").withColumn("t", F.lit("2000-01-01").cast("timestamp_ntz"))
    spec = {"queryType": "topN", "dimension": "x", "metric": {"type": "alphaNumeric"}, "threshold": 2, "aggregations": [COUNT], "intervals": []}
    assert [r.x for r in Compiler(df, "t").compile(NativeQuery.parse(spec)).collect()] == ["a9", "a10"]


def test_context(spark, sf):
    e = Engine(spark)
    e.add(star(spark, sf))
    ask = lambda context: e.sql(f'on cube sales execute query {{"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [{{"type": "count", "name": "n"}}], "intervals": [], "context": {context}}}')
    assert len(ask('{"queryId": "a", "timeout": 600000, "maxResults": 3}').collect()) == 3
    assert "a" in spark.getTags()
    e.sql("select 1")
    assert "a" not in spark.getTags()
    with pytest.raises(Exception, match="more than 2 result rows"):
        ask('{"maxResults": 2}').collect()
    for wrong in ('{"nothing": 1}', '{"bySegment": true}'):
        with pytest.raises(ValueError):
            ask(wrong)


def test_filters_that_are_not_the_same_twice_ask_the_rows(rolled):
    assert rolled.answer_from(["cn_name"], [Measure("n", "count")], "l_returnflag = 'R'", None, None)
    assert not rolled.answer_from(["cn_name"], [Measure("n", "count")], "l_returnflag = 'R' and rand() < 0.5", None, None)


def test_a_part_comes_from_the_rollup(spark, sf, rolled):
    """Whole months from the roll-up, the days around them from the rows."""
    from starlode.plans.interval import Interval

    interval, measures = Interval.parse("1996-01-10/1999-05-20"), [Measure("n", "count"), Measure("lo", "min", "l_tax")]
    got = rolled.query_with_rest(["cn_name"], measures, interval)
    assert any(rolled.rollups[0].path in f for f in got.inputFiles()) and any("lineitem" in f for f in got.inputFiles())
    assert rounded(got) == rounded(star(spark, sf).query(["cn_name"], measures, interval=interval))
    short = Interval.parse("1996-01-10/1996-01-20")
    assert not any(rolled.rollups[0].path in f for f in rolled.query_with_rest(["cn_name"], measures, short).inputFiles())


def test_theta_rollup(spark, sf, tmp_path):
    cube = star(spark, sf)
    d = [Measure("d", "theta_distinct", "l_orderkey")]
    cube.add_rollup(str(tmp_path / "t"), "month", ["l_returnflag"], d)
    assert cube.answer_from(["l_returnflag"], d, None, None, None)
    exact = {r[0]: r[1] for r in cube.query(["l_returnflag"], [Measure("d", "distinct", "l_orderkey")]).collect()}
    assert all(abs(r.d - exact[r.l_returnflag]) <= 0.1 * exact[r.l_returnflag] for r in cube.query(["l_returnflag"], d).collect())
