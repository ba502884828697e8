"""Star joins that SQL writes out but doesn't need: how many are left, and that results stay."""

import pytest
from pyspark.sql import functions as F

from starlode.operators.cube import Cube, Measure, Options
from starlode.plans.elimination import Edges, eliminate, joins
from starlode.plans.model import ModelError
from starlode.queries import NATIONS, SPARK, STAR, star
from starlode.session import Engine


@pytest.fixture(scope="module")
def engine(spark, sf):
    e = Engine(spark)
    e.add(star(spark, sf))
    return e


def left(df):
    return joins(df._jdf.queryExecution().optimizedPlan())


LOC = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"
CASES = [
    ("select l_returnflag, count(*) as n from sales group by l_returnflag", 0),
    ("select cn_name, count(*) as n from sales group by cn_name", 3),
    ("select count(*) as n from sales where sr_name = 'ASIA'", 3),
    ("select l_returnflag, sum(l_quantity) as q from sales where l_shipdate > timestamp'1996-01-01' group by l_returnflag order by q", 0),
    ("select 'cn_name' as k, count(*) as `sr_name` from sales", 0),
    ("select count(*) as n from (select distinct l_suppkey, o_orderpriority from sales) x", 1),
    ("select a.l_returnflag, count(*) as n from sales a join sales b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1 group by 1", 1),
    (f"select l_returnflag, count(*) as n from {LOC} group by 1", 0),
    (f"select o_orderpriority, count(*) as n from {LOC} join supplier on l_suppkey = s_suppkey group by 1", 1),
    ("select count(*) as n from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey", 0),
    ("select count(*) as n from (select l_orderkey as k from lineitem) a join (select o_orderkey as j from orders) b on a.k = b.j", 0),
    ("select count(*) as n from orders join lineitem on o_orderkey = l_orderkey and l_linenumber = 1", 0),
    # nothing may go from these
    ("select count(*) as n from lineitem join (select * from orders where o_orderkey % 2 = 0) o on l_orderkey = o_orderkey", 1),
    ("select count(*) as n from lineitem join (select o_custkey as o_orderkey from orders) o on l_orderkey = o_orderkey", 1),
    ("select count(*) as n from lineitem join orders on l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval 60 day", 1),
    ("select count(*) as n from lineitem join (select o_orderkey from orders limit 10) o on l_orderkey = o_orderkey", 1),
    ("select count(*) as n from (select c_custkey, o_orderkey as k from customer left join orders on c_custkey = o_custkey) x join orders o on x.k = o.o_orderkey", 1),
    ("select count(*) as n from orders left semi join lineitem on o_orderkey = l_orderkey", 1),
]


@pytest.mark.parametrize("text,n", CASES)
def test_joins_left_and_results(spark, engine, text, n):
    fast = engine.sql(text)
    assert left(fast) <= n
    plain = spark.sql(text)
    assert fast.columns == plain.columns and sorted(map(repr, fast.collect())) == sorted(map(repr, plain.collect()))
    if n == left(plain):
        assert left(fast) == left(plain)


@pytest.mark.parametrize("name", ["q3", "q5", "q7", "q8", "q10", "j_fact_dim", "j_dim_fact", "j_snowflake", "j_bushy", "j_theta_residual", *(n for n in SPARK if n.startswith("bi_"))])
def test_workload_runs_through_the_engine(spark, sf, engine, name):
    text = SPARK[name].keywords["text"]
    fast = engine.sql(text)
    plain = spark.sql(text)
    assert left(fast) <= left(plain)
    assert sorted(map(repr, fast.collect())) == sorted(map(repr, plain.collect()))


def test_columns_of_the_star_decide(engine):
    """A star of eight joins is joined as far as its columns lie."""
    for column, n in (("l_tax", 0), ("o_orderdate", 1), ("c_mktsegment", 2), ("cr_name", 4), ("p_type", 1), ("sn_name", 2)):
        assert left(engine.sql(f"select {column}, count(*) as n from {STAR} group by {column}")) == n, column
    assert NATIONS


def test_checked_edges(spark, sf):
    """Without trust an edge is checked; a table that is a selection of rows always is."""
    whole = star(spark, sf)
    strict = Cube(spark, "s", whole.tables, whole.star, "l_shipdate", options=Options(trust_star=False))
    text = "select count(*) as n from lineitem join orders on l_orderkey = o_orderkey"
    assert left(eliminate(spark.sql(text), [Edges(strict)])) == 0
    whole.validate()
    broken = Cube(spark, "b", whole.tables | {"orders": whole.tables["orders"].where("o_orderkey % 2 = 0")}, whole.star, "l_shipdate")
    with pytest.raises(ModelError, match="lineitem - orders"):
        broken.validate()
    assert left(eliminate(spark.sql(text), [Edges(broken)])) == 1


def test_declared_stars_are_not_scanned(spark, sf):
    """Planning a query of a declared star runs no job."""
    cube = star(spark, sf)
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("star", "")
    cube.query(["l_returnflag"], [Measure("n", "count")])
    assert not list(tracker.getJobIdsForGroup("star"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_views_do_not_overwrite_each_other(spark, sf):
    e = Engine(spark)
    one = star(spark, sf)
    one.name = "a.sales"
    e.add(one)
    other = star(spark, sf)
    other.name = "b.sales"
    with pytest.raises(ModelError, match="another cube"):
        e.add(other)
    e.drop("a.sales")
    e.add(other)
    assert e.sql("select count(*) as n from sales").first().n == e.cube("b.sales").tables["lineitem"].agg(F.count("*")).first()[0]
