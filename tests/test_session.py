"""Commands, views, history, plug-ins, index upkeep and streams."""

import pytest
from pyspark.sql import functions as F

from starlode.plans.interval import Interval
from starlode.queries import star
from starlode.session import Engine, pages
from starlode.sources import index
from starlode.sources.tables import delimited
from starlode.streaming import windows


@pytest.fixture()
def engine(spark, sf):
    e = Engine(spark)
    e.add(star(spark, sf))
    return e


def test_commands(engine, tmp_path):
    assert engine.sql("select count(*) as n from sales").first().n > 0
    got = engine.sql('ON CUBE sales USING historical EXECUTE QUERY {"queryType": "timeseries", "granularity": "all", "aggregations": [{"type": "count", "name": "n"}], "context": {"queryId": "q-1"}}')
    assert got.first().n == engine.sql("select count(*) as n from sales").first().n
    kinds = {r.kind for r in engine.sql("explain cube rewrite select cn_name, count(*) from sales group by cn_name").collect()}
    assert kinds == {"plan", "cost"}
    assert engine.sql("clear cache").first().cleared == "all"
    assert [r.kind for r in engine.sql("select kind from cube_queries").collect()] == ["sql", "native", "sql", "explain", "clear"]
    engine.index("sales", str(tmp_path / "i"))
    assert engine.sql("select sum(n_rows) as n from cube_segments").first().n == engine.sql("select count(*) as n from sales").first().n
    assert engine.sql("select distinct server from cube_assignments").count() == 1
    with pytest.raises(KeyError):
        engine.sql('on cube nothing execute query {"queryType": "timeBoundary"}')


def test_plugins(spark):
    class Shout:
        def rewrites(self, text):
            return text.replace("ONE", "1")

        def commands(self, engine, text):
            return engine.spark.range(3) if text == "three" else None

    e = Engine(spark, [Shout()])
    assert e.sql("three").count() == 3 and e.sql("select ONE as x").first().x == 1


def test_pages(spark):
    got = list(pages(spark.range(25), ["id"], 10))
    assert [len(p) for p in got] == [10, 10, 5] and got[2][0].id == 20


def test_months_are_replaced_alone(spark, sf, tmp_path):
    li, path = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_shipdate"), str(tmp_path / "i")
    before = index.build_index(li, path, "l_shipdate").count()
    month = Interval.parse("1996-03-01/1996-04-01")
    own = li.where(month.holds(F.col("l_shipdate")))
    gone, n = 1, own.count()
    index.insert_overwrite(own.limit(n - gone), path, "l_shipdate")
    df = spark.read.parquet(path)
    assert df.count() == before - gone
    assert "PartitionFilters: [isnotnull(seg" in index.prune(df, month)._jdf.queryExecution().executedPlan().toString()
    assert index.drop(spark, path)


def test_delimited(spark, tmp_path):
    (tmp_path / "n.tbl").write_text("1|a\n2|\n")
    assert [tuple(r) for r in delimited(spark, str(tmp_path / "n.tbl"), "k int, v string").orderBy("k").collect()] == [(1, "a"), (2, None)]


def test_running_totals_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    q = windows.running_totals(stream, "event_type", "value").writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path)).trigger(once=True).start()  # a state with a time-out keeps other triggers running for it
    assert q.awaitTermination(120)
    got = {r.event_type: r.n for r in spark.table("totals").groupBy("event_type").agg(F.max("n").alias("n")).collect()}
    assert got == {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}


def test_statements_make_and_drop_cubes(spark, sf, tmp_path):
    from starlode.sources.tables import views

    views(spark, sf)
    e = Engine(spark)
    e.sql("""create cube small on lineitem options {"timeColumn": "l_shipdate", "starSchema": {"factTable": "lineitem", "relations": [
        {"leftTable": "lineitem", "rightTable": "orders", "relationType": "n-1", "joinCondition": [{"leftAttribute": "l_orderkey", "rightAttribute": "o_orderkey"}]}]},
        "functionalDependencies": [{"col1": "o_orderkey", "col2": "o_custkey", "type": "n-1"}]}""")
    n = spark.table("lineitem").count()
    assert e.run("select count(*) as n from small")[0].n == n
    e.sql(f"create rollup on cube small at '{tmp_path}/r' options " + '{"grain": "month", "dimensions": ["l_returnflag"], "measures": [{"name": "n", "kind": "count"}]}')
    got = e.sql('on cube small execute query {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [{"type": "count", "name": "n"}], "intervals": []}')
    assert any("/r/" in f for f in got.inputFiles()) and sum(r.n for r in got.collect()) == n
    e.sql(f"create index on cube small at '{tmp_path}/i'")
    assert e.sql("select sum(n_rows) as n from cube_segments").first().n == n
    e.sql("insert overwrite index on cube small select * from small where l_shipdate >= timestamp'1996-03-01' and l_shipdate < timestamp'1996-04-01' and l_linenumber = 1")
    gone = spark.sql("select count(*) as n from lineitem where l_shipdate >= timestamp'1996-03-01' and l_shipdate < timestamp'1996-04-01' and l_linenumber <> 1").first().n
    assert e.sql("select sum(n_rows) as n from cube_segments").first().n == n - gone and gone
    e.sql("drop index on cube small")
    e.sql("drop cube small")
    assert not e.cubes and e.sql("select * from cube_segments").count() == 0
    row = e.sql("select * from cube_queries where query = 'select count(*) as n from small'").first()
    assert row.n_rows == 1 and row.run_ms > 0
    assert e.sql("select server from cube_servers").count() >= 1


def test_explain_reads_the_plan(engine):
    """Names in literals are no dimensions; counts are kept until the cache is cleared."""
    c = engine.cube("sales")
    rows = engine.sql("explain cube rewrite select 'group by c_name' as k, cn_name, count(*) from sales group by cn_name").where("kind = 'cost'").collect()
    assert rows and set(c.known) == {"extent", "cn_name"}
    engine.sql("clear cache")
    assert not c.known
