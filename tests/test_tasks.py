"""Queries with a group for each order deal rows out by key, so that a task's share doesn't grow with the tables."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from starlode.queries import DUCK, SPARK
from starlode.sources import tables


def rows_of(df):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name, keys", [("basic_aggregation", {"lineitem": "l_orderkey", "orders": "o_orderkey"}), ("a_approx_distinct", {"lineitem": "l_orderkey"})])
def test_tasks_keep_their_size_whatever_the_shuffle_partitions(spark, sf, monkeypatch, name, keys):
    monkeypatch.setattr(tables, "TASK_ROWS", 200, raising=False)
    df = SPARK[name](spark, sf)
    found = rows_of(df)
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.sql(DUCK[name])
    order = [r.columns.index(x) for x in df.columns]
    assert found == Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in (x[i] for i in order)) for x in r.fetchall())
    parts = -(-sum(tables.table(spark, sf, t).count() for t in keys) // 200)
    assert parts > 8
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    assert {(k, int(n)) for k, n in dealt} == {(k, parts) for k in keys.values()}


def test_dealt_tables_hold_every_row_once_and_a_key_in_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    for t in ("a", "b"):
        spark.range(300).select(F.when(F.col("id") % 10 > 0, F.col("id") % 97).alias("k"), "id").write.parquet(f"{tmp_path}/{t}.parquet")
    found = tables.dealt(spark, str(tmp_path), {"a": "k", "b": "k"})
    at = [df.withColumn("part", F.spark_partition_id()).collect() for df in found.values()]
    assert [df.rdd.getNumPartitions() for df in found.values()] == [60, 60]
    for rows in at:
        assert sorted(r["id"] for r in rows) == list(range(300))
        assert len({(r["k"], r["part"]) for r in rows}) == len({r["k"] for r in rows})
    assert {(r["k"], r["part"]) for r in at[0]} == {(r["k"], r["part"]) for r in at[1]}


def test_small_tables_stay_as_they_are_and_views_are_plain_afterwards(spark, sf, monkeypatch):
    assert "REPARTITION" not in SPARK["basic_aggregation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    assert "REPARTITION" in SPARK["basic_aggregation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for t in ("lineitem", "orders"):
        assert spark.table(t).rdd.getNumPartitions() == tables.table(spark, sf, t).rdd.getNumPartitions()
