"""Running an engine: metrics, retries, changed files, the server."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starlode.operators.cube import Cube, Measure
from starlode.plans.model import StarSchema
from starlode.session import Engine, retried

SERVER = """
import socket, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from starlode.session import Engine
with socket.socket() as free:
    free.bind(("127.0.0.1", 0))
    port = free.getsockname()[1]
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.catalogImplementation", "hive")
b = b.config("spark.hadoop.hive.server2.thrift.port", str(port)).config("spark.sql.warehouse.dir", sys.argv[2]).config("spark.hadoop.javax.jdo.option.ConnectionURL", "jdbc:derby:memory:x;create=true")
spark = b.config("spark.sql.hive.thriftServer.singleSession", "true").getOrCreate()
engine = Engine(spark)
spark.range(5).createOrReplaceTempView("five")
engine.serve()
spark._jvm.java.lang.Class.forName("org.apache.hive.jdbc.HiveDriver")
c = spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:hive2://127.0.0.1:{port}/", "x", "")
r = c.createStatement().executeQuery("select sum(id) + (select count(*) from cube_relations) as t from five")
r.next()
print("sum", r.getLong(1))
c.close()
engine.server.stop()
spark.stop()
"""


@pytest.fixture
def flat(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select((F.col("id") % 4).cast("string").alias("k"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("t"))
    rows.repartition(2).write.parquet(path)
    engine, tables = Engine(spark), {"t": spark.read.parquet(path)}
    cube = engine.add(Cube(spark, "flat", tables, StarSchema.of("t", [], tables), "t"))
    yield engine, cube, rows, path, str(tmp_path / "r")
    engine.drop("flat")


def test_metrics_are_of_the_last_run(flat, spark):
    engine, *_ = flat
    assert len(engine.run("select k, sum(v) as s from flat group by k")) == 4
    found = spark.table("cube_metrics").collect()
    assert any(r["metric"] == "numOutputRows" and "Scan" in r["operator"] and r["value"] == 100 for r in found)
    assert any(r["metric"] == "shuffleRecordsWritten" for r in found)


def test_changed_files_are_seen_and_rollups_retire(flat, spark):
    engine, cube, rows, path, rollup = flat
    n = [Measure("n", "count")]
    cube.add_rollup(rollup, "month", ["k"], n)
    assert cube.answer_from(["k"], n, None, None, None) is not None and cube.query((), n).first()["n"] == 100
    assert engine.refresh() == []
    rows.write.mode("append").parquet(path)
    assert [r["cube"] for r in engine.run("refresh cube flat")] == ["default.flat"]
    assert cube.answer_from(["k"], n, None, None, None) is None and cube.query((), n).first()["n"] == 200
    assert engine.run("select count(*) as n from flat")[0]["n"] == 200 and engine.refresh("flat") == []


def test_retries_wait_longer_each_time_and_only_for_lost_machines():
    waits, failures = [], [ConnectionError("a"), RuntimeError("ExecutorLostFailure (executor 3)")]

    def action():
        if failures:
            raise failures.pop(0)
        return 7

    assert retried(action, 3, wait=waits.append) == 7 and waits == [0.5, 1.0]
    failures += [ConnectionError("a")] * 2
    with pytest.raises(ConnectionError):
        retried(action, 2, wait=waits.append)
    failures[:] = [ValueError("more than 3 result rows")]
    with pytest.raises(ValueError):
        retried(action, 5, wait=waits.append)
    assert waits == [0.5, 1.0, 0.5]


def test_the_server_answers_jdbc(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", SERVER, root, str(tmp_path)], capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "sum 10" in out.stdout, out.stderr[-2000:]


def test_a_session_without_the_catalog_cannot_serve(spark):
    with pytest.raises(ValueError, match="hive"):
        Engine(spark).serve()
