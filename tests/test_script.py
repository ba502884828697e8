"""Script functions against what JavaScript gives, written out."""

import pytest
from pyspark.sql import functions as F

from starlode.functions.script import Unsupported, aggregated, holds, of_numbers, of_text

TEXTS = [
    ("x.toUpperCase() + 1", "ab", "AB1"),
    ("x.substring(3, 1)", "abcd", "bc"),
    ("x.substring(-2, 2)", "abcd", "ab"),
    ("x.charAt(9)", "ab", ""),
    ("x.indexOf('z')", "ab", "-1"),
    ("x.length / 2", "abc", "1.5"),
    ("x.length / 0", "abc", "Infinity"),
    ("parseInt(x) + 1", "12ab", "13"),
    ("parseFloat(x)", "2.50x", "2.5"),
    ("isNaN(x) ? 'no' : 'yes'", "1e3", "yes"),
    ("isNaN(x) ? 'no' : 'yes'", "", "yes"),
    ("Number(x) + ''", " 7 ", "7"),
    ("x == 7", "7.0", "true"),
    ("x === 7", "7", "false"),
    ("x || 'none'", "", "none"),
    ("x && x.concat('!', '?')", "a", "a!?"),
    ("'it\\'s ' + x", "b", "it's b"),
    ("-Math.floor(-2.5) % 2 + 1", "", "2"),
    ("x.startsWith('a') ? x.includes('c') ? 1 : 2 : 3", "abc", "1"),
]


@pytest.mark.parametrize("body, given, wanted", TEXTS)
def test_texts(spark, body, given, wanted):
    df = spark.createDataFrame([(given,)], "x string").select(of_text(f"function(x) {{ return {body}; }}", F.col("x")).alias("y"))
    assert df.first()[0] == wanted


def test_nulls_compare_as_false(spark):
    df = spark.createDataFrame([(None,), ("a",)], "x string")
    of = lambda body: [r[0] for r in df.select(holds(f"function f(x) {{ {body} }}", F.col("x"))).collect()]
    assert of("return x > 'A'") == [False, True]
    assert of("return !(x > 'A')") == [True, False]
    assert of("return x == null") == [True, False]
    assert of("if (x) return true; else { return false; }") == [False, True]
    assert [r[0] for r in df.select(of_text("function(x) { return x + 1 }", F.col("x"))).collect()] == [None, "a1"]


def test_aggregators_and_numbers(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, -3.0)], "k int, v double")
    add = {"fnAggregate": "function(c, v) { return v > 0 ? c + v * v : c - 1; }", "fnCombine": "function(a, b) { return a + b; }", "fnReset": "function() { return 0; }"}
    low = {"fnAggregate": "function(c, v) { return Math.min(v, c); }", "fnReset": "function() { return 5; }"}
    out = df.groupBy("k").agg(aggregated(add, [F.col("v")], lambda c: c).alias("s"), aggregated(low, [F.col("v")], lambda c: c).alias("m"))
    assert sorted(map(tuple, out.collect())) == [(1, 3.0, 2.0), (2, -1.0, -3.0)]
    assert df.select(of_numbers("function(k, v) { return Math.max(k, v) }", [F.col("k"), F.col("v")])).collect()[2][0] == 2.0


@pytest.mark.parametrize("source", ["function(x) { while (x) { } }", "function(x) { return x[0]; }", "function(x) { return y; }", "x", "function(x) { return", "function(x) { }", "function(x) { return x.charAt(1, 2); }", "function(x) { if (x) { return 1; } }", "function(a, b) { return a; }"])
def test_what_is_not_understood_raises(spark, source):
    with pytest.raises(Unsupported):
        holds(source, F.lit("a"))


@pytest.mark.parametrize("body", ["current * a", "Math.max(current + a, a)", "a", "current", "current > a ? current : a", "current + current"])
def test_other_aggregators_raise(spark, body):
    with pytest.raises(Unsupported):
        aggregated({"fnAggregate": f"function(current, a) {{ return {body}; }}"}, [F.lit(1)], lambda c: c)


def test_a_sum_that_begins_elsewhere_raises(spark):
    with pytest.raises(Unsupported):
        aggregated({"fnAggregate": "function(c, a) { return c + a; }", "fnReset": "function() { return 10; }"}, [F.lit(1)], lambda c: c)
