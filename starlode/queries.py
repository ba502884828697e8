"""The query registry: each query as Spark runs it and, where SQL can say it, as DuckDB does.

Queries over the plain tables are SQL in both engines; cubes, native queries, time vocabulary and
streaming windows go through this library's own operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.spatial import Box
from .operators.cube import Cube, Measure
from .plans.interval import Interval, bucket
from .plans.model import Edge, FunctionalDependency, StarSchema
from .plans.rewrite import eager_agg
from .sources import index
from .sources.tables import dealt, table, views
from .streaming import windows

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DUCK: dict[str, str] = {}

NATIONS = {f"{s}{n}": f"(select {k}_{n}key {p}{k}_{n}key, {k}_name {p}{k}_name{', n_regionkey ' + p + 'n_regionkey' if n == 'nation' else ''} from {n})" for s, p in (("cust", "c"), ("supp", "s")) for n, k in (("nation", "n"), ("region", "r"))}
EDGES = (
    ("lineitem", "orders", "l_orderkey", "o_orderkey"), ("orders", "customer", "o_custkey", "c_custkey"), ("customer", "custnation", "c_nationkey", "cn_nationkey"), ("custnation", "custregion", "cn_regionkey", "cr_regionkey"),
    ("lineitem", "supplier", "l_suppkey", "s_suppkey"), ("supplier", "suppnation", "s_nationkey", "sn_nationkey"), ("suppnation", "suppregion", "sn_regionkey", "sr_regionkey"), ("lineitem", "part", "l_partkey", "p_partkey"),
)
STAR = "lineitem " + " ".join(f"join {r} on {a} = {b}" for _, r, a, b in EDGES)
LO = "lineitem join orders on l_orderkey = o_orderkey"
LOC = f"{LO} join customer on o_custkey = c_custkey"


def _sql(spark: SparkSession, sf_dir: str, text: str, keys: dict[str, str] | None = None) -> DataFrame:
    views(spark, sf_dir)
    if not keys:
        return spark.sql(text)
    for name, df in dealt(spark, sf_dir, keys).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        views(spark, sf_dir, tuple(keys))


def sql(name: str, text: str, duck: str | None = None, keys: dict[str, str] | None = None) -> None:
    """``keys``: the columns by which tables are dealt out, where a task holds a group for each of their values."""
    SPARK[name] = partial(_sql, text=text, keys=keys)
    text = duck or text
    DUCK[name] = f"with {', '.join(f'{k} as {v}' for k, v in NATIONS.items())} {text}" if any(k in text for k in NATIONS) else text


def query(duck: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        SPARK[f.__name__] = f
        if duck is not None:
            DUCK[f.__name__] = f"with {', '.join(f'{k} as {v}' for k, v in NATIONS.items())} {duck}" if any(k in duck for k in NATIONS) else duck
        return f

    return add


# --- the flagship, scans and projections

sql(
    "basic_aggregation",
    f"select l_returnflag, l_linestatus, count(*) as c, round(sum(l_extendedprice), 2) as s, max(l_tax) as m, round(avg(l_quantity), 4) as a, count(distinct o_orderkey) as d from {LO} where l_shipdate <= timestamp'2000-12-01' - interval 90 day group by l_returnflag, l_linestatus",
    keys={"lineitem": "l_orderkey", "orders": "o_orderkey"},
)
sql("scan_parquet", "select * from nation")
sql("project_alias", "select c_custkey as k, c_name as customer, c_acctbal as balance from customer")
sql("project_expr", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, upper(l_returnflag) || '-' || l_linestatus as tag from lineitem")
sql("select_unpushed_filter", "select o_orderkey, o_totalprice from orders where round(o_totalprice / 1000) % 2 = 0 and length(o_orderpriority) > 5")

# --- filters

for _n, _w in {
    "f_eq": "l_returnflag = 'R'", "f_eq_mirrored": "'R' = l_returnflag", "f_ne": "l_returnflag <> 'N'", "f_lt_gt": "l_returnflag > 'A' and l_returnflag <= 'N'", "f_numeric_bound": "l_linenumber < 3 and 4.5 <= l_quantity", "f_between": "l_quantity between 10 and 20",
    "f_in": "l_returnflag in ('A', 'R') and l_linenumber in (1, 2, 7)", "f_not_in": "l_linenumber not in (1, 2, 3)", "f_and_or_not": "(l_returnflag = 'A' and l_linestatus = 'F') or not (l_quantity > 10 or l_discount < 0.05)", "f_isnull": "nullif(l_returnflag, 'A') is null", "f_notnull": "nullif(l_returnflag, 'A') is not null",
    "f_expr_upper": "upper(lower(l_returnflag)) = 'N'", "f_coalesce": "coalesce(nullif(l_returnflag, 'N'), l_linestatus) = 'O'", "f_false": "1 = 2", "f_null_predicate": "l_quantity > cast(null as double)", "f_spatial_box": "l_quantity >= 5 and l_quantity <= 30 and l_discount >= 0.02 and l_discount <= 0.06",
}.items():
    sql(_n, f"select l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as price, min(l_orderkey) as first_order from lineitem where {_w} group by l_linestatus")
for _n, _w, _d in (
    ("f_like", "p_type like '%A%' and p_brand like 'B%1_'", None), ("f_not_like", "p_type not like 'S%'", None), ("f_rlike", "p_type rlike '^[EM].*M?'", "regexp_matches(p_type, '^[EM].*M?')"),
    ("f_starts_ends_contains", "startswith(p_type, 'S') or endswith(p_type, 'Y') or contains(p_type, 'ROM')", "starts_with(p_type, 'S') or ends_with(p_type, 'Y') or contains(p_type, 'ROM')"),
):
    sql(_n, f"select p_type, count(*) as n from part where {_w} group by p_type", f"select p_type, count(*) as n from part where {_d or _w} group by p_type")
sql("f_time_equal", "select count(*) as n from lineitem where cast(l_shipdate as date) = date'1996-03-13'")
sql("f_having", "select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by l_suppkey having count(*) > 20 and sum(l_quantity) > 100")


@query("select l_returnflag, count(*) as n from lineitem where l_quantity >= 10 and l_quantity <= 20 and l_discount >= 0.02 and l_discount <= 0.05 group by l_returnflag")
def f_spatial_meet(spark, sf_dir):
    """Two boxes on one point meet in one."""
    box = Box((10.0, None), (40.0, 0.05)).meet(Box((None, 0.02), (20.0, 0.09)))
    return table(spark, sf_dir, "lineitem").where(box.holds(["l_quantity", "l_discount"])).groupBy("l_returnflag").agg(F.count("*").alias("n"))


sql("f_spatial_or", "select count(*) as n from customer where (c_acctbal >= 0 and c_nationkey <= 5) or (c_acctbal < 0 and c_nationkey > 20)")

# --- joins

sql("j_fact_dim", f"select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as q from {LO} group by o_orderpriority")
sql("j_dim_fact", "select o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority")
sql("j_snowflake", f"select cn_name, cr_name, count(*) as n, round(sum(l_extendedprice), 2) as price from {STAR} group by cn_name, cr_name")
sql("j_bushy", "select s_name, c_mktsegment, count(*) as n from (select l_orderkey, s_name from lineitem join supplier on l_suppkey = s_suppkey) a join (select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey) b on a.l_orderkey = b.o_orderkey group by s_name, c_mktsegment")
sql("j_theta_residual", f"select o_orderpriority, count(*) as n from {LO} and l_shipdate > o_orderdate + interval 60 day group by o_orderpriority")
sql("j_right_outer", "select c.c_custkey, a.n as orders_n from (select o_custkey, count(*) as n from orders group by o_custkey) a right join (select c_custkey from customer where c_acctbal > 0) c on a.o_custkey = c.c_custkey")
sql("j_full_outer", "select a.k as ka, b.k as kb, a.n as na, b.n as nb from (select c_nationkey k, count(*) n from customer where c_acctbal > 5000 group by c_nationkey) a full join (select s_nationkey k, count(*) n from supplier group by s_nationkey) b on a.k = b.k")
sql("j_semi", "select count(*) as n from orders left semi join (select l_orderkey from lineitem where l_returnflag = 'R') r on o_orderkey = r.l_orderkey", "select count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
sql("j_anti", "select c_mktsegment, count(*) as n from customer left anti join orders on c_custkey = o_custkey group by c_mktsegment", "select c_mktsegment, count(*) as n from customer where not exists (select 1 from orders where c_custkey = o_custkey) group by c_mktsegment")
sql("j_self", "select a.l_linestatus as s1, b.l_linestatus as s2, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1 group by a.l_linestatus, b.l_linestatus")
sql("j_scalar_subquery", "select l_returnflag, count(*) as n from lineitem where l_quantity < (select 0.4 * avg(l_quantity) from lineitem) group by l_returnflag")
sql("j_range", "select b.lo, count(*) as n from lineitem join (select 0 as lo, 10 as hi union all select 10, 25 union all select 25, 60) b on l_quantity > b.lo and l_quantity <= b.hi group by b.lo")


@query("select l_returnflag, n, s, mi + 10 as mi10 from (select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as s from lineitem group by l_returnflag) a cross join (select min(o_orderkey) as mi from orders where o_orderpriority <> '1-URGENT') b")
def j_scalar_cross_eager(spark, sf_dir):
    """Groups are formed below the join with a one-row aggregate."""
    one = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'").agg(F.min("o_orderkey").alias("mi"))
    aggs = {"n": F.count("*"), "s": F.round(F.sum("l_extendedprice"), 2)}
    return eager_agg(table(spark, sf_dir, "lineitem"), one, ["l_returnflag"], aggs, [(F.col("mi") + 10).alias("mi10")])


# --- TPC-H shapes

sql("q1", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as sum_disc_price, cast(sum(cast(l_extendedprice * (1 - l_discount) * (1 + l_tax) as decimal(18, 6))) as double) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 4) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp'1998-12-01' - interval 90 day group by l_returnflag, l_linestatus")
sql("q3", f"select l_orderkey, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue, o_orderdate from {LOC} where c_mktsegment = 'BUILDING' and o_orderdate < timestamp'1997-03-15' and l_shipdate > timestamp'1997-03-15' group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10")
sql("q5", f"select sn_name, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue from {STAR} where sr_name = 'ASIA' and o_orderdate >= timestamp'1996-01-01' and o_orderdate < timestamp'1999-01-01' group by sn_name")
sql("q7", f"select sn_name, cn_name, cast(year(l_shipdate) as int) as l_year, round(sum(l_extendedprice), 2) as revenue from {STAR} where (sn_name in ('NATION_6', 'NATION_7', 'NATION_8') and cn_name in ('NATION_6', 'NATION_7', 'NATION_9')) and l_shipdate between timestamp'1996-01-01' and timestamp'1999-12-31' group by sn_name, cn_name, year(l_shipdate)")
sql("q8", f"select cast(year(o_orderdate) as int) as o_year, round(sum(case when sn_name = 'NATION_6' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as mkt_share from {STAR} where cr_name = 'AMERICA' and o_orderdate between timestamp'1995-01-01' and timestamp'1998-12-31' and p_type in ('ECONOMY', 'PROMO') group by year(o_orderdate)")
sql("q10", f"select c_custkey, c_name, cn_name, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue from {STAR} where o_orderdate >= timestamp'1996-10-01' and o_orderdate < timestamp'1997-01-01' and l_returnflag = 'R' group by c_custkey, c_name, cn_name order by revenue desc, c_custkey limit 20")
sql("ship_date_range", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as s from lineitem where l_shipdate >= timestamp'1997-01-01' and l_shipdate <= timestamp'1997-01-31' group by l_returnflag, l_linestatus")
sql("subquery_filters_range", f"select o_orderpriority, n, s from (select o_orderpriority, p_type, count(*) as n, round(sum(l_extendedprice), 2) as s from {STAR} where p_type = 'ECONOMY' and sr_name = 'ASIA' and l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1998-01-01' group by o_orderpriority, p_type) x where n > 1")

# --- aggregates

sql("a_count", "select l_returnflag, count(*) as c, count(1) as c1 from lineitem group by l_returnflag")
sql("a_count_col", "select l_linestatus, count(nullif(l_returnflag, 'N')) as n from lineitem group by l_linestatus")
sql("a_sum_minmax", "select l_returnflag, round(sum(l_quantity), 2) as s, cast(sum(l_linenumber) as bigint) as sl, min(l_discount) as lo, max(l_discount) as hi, min(l_shipdate) as first_ship from lineitem group by l_returnflag")
sql("a_avg", "select l_returnflag, round(avg(l_quantity), 4) as a, round(avg(l_linenumber), 4) as al from lineitem group by l_returnflag")
sql("a_avg_expr", "select l_returnflag, round(avg(l_extendedprice * (1 - l_discount)), 4) as a from lineitem group by l_returnflag")
sql("a_multi_col_expr", "select cast(sum(cast(l_extendedprice * l_discount as decimal(18, 4))) as double) as s, round(min(l_quantity + l_tax), 4) as mi, round(max(l_extendedprice - l_quantity * 100), 2) as mx from lineitem")
sql("a_min_ts", "select min(cast(l_shipdate as timestamp)) as a, max(l_shipdate) as b, min(l_linenumber) as c from lineitem", "select min(l_shipdate) as a, max(l_shipdate) as b, min(l_linenumber) as c from lineitem")
sql("a_global", "select count(*) as n, round(sum(o_totalprice), 2) as s from orders where o_totalprice > 1e12")
sql("a_distinct_one", "select l_returnflag, count(distinct l_suppkey) as d from lineitem group by l_returnflag")
sql("a_distinct_many", "select l_linestatus, count(distinct l_suppkey) as d1, count(distinct l_partkey) as d2, round(sum(l_quantity), 2) as q, count(*) as n from lineitem group by l_linestatus")
sql("a_no_agg", "select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus")
sql("a_select_distinct", "select distinct c_mktsegment from customer")
sql("a_sum_literal", "select l_returnflag, cast(sum(5) as bigint) as s, count(*) * 5 as c from lineitem group by l_returnflag")
sql("a_agg_arith", "select l_returnflag, round(sum(l_quantity) - 5, 2) as s, count(*) + 1 as n, round(sum(l_extendedprice) / sum(l_quantity), 4) as unit from lineitem group by l_returnflag")
sql("a_filtered", "select l_returnflag, round(sum(l_quantity) filter (where l_discount > 0.05), 2) as q, count(*) filter (where l_tax = 0) as n, sum(case when l_linestatus = 'F' then 1 else 0 end) as f from lineitem group by l_returnflag", "select l_returnflag, round(sum(l_quantity) filter (where l_discount > 0.05), 2) as q, count(*) filter (where l_tax = 0) as n, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as f from lineitem group by l_returnflag")
sql("a_group_expr", "select concat(lower(l_returnflag), l_linestatus) as k, count(*) as n from lineitem group by concat(lower(l_returnflag), l_linestatus)")
sql("a_group_time", "select cast(year(l_shipdate) as int) as y, cast(month(l_shipdate) as int) as m, count(*) as n from lineitem group by year(l_shipdate), month(l_shipdate)")
sql("a_cube", "select l_returnflag, l_linestatus, cast(grouping_id() as bigint) as g, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by l_returnflag, l_linestatus with cube", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as g, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)")
sql("a_rollup", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as d from lineitem group by l_returnflag, l_linestatus with rollup", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as d from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("a_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus grouping sets ((l_returnflag), (l_linestatus), ())", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
sql("a_cube_filter", f"select o_orderpriority, l_returnflag, round(sum(l_extendedprice), 2) as s from {LO} where l_shipdate >= timestamp'1997-01-01' group by o_orderpriority, l_returnflag with cube", f"select o_orderpriority, l_returnflag, round(sum(l_extendedprice), 2) as s from {LO} where l_shipdate >= timestamp'1997-01-01' group by cube (o_orderpriority, l_returnflag)")
sql("a_cube_expr", "select lower(l_returnflag) as k, l_linestatus, count(*) as n from lineitem group by cube (lower(l_returnflag), l_linestatus)")
sql("a_cube_order_limit", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus with cube order by n desc, l_returnflag nulls first, l_linestatus nulls first limit 3", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus) order by n desc, l_returnflag nulls first, l_linestatus nulls first limit 3")
sql("a_union_cubes", "select l_returnflag as k, count(*) as n from lineitem group by l_returnflag with cube union all select l_linestatus, count(*) from lineitem group by l_linestatus with cube", "select l_returnflag as k, count(*) as n from lineitem group by cube (l_returnflag) union all select l_linestatus, count(*) from lineitem group by cube (l_linestatus)")


def _near(estimate, exact, share: float):
    """Whether an estimate is within ``share`` of the exact number: what an oracle can say of it."""
    return F.abs(estimate - exact) <= share * exact


_DISTINCT = "select l_returnflag, count(distinct l_orderkey) as exact, true as near from lineitem group by 1"


@query(_DISTINCT)
def a_approx_distinct(spark, sf_dir):
    """Three standard errors of 5 %. Repeated pairs go first: they don't change a sketch, and else each pair would hold one."""
    pairs = dealt(spark, sf_dir, {"lineitem": "l_orderkey"})["lineitem"].select("l_returnflag", "l_orderkey").distinct()
    rows = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("d"), F.count("l_orderkey").alias("exact"))
    return rows.select("l_returnflag", "exact", _near(F.col("d"), F.col("exact"), 0.15).alias("near"))


@query(_DISTINCT)
def a_hll_rollup(spark, sf_dir):
    """Sketches of a monthly roll-up, merged by flag: its answer against the exact one of the rows."""
    cube = star(spark, sf_dir)
    d = [Measure("d", "approx_distinct", "l_orderkey")]
    cube.add_rollup(_scratch(spark, "hll"), "month", ["l_returnflag"], d)
    assert cube.answer_from(["l_returnflag"], d, None, None, None) is not None
    exact = cube.query(["l_returnflag"], [Measure("exact", "distinct", "l_orderkey")], rollups=False)
    both = cube.query(["l_returnflag"], d).join(exact, "l_returnflag")
    return both.select("l_returnflag", "exact", _near(F.col("d"), F.col("exact"), 0.1).alias("near"))


@query("select count(*) as exact, true as near from (select l_orderkey from lineitem where l_returnflag = 'R' intersect select l_orderkey from lineitem where l_returnflag <> 'R')")
def a_theta(spark, sf_dir):
    """Orders that have both returned and other lines, estimated from two theta sketches."""
    li = table(spark, sf_dir, "lineitem")
    of = lambda w, n: F.theta_sketch_agg(F.expr(f"case when {w} then l_orderkey end")).alias(n)
    sketches = li.agg(of("l_returnflag = 'R'", "a"), of("l_returnflag <> 'R'", "b")).select(F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("d"))
    orders = li.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") != "R").alias("o"))
    exact = orders.agg(F.count_if(F.col("r") & F.col("o")).alias("exact"))
    return sketches.crossJoin(F.broadcast(exact)).select("exact", _near(F.col("d"), F.col("exact"), 0.1).alias("near"))


# --- native queries


def star(spark: SparkSession, sf_dir: str) -> Cube:
    views(spark, sf_dir)
    tables = {n: spark.table(n) for n in ("lineitem", *(r for _, r, _, _ in EDGES))}
    schema = StarSchema.of("lineitem", [Edge(a, b, ((x, y),)) for a, b, x, y in EDGES], tables)
    known = [FunctionalDependency("c_name", "c_mktsegment"), FunctionalDependency("c_name", "cn_name"), FunctionalDependency("cn_name", "cr_name")]
    return Cube(spark, "sales", tables, schema, "l_shipdate", dependencies=known, axes={"point": ("l_quantity", "l_discount")})


def native(name: str, spec: dict, duck: str | None) -> None:
    def run(spark, sf_dir):
        return star(spark, sf_dir).native(spec)

    run.__name__ = name
    query(duck)(run)


_COUNT, _SUM = {"type": "count", "name": "n"}, {"type": "doubleSum", "name": "s", "fieldName": "l_quantity"}
_1996 = ["1996-01-01T00:00:00.000Z/1998-01-01T00:00:00.000Z"]
_IN_1996 = "l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1998-01-01'"
native("n_groupby", {"queryType": "groupBy", "dimensions": ["l_returnflag", {"type": "default", "dimension": "o_orderpriority", "outputName": "p"}], "aggregations": [_COUNT, _SUM], "filter": {"type": "and", "fields": [{"type": "selector", "dimension": "cr_name", "value": "ASIA"}, {"type": "not", "field": {"type": "selector", "dimension": "l_linestatus", "value": "F"}}]}, "having": {"type": "greaterThan", "aggregation": "n", "value": 2}, "intervals": _1996}, f"select l_returnflag, o_orderpriority as p, count(*) as n, sum(l_quantity) as s from {STAR} where cr_name = 'ASIA' and l_linestatus <> 'F' and {_IN_1996} group by all having count(*) > 2")
native("n_timeseries_all", {"queryType": "timeseries", "granularity": "all", "aggregations": [_COUNT, _SUM, {"type": "longMax", "name": "m", "fieldName": "l_linenumber"}], "intervals": _1996}, f"select count(*) as n, sum(l_quantity) as s, max(l_linenumber)::bigint as m from lineitem where {_IN_1996}")
native("n_timeseries_month", {"queryType": "timeseries", "granularity": {"type": "period", "period": "P1M"}, "aggregations": [_COUNT, _SUM], "intervals": _1996}, f"select date_trunc('month', l_shipdate)::timestamp as timestamp, count(*) as n, sum(l_quantity) as s from lineitem where {_IN_1996} group by 1")
native("n_timeseries_week", {"queryType": "timeseries", "granularity": {"type": "period", "period": "P1W"}, "aggregations": [_COUNT], "intervals": _1996}, f"select date_trunc('week', l_shipdate)::timestamp as timestamp, count(*) as n from lineitem where {_IN_1996} group by 1")
native("n_timeseries_duration", {"queryType": "timeseries", "granularity": {"type": "duration", "duration": 864000000}, "aggregations": [_COUNT], "intervals": _1996}, f"select to_timestamp(floor(epoch(l_shipdate) / 864000) * 864000)::timestamp as timestamp, count(*) as n from lineitem where {_IN_1996} group by 1")
native("n_topn", {"queryType": "topN", "dimension": "c_name", "metric": {"type": "numeric", "metric": "s"}, "threshold": 7, "aggregations": [_SUM], "intervals": _1996}, f"select c_name, sum(l_quantity) as s from {LOC} where {_IN_1996} group by 1 order by s desc, c_name limit 7")
native("n_topn_inverted", {"queryType": "topN", "dimension": "c_name", "metric": {"type": "inverted", "metric": "n"}, "threshold": 7, "aggregations": [_COUNT], "intervals": []}, f"select c_name, count(*) as n from {LOC} group by 1 order by n, c_name limit 7")
native("n_topn_lexicographic", {"queryType": "topN", "dimension": "c_name", "metric": {"type": "lexicographic"}, "threshold": 5, "aggregations": [_COUNT], "intervals": []}, f"select c_name, count(*) as n from {LOC} group by 1 order by c_name limit 5")
native("n_search", {"queryType": "search", "searchDimensions": ["p_type", "c_mktsegment", "cr_name"], "query": {"type": "insensitive_contains", "value": "mA"}, "intervals": _1996}, f"select 'p_type' as dimension, p_type as value, count(*) as count from {STAR} where p_type ilike '%ma%' and {_IN_1996} group by 1, 2 union all select 'c_mktsegment', c_mktsegment, count(*) from {STAR} where c_mktsegment ilike '%ma%' and {_IN_1996} group by 1, 2 union all select 'cr_name', cr_name, count(*) from {STAR} where cr_name ilike '%ma%' and {_IN_1996} group by 1, 2")
native("n_select_page", {"queryType": "select", "dimensions": ["l_returnflag", "o_orderpriority"], "metrics": ["l_orderkey", "l_linenumber", "l_quantity"], "pagingSpec": {"pagingIdentifiers": {"all": 19}, "threshold": 15}, "intervals": _1996}, f"select l_shipdate as timestamp, l_returnflag, o_orderpriority, l_orderkey, l_linenumber, l_quantity from {LO} where {_IN_1996} order by all offset 20 limit 15")
native("n_time_boundary", {"queryType": "timeBoundary"}, 'select min(l_shipdate) as "minTime", max(l_shipdate) as "maxTime" from lineitem')

_LISTED = {"l_returnflag": "string", "l_quantity": "double", "o_orderpriority": "string", "c_nationkey": "int", "cr_name": "string"}


@query(" union all ".join(f"select '{c}' as \"column\", '{t}' as type, count(*) - count({c}) as nulls, count(distinct {c}) as exact, true as near from (select {c} from {STAR} where {_IN_1996}) r" for c, t in _LISTED.items()))
def n_segment_metadata(spark, sf_dir):
    """Types and nulls as they are; the estimated cardinality is held against the exact one."""
    cube = star(spark, sf_dir)
    found = cube.native({"queryType": "segmentMetadata", "intervals": _1996, "toInclude": {"type": "list", "columns": [*_LISTED]}})
    exact = cube.query(measures=[Measure(c, "distinct", c) for c in _LISTED], interval=Interval.parse(_1996[0]))
    exact = exact.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in _LISTED))))
    return found.join(exact, "column").select("column", "type", "nulls", "exact", _near(F.col("cardinality"), F.col("exact"), 0.15).alias("near"))

native("n_bound_regex_in", {"queryType": "groupBy", "dimensions": ["p_type"], "aggregations": [_COUNT], "filter": {"type": "and", "fields": [{"type": "bound", "dimension": "l_quantity", "lower": "5", "lowerStrict": True, "upper": "30", "alphaNumeric": True}, {"type": "or", "fields": [{"type": "regex", "dimension": "p_type", "pattern": "^S"}, {"type": "in", "dimension": "l_returnflag", "values": ["A", "R"]}]}, {"type": "bound", "dimension": "c_mktsegment", "lower": "B", "upper": "H", "alphaNumeric": False}]}, "intervals": []}, f"select p_type, count(*) as n from {STAR} where l_quantity > 5 and l_quantity <= 30 and (p_type like 'S%' or l_returnflag in ('A', 'R')) and c_mktsegment >= 'B' and c_mktsegment <= 'H' group by 1")
native("n_spatial", {"queryType": "timeseries", "granularity": "all", "aggregations": [_COUNT], "filter": {"type": "spatial", "dimension": "point", "bound": {"type": "rectangular", "minCoords": [5, 0.02], "maxCoords": [30, 0.06]}}, "intervals": []}, "select count(*) as n from lineitem where l_quantity between 5 and 30 and l_discount between 0.02 and 0.06")
native("n_filtered", {"queryType": "groupBy", "dimensions": ["l_linestatus"], "aggregations": [{"type": "filtered", "filter": {"type": "selector", "dimension": "l_returnflag", "value": "R"}, "aggregator": _COUNT}, {"type": "javascript", "name": "net", "fieldNames": ["l_quantity", "l_linenumber"], "fnAggregate": "function(current, a, b) { return current + (a * b) }", "fnCombine": "function(x, y) { return x + y }", "fnReset": "function() { return 0 }"}], "filter": {"type": "javascript", "dimension": "l_returnflag", "function": "function(x) { return(x >= 'N') }"}, "intervals": []}, "select l_linestatus, count(*) filter (where l_returnflag = 'R') as n, sum(l_quantity * l_linenumber) as net from lineitem where l_returnflag >= 'N' group by 1")
native("n_script_filter", {"queryType": "groupBy", "dimensions": ["l_linestatus"], "aggregations": [_COUNT], "filter": {"type": "javascript", "dimension": "l_returnflag", "function": "function(x) { return x >= 'N' }"}, "intervals": []}, "select l_linestatus, count(*) as n from lineitem where l_returnflag >= 'N' group by 1")
native("n_script_branches", {"queryType": "groupBy", "dimensions": ["l_linestatus"], "aggregations": [_COUNT], "filter": {"type": "javascript", "dimension": "p_type", "function": "function(x) { var low = x.toLowerCase(); if (low.indexOf('steel') >= 0) { return low.length > 18; } return low.substring(0, 3) === 'eco' && !low.endsWith('tin'); }"}, "intervals": []}, f"select l_linestatus, count(*) as n from {STAR} where case when p_type ilike '%steel%' then length(p_type) > 18 else p_type ilike 'eco%' and not p_type ilike '%tin' end group by 1")
native("n_script_aggregator", {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [{"type": "javascript", "name": "big", "fieldNames": ["l_quantity", "l_linenumber"], "fnAggregate": "function(current, a, b) { if (a > 25 && b != 2) { return current + a * b; } return current; }", "fnCombine": "function(x, y) { return x + y; }", "fnReset": "function() { return 0; }"}, {"type": "javascript", "name": "top", "fieldNames": ["l_quantity", "l_linenumber"], "fnAggregate": "function(current, a, b) { return Math.max(current, a % 7 + b); }", "fnCombine": "function(x, y) { return Math.max(x, y); }", "fnReset": "function() { return -Infinity; }"}], "intervals": _1996}, f"select l_returnflag, sum(case when l_quantity > 25 and l_linenumber <> 2 then l_quantity * l_linenumber else 0 end)::double as big, max(l_quantity % 7 + l_linenumber)::double as top from lineitem where {_IN_1996} group by 1")
native("pa_script", {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [_COUNT, _SUM], "postAggregations": [{"type": "javascript", "name": "share", "fieldNames": ["s", "n"], "function": "function(s, n) { return n === 0 ? 0 : Math.round(100 * s / n) / 100; }"}], "intervals": []}, "select l_returnflag, count(*) as n, sum(l_quantity) as s, floor(100 * sum(l_quantity) / count(*) + 0.5) / 100 as share from lineitem group by 1")
native("x_script", {"queryType": "groupBy", "dimensions": [{"type": "extraction", "dimension": "o_orderpriority", "outputName": "p", "extractionFn": {"type": "javascript", "function": "function(x) { return 'P' + (parseInt(x) + 1) + ':' + x.substr(2).toUpperCase().trim(); }"}}], "aggregations": [_COUNT], "intervals": []}, f"select 'P' || (left(o_orderpriority, 1)::int + 1) || ':' || upper(trim(substr(o_orderpriority, 3))) as p, count(*) as n from {LO} group by 1")
native("n_extraction_filter", {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [_COUNT], "filter": {"type": "extraction", "dimension": "__time", "value": "1996", "extractionFn": {"type": "timeFormat", "format": "yyyy", "timeZone": "UTC"}}, "intervals": []}, "select l_returnflag, count(*) as n from lineitem where year(l_shipdate) = 1996 group by 1")
native("n_topn_alphanumeric", {"queryType": "topN", "dimension": "c_name", "metric": {"type": "alphaNumeric"}, "threshold": 6, "aggregations": [_COUNT], "intervals": []}, f"select c_name, count(*) as n from {LOC} group by 1 order by regexp_extract(c_name, '^[^0-9]*'), regexp_extract(c_name, '[0-9]+')::bigint limit 6")
native("n_limit_order", {"queryType": "groupBy", "dimensions": ["c_name"], "aggregations": [_COUNT, _SUM], "limitSpec": {"type": "default", "limit": 9, "columns": [{"dimension": "n", "direction": "DESCENDING"}, {"dimension": "c_name"}]}, "intervals": _1996}, f"select c_name, count(*) as n, sum(l_quantity) as s from {LOC} where {_IN_1996} group by 1 order by n desc, c_name limit 9")
native("pa_arithmetic", {"queryType": "groupBy", "dimensions": ["l_returnflag"], "aggregations": [_COUNT, _SUM], "postAggregations": [{"type": "arithmetic", "name": "mean", "fn": "/", "fields": [{"type": "fieldAccess", "fieldName": "s"}, {"type": "fieldAccess", "fieldName": "n"}]}, {"type": "arithmetic", "name": "odd", "fn": "*", "fields": [{"type": "arithmetic", "fn": "-", "fields": [{"type": "fieldAccess", "fieldName": "n"}, {"type": "constant", "value": 3}]}, {"type": "constant", "value": 2}]}], "intervals": []}, "select l_returnflag, count(*) as n, sum(l_quantity) as s, sum(l_quantity) / count(*) as mean, (count(*) - 3.0::double) * 2 as odd from lineitem group by 1")
for _n, _fn, _dim, _d in (
    ("x_regex", {"type": "regex", "expr": "^([A-Z]{2})"}, "p_type", "nullif(regexp_extract(p_type, '^([A-Z]{2})', 1), '')"), ("x_partial", {"type": "partial", "expr": "M$"}, "p_type", "case when regexp_matches(p_type, 'M$') then p_type end"),
    ("x_search", {"type": "searchQuery", "query": {"type": "insensitive_contains", "value": "al"}}, "p_type", "case when p_type ilike '%al%' then p_type end"), ("x_timeformat", {"type": "timeFormat", "format": "yyyy-MM", "timeZone": "UTC"}, "__time", "strftime(l_shipdate, '%Y-%m')"),
    ("x_timeparse", {"type": "time", "timeFormat": "yyyy-MM-dd HH:mm:ss", "resultFormat": "yyyy"}, "__time", "strftime(l_shipdate, '%Y')"), ("x_lookup", {"type": "lookup", "lookup": {"type": "map", "map": {"SMALL": "true", "LARGE": "true"}}}, "p_type", "case when p_type in ('SMALL', 'LARGE') then 'true' end"),
):
    native(_n, {"queryType": "groupBy", "dimensions": [{"type": "extraction", "dimension": _dim, "outputName": "x", "extractionFn": _fn}], "aggregations": [_COUNT], "intervals": []}, f"select {_d} as x, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")

# --- time


@query("select count(*) as n, min(l_shipdate) as a, max(l_shipdate) as b from lineitem where l_shipdate >= timestamp'1996-05-01' - interval 90 day and l_shipdate < timestamp'1997-02-03 04:05:06'")
def t_interval_dsl(spark, sf_dir):
    li, t = table(spark, sf_dir, "lineitem"), F.col("l_shipdate")
    rows = li.where(dates.date_is_after_or_equal(t, dates.date_minus(dates.date_time(F.lit("1996-05-01")), "P90D")) & dates.date_is_before(t, dates.date_time(F.lit("1997-02-03T04:05:06"))))
    return rows.agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))


@query("select l_returnflag, count(*) as n from lineitem where l_shipdate < timestamp'1996-01-01' or l_shipdate >= timestamp'2000-06-01' group by 1")
def t_dsl_sql(spark, sf_dir):
    views(spark, sf_dir)
    dates.register(spark)
    return spark.sql("select l_returnflag, count(*) as n from lineitem where dateIsBefore(l_shipdate, dateTime('1996-01-01')) or dateIsAfterOrEqual(l_shipdate, datePlus(dateTime('2000-05-31'), period('P1D'))) group by l_returnflag")


sql("t_interval_cast", "select count(*) as n from lineitem where cast(l_shipdate as timestamp) >= timestamp'1996-01-01' and cast(concat(to_date(l_shipdate), ' 00:00:00') as timestamp) <= timestamp'1996-12-31 00:00:00'", "select count(*) as n from lineitem where l_shipdate >= timestamp'1996-01-01' and l_shipdate::date <= date'1996-12-31'")
sql("t_interval_string", "select count(*) as n from lineitem where cast(l_shipdate as string) < '1996-06-01'", "select count(*) as n from lineitem where strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') < '1996-06-01'")
sql("t_interval_empty", "select l_returnflag, count(*) as n from lineitem where l_shipdate < timestamp'1996-01-01' and l_shipdate > timestamp'1997-01-01' group by l_returnflag")
sql("t_outside", "select count(*) as n from lineitem where l_shipdate >= timestamp'1980-01-01' and l_shipdate < timestamp'2050-01-01'")


def _element(spark, sf_dir, name):
    return table(spark, sf_dir, "lineitem").groupBy(dates.element(name, "l_shipdate").alias("e")).agg(F.count("*").alias("n"))


for _n, _d in {
    "era": "case when year(l_shipdate) > 0 then 'AD' else 'BC' end", "centuryOfEra": "(year(l_shipdate) // 100)::int", "yearOfEra": "year(l_shipdate)::int", "yearOfCentury": "(year(l_shipdate) % 100)::int", "year": "year(l_shipdate)::int", "weekyear": "isoyear(l_shipdate)::int", "monthOfYear": "month(l_shipdate)::int", "monthOfYearName": "monthname(l_shipdate)",
    "weekOfWeekyear": "week(l_shipdate)::int", "dayOfYear": "dayofyear(l_shipdate)::int", "dayOfMonth": "day(l_shipdate)::int", "dayOfWeek": "isodow(l_shipdate)::int", "dayOfWeekName": "dayname(l_shipdate)", "hourOfDay": "hour(l_shipdate)::int", "secondOfMinute": "second(l_shipdate)::int",
}.items():
    SPARK[f"t_element_{_n}"] = partial(_element, name=_n)
    DUCK[f"t_element_{_n}"] = f"select {_d} as e, count(*) as n from lineitem group by 1"


@query("select hour(ts at time zone 'UTC' at time zone 'America/New_York')::int as h, count(*) as n from events group by 1")
def t_zone(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.element("hourOfDay", dates.with_zone("ts", "America/New_York")).alias("h")).agg(F.count("*").alias("n"))


@query("select date_trunc('hour', ts)::timestamp as b, count(*) as n, round(sum(value), 4) as v from events group by 1")
def t_granularity_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(bucket(F.col("ts"), "hour").alias("b")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


# --- scalar expressions

for _n, _s, _d in (
    ("e_concat", "concat(l_returnflag, '/', l_linestatus)", "l_returnflag || '/' || l_linestatus"), ("e_case", "case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end", None), ("e_case_no_else", "case when l_quantity < 10 then '' when l_quantity < 30 then 'mid' end", None),
    ("e_if", "if(l_discount > 0.05, 'big', 'small')", None), ("e_substring", "substring(cast(l_orderkey as string), 1, 2)", "substring(l_orderkey::varchar, 1, 2)"), ("e_coalesce", "coalesce(nullif(l_linenumber, 1), 0)", None), ("e_in_null", "l_linenumber in (1, 2, null)", None),
    ("e_date_add_sub", "date_sub(date_add(to_date(l_shipdate), 40), 9)", "(l_shipdate::date + 31)::date"), ("e_datediff", "datediff(date'2002-01-01', to_date(l_shipdate))", "(date'2002-01-01' - l_shipdate::date)::int"), ("e_quarter_expr", "cast((month(l_shipdate) - 1) / 3 + 1 as bigint)", "trunc((month(l_shipdate) - 1) / 3 + 1)::bigint"),
    ("e_quarter", "quarter(l_shipdate)", "quarter(l_shipdate)::int"), ("e_weekofyear", "weekofyear(l_shipdate)", "week(l_shipdate)::int"), ("e_trunc", "trunc(to_date(l_shipdate), 'MM')", "date_trunc('month', l_shipdate)::date"), ("e_trunc_year", "trunc(to_date(l_shipdate), 'YEAR')", "date_trunc('year', l_shipdate)::date"), ("e_date_format", "date_format(l_shipdate, 'yyyy/MM')", "strftime(l_shipdate, '%Y/%m')"),
    ("e_unix_round_trip", "from_unixtime(unix_timestamp(l_shipdate), 'yyyy-MM')", "strftime(l_shipdate, '%Y-%m')"), ("e_unix_timestamp", "unix_timestamp(trunc(l_shipdate, 'YEAR'))", "epoch(date_trunc('year', l_shipdate)::timestamp)::bigint"), ("e_arith", "round(l_quantity * 2 + l_tax - 1, 4)", None), ("e_divide", "round(l_quantity / 7, 4)", None), ("e_integral_divide", "l_orderkey div 100", "l_orderkey // 100"),
    ("e_mod_pmod", "concat(l_orderkey % 7, ',', pmod(-l_orderkey, 5))", "(l_orderkey % 7)::varchar || ',' || (((-l_orderkey % 5) + 5) % 5)::varchar"), ("e_abs_floor_ceil", "concat(cast(floor(l_quantity / 3) as bigint), ',', cast(ceil(abs(-l_quantity) / 3) as bigint))", "floor(l_quantity / 3)::bigint::varchar || ',' || ceil(abs(-l_quantity) / 3)::bigint::varchar"),
    ("e_sqrt_log", "round(sqrt(l_quantity) + ln(l_quantity), 6)", None), ("e_unary", "-l_linenumber", None), ("e_unary_plus", "+l_linenumber", None), ("e_upper_lower", "concat(upper('ab'), lower(l_returnflag))", "upper('ab') || lower(l_returnflag)"),
    ("e_cast_numbers", "cast(cast(l_quantity as int) as string)", "trunc(l_quantity)::int::varchar"), ("e_cast_string", "cast(cast(l_linenumber as string) as double)", "l_linenumber::varchar::double"), ("e_try_cast", "try_cast(l_returnflag as int)", None), ("e_cast_boolean", "cast(l_linenumber - 1 as boolean)", None), ("e_cast_date", "cast(cast(l_shipdate as date) as string)", "l_shipdate::date::varchar"),
    ("e_date_compare", "l_shipdate > timestamp'1997-06-01'", None), ("e_like_rlike", "l_returnflag like 'R%' or l_linestatus rlike '^F'", "l_returnflag like 'R%' or regexp_matches(l_linestatus, '^F')"), ("e_spark_only", "round(sin(l_linenumber), 6)", None),
):
    sql(_n, f"select {_s} as e, count(*) as n from lineitem group by 1", f"select {_d or _s} as e, count(*) as n from lineitem group by 1")
sql("e_json", "select get_json_object(props, '$.k') as k, count(*) as n from events group by 1", "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
sql("e_time_parts", "select hour(ts) as h, minute(ts) as m, count(*) as n from events group by 1, 2", "select hour(ts)::int as h, minute(ts)::int as m, count(*) as n from events group by 1, 2")


@query("select vec_id, label, list_max(embedding)::float as top, len(embedding)::int as n from embeddings where list_contains([0, 1, 2], label)")
def e_arrays(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label in (0, 1, 2)").select("vec_id", "label", F.array_max("embedding").alias("top"), F.size("embedding").alias("n"))


# --- order, limits, sets, windows

sql("o_sort_dim", "select distinct c_mktsegment from customer order by c_mktsegment desc")
sql("o_sort_metric", "select l_suppkey, count(*) as n from lineitem group by l_suppkey order by n desc, l_suppkey")
sql("o_sort_limit", "select o_custkey, round(sum(o_totalprice), 2) as s from orders group by o_custkey order by s desc, o_custkey limit 10")
sql("o_sort_expr", "select l_suppkey, count(*) + 1 as n1 from lineitem group by l_suppkey order by count(*) + 1 desc, l_suppkey limit 8")
sql("o_sort_avg", "select l_suppkey, round(avg(l_quantity), 4) as a from lineitem group by l_suppkey order by a, l_suppkey limit 8")
sql("o_limit_tie_safe", "select l_orderkey, l_linenumber, l_quantity from lineitem order by l_quantity desc, l_orderkey, l_linenumber limit 25")
sql("o_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 30")
sql("u_union_all", "select l_returnflag as k, count(*) as n from lineitem group by l_returnflag union all select l_linestatus, count(*) from lineitem group by l_linestatus")
sql("u_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
sql("u_intersect", "select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
sql("u_except", "select n_nationkey as k from nation except select s_nationkey from supplier")
sql("u_except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier")
sql("u_intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")

@query("select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as q from lineitem where l_shipdate >= timestamp'1996-01-10' and l_shipdate < timestamp'1999-05-20' group by l_returnflag")
def u_index_and_raw(spark, sf_dir):
    """Whole months of the interval from a roll-up that ends before it does, the rest from the rows."""
    cube, measures = star(spark, sf_dir), [Measure("n", "count"), Measure("q", "sum", "l_quantity")]
    cube.add_rollup(_scratch(spark, "part"), "month", ["l_returnflag"], measures, Interval.parse("1995-06-01/1998-01-01"))
    out = cube.query_with_rest(["l_returnflag"], measures, Interval.parse("1996-01-10/1999-05-20"))
    return out.withColumn("q", F.round("q", 2))


_MONTHLY = "select l_returnflag, cast(year(l_shipdate) as int) as y, cast(month(l_shipdate) as int) as m, round(sum(l_extendedprice), 2) as s from lineitem group by l_returnflag, year(l_shipdate), month(l_shipdate)"
sql("w_moving_avg", f"select l_returnflag, y, m, round(avg(s) over (partition by l_returnflag order by y, m rows between 10 preceding and current row), 6) as a from ({_MONTHLY}) x")
sql("w_delta_from_max", f"select l_returnflag, y, m, round(s - max(s) over (partition by l_returnflag order by s desc, y, m), 2) as d from ({_MONTHLY}) x")
sql("w_dense_rank_topn", f"select * from (select l_returnflag, y, m, s, cast(dense_rank() over (partition by l_returnflag order by s desc) as bigint) as r from ({_MONTHLY}) x) t where r < 10")
sql("w_row_number_lag", f"select l_returnflag, y, m, cast(row_number() over w as bigint) as rn, lag(s) over w as before, lead(s, 2) over w as after, first_value(s) over w as first, cast(ntile(4) over w as bigint) as tile from ({_MONTHLY}) x window w as (partition by l_returnflag order by y, m)")
sql("w_ranks", f"select l_returnflag, y, m, cast(rank() over w as bigint) as r, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c from ({_MONTHLY}) x window w as (partition by l_returnflag order by y)")

# --- cubes and roll-ups

_MEASURES = (Measure("n", "count"), Measure("q", "sum", "l_quantity"), Measure("lo", "min", "l_discount"), Measure("hi", "max", "l_discount"), Measure("a", "avg", "l_quantity"))
_CUBED = "count(*) as n, round(sum(l_quantity), 2) as q, min(l_discount) as lo, max(l_discount) as hi, round(avg(l_quantity), 4) as a"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"q": F.round("q", 2), "a": F.round("a", 4)})


@query(f"select cr_name, l_returnflag, {_CUBED} from {STAR} group by 1, 2")
def c_cube_vs_raw(spark, sf_dir):
    return _rounded(star(spark, sf_dir).query(["cr_name", "l_returnflag"], _MEASURES))


@query(f"select l_returnflag, {_CUBED} from lineitem where l_linestatus = 'F' group by 1")
def c_star_elim(spark, sf_dir):
    """Asks nothing of the dimensions, so no dimension is joined."""
    return _rounded(star(spark, sf_dir).query(["l_returnflag"], _MEASURES, where="l_linestatus = 'F'"))


@query(f"select cn_name, date_trunc('quarter', l_shipdate)::timestamp as bucket, {_CUBED} from {STAR} where {_IN_1996} group by 1, 2")
def c_rollup_month(spark, sf_dir):
    """A monthly roll-up in a shared folder answers by quarter."""
    cube = star(spark, sf_dir)
    cube.add_rollup(_scratch(spark, "rollup"), "month", ["cn_name", "l_returnflag"], _MEASURES)
    interval = Interval.parse(_1996[0])
    assert cube.answer_from(["cn_name"], _MEASURES, None, interval, "quarter") is not None
    return _rounded(cube.query(["cn_name"], _MEASURES, interval=interval, grain="quarter"))


@query("select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint as grouping_id, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_linestatus), ()) having count(*) > 5 order by n desc, l_returnflag nulls first limit 5")
def c_grouping_sets(spark, sf_dir):
    df = star(spark, sf_dir).query(["l_returnflag", "l_linestatus"], _MEASURES[:2], sets=[["l_returnflag", "l_linestatus"], ["l_linestatus"], []], having="n > 5", order=["-n", "l_returnflag"], limit=5)
    return df.withColumn("q", F.round("q", 2))


@query(f"select strftime(l_shipdate, '%Y-%m') as seg, count(*) as n_rows, min(l_shipdate) as first_time, max(l_shipdate) as last_time from lineitem where {_IN_1996} group by 1")
def c_index_segments(spark, sf_dir):
    """A month-partitioned copy, of which only the interval's partitions are read."""
    interval, path = Interval.parse(_1996[0]), _scratch(spark, "index")
    df = index.build_index(table(spark, sf_dir, "lineitem"), path, "l_shipdate", sort=["l_returnflag", "l_linestatus"])
    return index.segments(index.prune(df, interval), "l_shipdate").drop("n_files")


@query(" union all ".join(f"select '{d}' as dims, (select count(*) from (select distinct {d} from {STAR})) as actual, true as bound" for d in ("c_name,c_mktsegment", "cn_name,cr_name", "c_name,cn_name,cr_name,l_returnflag")))
def c_fd_estimate(spark, sf_dir):
    """Estimated against actual numbers of groups: an estimate bounds them, but for the error of its counts."""
    cube, rows = star(spark, sf_dir), []
    for dims in (["c_name", "c_mktsegment"], ["cn_name", "cr_name"], ["c_name", "cn_name", "cr_name", "l_returnflag"]):
        actual = cube.query(dims).count()
        rows.append((",".join(dims), cube.estimate_cardinality(dims), actual))
    return spark.createDataFrame([(d, a, e >= 0.85 * a) for d, e, a in rows], "dims string, actual long, bound boolean")


@query("select way, true as priced from (values ('merged'), ('by_segment')) t(way)")
def c_cost_table(spark, sf_dir):
    """Both ways of running an aggregate get a cost; the figures are in ``tests/test_plans.py``."""
    from .session import Engine

    engine = Engine(spark)
    engine.add(star(spark, sf_dir))
    return engine.sql("explain cube rewrite select cn_name, count(*) from sales group by cn_name").where("kind = 'cost'").select("way", (F.col("cost") > 0).alias("priced")).distinct()


@query("select 'default.sales' as name, 'lineitem' as fact, 'l_shipdate' as time_column, 0::int as rollups")
def m_views(spark, sf_dir):
    from .session import Engine

    engine = Engine(spark)
    engine.add(star(spark, sf_dir))
    return engine.sql("select name, fact, time_column, rollups from cube_relations")


@query("select * from (values ('sql', 'select count(*) from sales'), ('native', 'on cube sales execute query {\"queryType\": \"timeBoundary\"}')) t(kind, query)")
def m_history(spark, sf_dir):
    from .session import Engine

    engine = Engine(spark)
    engine.add(star(spark, sf_dir))
    engine.sql("select count(*) from sales")
    engine.sql('on cube sales execute query {"queryType": "timeBoundary"}')
    return engine.spark.sql("select kind, query from cube_queries")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='starlode-')}/{name}-{uuid.uuid4().hex}"


# --- events


@query("select date_trunc('hour', ts)::timestamp as window_start, date_trunc('hour', ts)::timestamp + interval 1 hour as window_end, event_type, count(*) as n, round(sum(value), 4) as v from events group by 1, 2, 3")
def events_tumble(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("select s as window_start, s + interval 1 hour as window_end, count(*) as n from (select unnest([time_bucket(interval 15 minute, ts) - interval 45 minute, time_bucket(interval 15 minute, ts) - interval 30 minute, time_bucket(interval 15 minute, ts) - interval 15 minute, time_bucket(interval 15 minute, ts)]) as s from events) group by 1")
def events_slide(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", [], [F.count("*").alias("n")], slide="15 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""select min(ts) as session_start, max(ts) + interval 30 minute as session_end, user_id, count(*) as n from (
    select *, sum(case when before is null or ts >= before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as s
    from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events)) group by user_id, s""")
def events_session(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2")
def events_stream(spark, sf_dir):
    """The same windows over a stream: the table's file is read as a source, in complete mode."""
    import uuid

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    out = windows.tumbling(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    name = f"events_{uuid.uuid4().hex}"
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", _scratch(spark, "stream")).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
