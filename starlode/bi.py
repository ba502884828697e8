"""The business-intelligence workload: query shapes of a dashboard over the flat star."""

from __future__ import annotations

from .queries import STAR, sql

_Y = "cast(year(l_shipdate) as int)"
_M = "cast(month(l_shipdate) as int)"
_R = "l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1999-01-01'"
_S = "round(sum(l_extendedprice), 2)"


def bi(name: str, columns: str, rest: str, group: str | None = None, where: str = _R) -> None:
    keys = f"{group}, " if group else ""
    names = f" group by {', '.join(g.rsplit(' as ', 1)[0] if ') as ' in g else g for g in group.split('; '))}" if group else ""
    sql(f"bi_{name}", f"select {keys.replace('; ', ', ')}{columns} from {STAR} where {where}{names}{rest}")


bi("having_clause", f"{_S} as price, round(sum(l_quantity), 2) as q", " having sum(l_quantity) > 200 order by price desc, c_name", "c_name")
sql("bi_moving_average", f"select p_brand, m, round(avg(s) over (partition by p_brand order by m rows 10 preceding), 6) as a from (select p_brand, {_M} as m, {_S} as s from {STAR} where {_R} group by p_brand, month(l_shipdate)) x")
bi("filter_in_not_equal", "count(*) as n", "", "c_mktsegment; o_orderpriority; l_returnflag; l_linestatus", f"{_R} and c_mktsegment <> 'BUILDING' and p_type not like 'S%' and (cr_name in ('ASIA', 'EUROPE') or sn_name = 'NATION_3')")
bi("dims_with_case", "cast(sum(cast(case when l_returnflag = 'R' then l_extendedprice * l_discount else 0 end as decimal(18, 4))) as double) as returned, cast(sum(cast(case when l_returnflag <> 'R' then l_extendedprice * l_discount else 0 end as decimal(18, 4))) as double) as others", "", "cn_name", f"{_R} and cr_name in ('ASIA', 'AFRICA')")
bi("many_metrics_calc", "round(sum(l_extendedprice), 2) as a, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as b, cast(sum(cast(l_extendedprice * l_tax as decimal(18, 4))) as double) as c, round(avg(l_extendedprice), 4) as d, round(min(l_extendedprice), 2) as e, round(max(l_extendedprice), 2) as f, round(sum(l_quantity), 2) as g, round(avg(l_quantity), 4) as h, round(sum(l_extendedprice) / sum(l_quantity), 4) as i, count(*) as n", "", "sn_name", f"{_R} and sr_name in ('ASIA', 'EUROPE')")
bi("regex_both_sides", "round(sum(l_extendedprice + l_tax), 2) as s", "", f"{_Y} as y; p_type", f"{_R} and p_type like '%AL%'")
bi("multi_condition", f"{_S} as s, count(*) as n", "", f"{_Y} as y; c_mktsegment", f"(c_mktsegment = 'BUILDING' and l_returnflag = 'R') or (c_mktsegment = 'MACHINERY' and l_linestatus = 'O')")
sql("bi_delta_from_top", f"select cr_name, p_brand, round(s - max(s) over (partition by cr_name order by s desc), 2) as delta, a from (select cr_name, p_brand, {_S} as s, round(avg(l_quantity), 4) as a from {STAR} where {_R} group by cr_name, p_brand) x")
bi("filters_many_metrics", "round(avg(l_quantity), 4) as a, round(avg(l_discount), 4) as b, round(avg(l_tax), 4) as c, round(sum(l_extendedprice * l_quantity), 2) as d", "", "p_type", f"{_R} and o_orderpriority <> '5-LOW' and l_quantity > 5")
sql("bi_windowing", f"select sr_name, sn_name, s, max(s) over (partition by sr_name order by s desc) as top from (select sr_name, sn_name, {_S} as s from {STAR} group by sr_name, sn_name) x")
bi("dimension_function", f"{_S} as s", "", f"{_Y} as y; {_M} as m", "l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1996-01-01' + interval 200 day")
bi("filters_regex", "round(avg(l_extendedprice), 4) as a", "", "p_brand", f"{_R} and p_brand like '%2'")
bi("only_metric", f"{_S} as s, count(*) as n", "")
sql("bi_small_quantity", f"select round(sum(l_extendedprice) / 7.0, 2) as s from {STAR} where {_R} and p_type = 'SMALL' and l_quantity < (select 0.7 * avg(l_quantity) from lineitem)")
bi("multi_country", "round(sum(l_quantity), 2) as a, round(sum(l_extendedprice), 2) as b, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as c, cast(sum(cast(l_extendedprice * (1 - l_discount) * (1 + l_tax) as decimal(18, 6))) as double) as d, round(avg(l_quantity), 4) as e, round(avg(l_extendedprice), 4) as f, round(avg(l_discount), 4) as g, count(*) as n", "", "l_returnflag; l_linestatus", f"{_R} and cn_name in ('NATION_1', 'NATION_2', 'NATION_3')")
bi("top_suppliers_country", f"{_S} as s", " order by s desc, s_name limit 10", "s_name; sn_name", f"{_R} and sr_name = 'ASIA'")
bi("many_metrics", "round(sum(l_quantity), 2) as a, round(min(l_quantity), 2) as b, round(max(l_quantity), 2) as c, round(avg(l_quantity), 4) as d, round(sum(l_discount), 4) as e, round(max(l_tax), 4) as f, count(*) as g, count(distinct o_orderkey) as h", "", "cr_name")
bi("count_distinct", "count(distinct o_custkey) as d", " order by d desc, p_brand, p_type limit 10", "p_brand; p_type", f"{_R} and p_type not like 'M%' and p_brand in (select p_brand from part where p_size < 30)")
sql("bi_min_cost", f"select sr_name, p_type, s_name, lowest from (select sr_name, p_type, s_name, round(min(l_tax), 4) as lowest, dense_rank() over (partition by sr_name, p_type order by min(l_tax), s_name) as r from {STAR} where {_R} and p_type like '%E%' group by sr_name, p_type, s_name) x where r = 1")
bi("top_brands_limit", f"{_S} as s", " order by s desc, cr_name, p_brand limit 10", "cr_name; p_brand")
sql("bi_top_brands_window", f"select cr_name, p_brand, s, cast(r as bigint) as r from (select cr_name, p_brand, s, dense_rank() over (partition by cr_name order by s desc) as r from (select cr_name, p_brand, {_S} as s from {STAR} where {_R} group by cr_name, p_brand) y) x where r < 10")
bi("top_suppliers", f"{_S} as s", " order by s desc, s_name limit 10", "s_name")
bi("top_volume_customers", "round(sum(l_quantity), 2) as q", " having sum(l_quantity) > 50 order by q desc, c_name, m limit 3", f"c_name; {_M} as m")
