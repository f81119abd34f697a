"""Report-battery queries: probes, steering, findings, signals and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..model import Spec
from ..operators import charts, columns, joins, profile, stats
from ..plans import analysis, findings, probes, signals
from .registry import query
from .tables import union_sql

# -- the two views the probes run on -------------------------------------------

LINKS = {"c_custkey": ("orders", "o_custkey"), "n_nationkey": ("customer", "c_nationkey"),
         "r_regionkey": ("nation", "n_regionkey")}
VIEW = """(select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate, c_name, c_mktsegment,
  c_acctbal, n_name, r_name from orders left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)"""


def view(t):
    return joins.assemble_tables({n: getattr(t, n) for n in ("orders", "customer", "nation", "region")}, LINKS)[0]


def joined(t):
    """The same view from a given SELECT, as a caller would pass it."""
    return (t.orders.join(t.customer, F.expr("o_custkey = c_custkey"), "left")
            .join(t.nation, F.expr("c_nationkey = n_nationkey"), "left")
            .join(t.region, F.expr("n_regionkey = r_regionkey"), "left"))


LINES = """(select l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) as tax, l_extendedprice * (1 - l_discount) as revenue,
  l_extendedprice * 0.95 as expected_revenue, l_returnflag, l_linestatus, l_shipdate from lineitem)"""


def lines(t):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return t.lineitem.select("l_quantity", p, d, F.nullif("l_tax", F.lit(0.0)).alias("tax"), (p * (1 - d)).alias("revenue"),
                             (p * 0.95).alias("expected_revenue"), "l_returnflag", "l_linestatus", "l_shipdate")


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def big(df, *names):
    """Ranks as BIGINT, as the oracle has them."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query("assemble_tables", f"""
select r_name, c_mktsegment, count(*) as n, round(avg(o_totalprice), 4) as avg_price from {VIEW} group by 1, 2""")
def assemble_tables(t):
    return view(t).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("assembly_fallback", """
select name from (select 'orders' as name, count(*) as n from orders union all select 'customer', count(*) from customer
union all select 'lineitem', count(*) from lineitem) order by n desc limit 1""")
def assembly_fallback(t):
    names = ["orders", "customer", "lineitem"]
    catalog = None
    for i, n in enumerate(names):
        one = getattr(t, n).agg(F.lit(n).alias("name"), F.lit(i).alias("position"), F.count("*").alias("row_count"))
        catalog = one if catalog is None else catalog.unionByName(one)
    return joins.largest_table(catalog)


@query("assembly_any_failure", """
select 'joined' as attempt, 'Joined from orders, customer.' as note, count(*) as n from orders join customer on o_custkey = c_custkey
union all select attempt, 'Only orders is used, the largest of 2 tables.', count(*) from orders, (values ('broken'), ('no_rows'), ('no_column')) v(attempt) group by 1""")
def assembly_any_failure(t):
    """A join that works, one that breaks on a row, one without rows and one that names no column: only
    the first is used, for the others the largest table stands in."""
    tables = {"orders": t.orders, "customer": t.customer}
    joined = t.orders.join(t.customer, F.expr("o_custkey = c_custkey"))
    attempts = {"joined": lambda: joined, "broken": lambda: joined.select(F.col("c_mktsegment").cast("int").alias("x")),
                "no_rows": lambda: joined.where("o_totalprice < 0"), "no_column": lambda: joined.select("nowhere")}
    found = [(name, *joins.assembled_or_largest(tables, build)) for name, build in attempts.items()]
    return stats.union_all([df.agg(F.lit(name).alias("attempt"), F.lit(note).alias("note"), F.count("*").alias("n")) for name, df, note in found])


# -- whole-table probes ---------------------------------------------------------

@query("overview", f"""
select count(*) as "rows", cast(9 as bigint) as "columns", round(100.0 * sum(case when tax is null then 1 else 0 end) / (count(*) * 9), 4)
as missing_pct from {LINES}""")
def overview(t):
    return rounded(probes.overview(stats.column_stats(lines(t))), "missing_pct")


@query("missingness", f"""
select * from (select 'tax' as name, count(*) - count(tax) as nulls, round(100.0 * (count(*) - count(tax)) / count(*), 4) as missing_pct from {LINES}
union all select 'tenth', count(*) - count(nullif(l_discount, 0.1)), round(100.0 * (count(*) - count(nullif(l_discount, 0.1))) / count(*), 4) from {LINES})
order by nulls desc""")
def missingness(t):
    df = lines(t).withColumn("tenth", F.nullif("l_discount", F.lit(0.1)))
    return rounded(probes.missingness(stats.column_stats(df)), "missing_pct")


@query("entities", """
select c_name as entity, round(avg(o_totalprice), 6) as value from orders join customer on o_custkey = c_custkey
group by 1 order by avg(o_totalprice) desc, 1 limit 10""")
def entities(t):
    return rounded(probes.entities(joined(t), "c_name", "o_totalprice", "mean"), "value", digits=6)


_LEADERS = """(select o_custkey from orders group by 1 order by sum(o_totalprice) desc, 1 limit 10)"""


@query("leader_contrast", f"""
with x as (select o_custkey in {_LEADERS} as lead, o_totalprice, c_acctbal from {VIEW}),
  m as (select 'o_totalprice' as metric, 0 as p, avg(o_totalprice) filter (where lead) as leaders, avg(o_totalprice) filter (where not lead) as rest from x
        union all select 'c_acctbal', 1, avg(c_acctbal) filter (where lead), avg(c_acctbal) filter (where not lead) from x)
select metric, round(leaders, 4) as leaders, round(rest, 4) as rest, round(abs(leaders - rest) / (abs(rest) + 1e-9), 4) as gap
from m order by abs(leaders - rest) / (abs(rest) + 1e-9) desc, p limit 1""")
def leader_contrast(t):
    df = joined(t)
    top = [r["entity"] for r in probes.entities(t.orders, "o_custkey", "o_totalprice", "sum").collect()]
    return rounded(probes.leader_contrast(df, "o_custkey", top, ["o_totalprice", "c_acctbal"]), "leaders", "rest", "gap")


@query("semi_leaders", f"""
select o_orderpriority, count(*) as n from orders where o_custkey in {_LEADERS} group by 1""")
def semi_leaders(t):
    top = probes.entities(t.orders, "o_custkey", "o_totalprice", "sum").select(F.col("entity").alias("o_custkey"))
    return joins.leader_split(t.orders, top, "o_custkey")[0].groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("anti_leaders", f"""
select o_orderpriority, count(*) as n from orders where o_custkey not in {_LEADERS} group by 1""")
def anti_leaders(t):
    top = probes.entities(t.orders, "o_custkey", "o_totalprice", "sum").select(F.col("entity").alias("o_custkey"))
    return joins.leader_split(t.orders, top, "o_custkey")[1].groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("performance_gap", f"""
select count(revenue - expected_revenue) as n, count(*) filter (where revenue - expected_revenue > 0) as over,
  count(*) filter (where revenue - expected_revenue < 0) as under, round(avg(revenue - expected_revenue), 4) as mean_gap from {LINES}""")
def performance_gap(t):
    return rounded(probes.performance_gap(lines(t), "revenue", "expected_revenue"), "mean_gap")


@query("gap_by_segment", f"""
select l_returnflag as key, round(avg(revenue - expected_revenue), 4) as gap,
  row_number() over (order by avg(revenue - expected_revenue) desc, l_returnflag) as rank, count(*) over () as groups from {LINES} group by 1""")
def gap_by_segment(t):
    return big(rounded(probes.gap_by_segment(lines(t), "l_returnflag", "revenue", "expected_revenue"), "gap"), "rank")


@query("correlations", f"""
with m as (select a, b, r from (""" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from {LINES}"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "tax", "band", "revenue"])
    for b in ["l_quantity", "l_extendedprice", "tax", "band", "revenue"][i + 1:]).replace(LINES, f"(select *, floor(l_extendedprice / 30000) + floor(l_quantity / 25) as band from {LINES})") + """))
select a, b, round(r, 4) as r from m where abs(r) >= 0.3 and abs(r) < 0.985 order by abs(m.r) desc limit 3""")
def correlations(t):
    df = lines(t).withColumn("band", F.floor(F.col("l_extendedprice") / 30000) + F.floor(F.col("l_quantity") / 25))
    return rounded(probes.correlations(df, ["l_quantity", "l_extendedprice", "tax", "band", "revenue"]), "r")


@query("outliers", f"""
with x as (select revenue * revenue * revenue / 1e9 as v from {LINES}), q as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from x)
select count(v) as n, round(q1 - 1.5 * (q3 - q1), 4) as lo, round(q3 + 1.5 * (q3 - q1), 4) as hi,
  count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as outliers from x, q group by q1, q3""")
def outliers(t):
    r = F.col("revenue")
    return rounded(probes.outliers(lines(t).select((r * r * r / 1e9).alias("v")), "v"), "lo", "hi")


@query("distributions", union_sql(["revenue", "l_quantity"], lambda i, c: f"""
select '{c}' as name, min({c}) as min, max({c}) as max, round(avg({c}), 4) as mean, round(median({c}), 4) as median,
  round(skewness({c}), 4) as skew, case when skewness({c}) > 0.5 then 'right' when skewness({c}) < -0.5 then 'left' else 'symmetric' end as shape
from {LINES}"""))
def distributions(t):
    return rounded(probes.distribution(lines(t), ["revenue", "l_quantity"]), "mean", "median", "skew")


def _trend_sql(table, label, at, measure):
    return f"select strftime({label}, '%Y-%m-%d') as period, round(avg({measure}), 4) as value from {table} group by 1"


@query("trends", _trend_sql("lineitem", "last_day(l_shipdate)", "l_shipdate", "l_extendedprice"))
def trends(t):
    return rounded(probes.trends(t.lineitem, "l_shipdate", "l_extendedprice"), "value").withColumn("period", F.col("period").cast("string"))


@query("trends_weekly", _trend_sql("(select * from lineitem where l_shipdate < timestamp '1996-01-01')",
                                   "date_trunc('week', l_shipdate) + interval 6 day", "l_shipdate", "l_quantity"))
def trends_weekly(t):
    year = t.lineitem.where("l_shipdate < timestamp '1996-01-01'")
    return rounded(probes.trends(year, "l_shipdate", "l_quantity"), "value").withColumn("period", F.col("period").cast("string"))


@query("trend_change", """
with p as (select cast(ts as date) as period, avg(value) as value from events group by 1),
  e as (select count(*) as periods, arg_min(value, period) as first, arg_max(value, period) as last from p)
select periods, round(first, 4) as first, round(last, 4) as last, round(100 * (last - first) / (abs(first) + 1e-9), 4) as pct,
  case when 100 * (last - first) / (abs(first) + 1e-9) > 5 then 'up' when 100 * (last - first) / (abs(first) + 1e-9) < -5 then 'down' else 'flat' end as direction from e""")
def trend_change(t):
    return rounded(probes.trend_change(probes.trends(t.events, "ts", "value")), "first", "last", "pct")


_COHORTS = f"""(with q as (select quantile_cont(revenue, 0.25) as q1, quantile_cont(revenue, 0.5) as q2, quantile_cont(revenue, 0.75) as q3 from {LINES}),
  b as (select *, case when revenue <= q1 then 0 when revenue <= q2 then 1 when revenue <= q3 then 2 else 3 end as bucket from {LINES}, q),
  m as (""" + " union all ".join(f"select '{c}' as metric, {i} as position, bucket, avg({c}) as mean from b group by bucket"
                                 for i, c in enumerate(["l_extendedprice", "l_discount", "l_quantity"])) + """)
  select metric, position, bucket, mean, (mean - min(mean) over w) / (max(mean) over w - min(mean) over w + 1e-9) as value from m window w as (partition by metric))"""


@query("cohorts", f"""
select metric, case bucket when 0 then 'Bottom 25%' when 1 then 'Q2' when 2 then 'Q3' else 'Top 25%' end as cohort,
  round(mean, 4) as mean, round(value, 3) as value from {_COHORTS}""")
def cohorts(t):
    means = probes.cohort_means(lines(t), "revenue", ["l_extendedprice", "l_discount", "l_quantity"])
    return means.select("metric", "cohort", F.round("mean", 4).alias("mean"), F.round("value", 3).alias("value"))


@query("cohort_gap", f"""
select metric, round(max(mean) filter (where bucket = 3), 4) as top, round(max(mean) filter (where bucket = 0), 4) as bottom
from {_COHORTS} group by metric order by abs(max(mean) filter (where bucket = 3) - max(mean) filter (where bucket = 0)) desc limit 1""")
def cohort_gap(t):
    means = probes.cohort_means(lines(t), "revenue", ["l_extendedprice", "l_discount", "l_quantity"])
    return rounded(probes.cohort_gap(means), "top", "bottom").select("metric", "top", "bottom")


# -- groupings ------------------------------------------------------------------

_DIMS = ["c_mktsegment", "o_orderpriority", "n_name"]


def _segment_sql(d, top=15):
    return f"""select '{d}' as dimension, key, round(value, 4) as value, rank, groups, round(spread, 4) as spread from (
  select {d} as key, avg(o_totalprice) as value, row_number() over (order by avg(o_totalprice) desc, {d}) as rank, count(*) over () as groups,
  abs(max(avg(o_totalprice)) over () - min(avg(o_totalprice)) over ()) / (abs(avg(avg(o_totalprice)) over ()) + 1e-9) as spread
  from {VIEW} where {d} is not null group by {d}) where rank <= {top}"""


@query("segments", "\nunion all\n".join(_segment_sql(d) for d in _DIMS))
def segments(t):
    facts = probes.group_facts(view(t), [(d,) for d in _DIMS], ["o_totalprice"])
    return big(rounded(probes.segments(facts, _DIMS, "o_totalprice", "mean"), "value", "spread").select(
        "dimension", "key", "value", "rank", "groups", "spread"), "rank")


@query("segments_total", f"""
select l_returnflag as key, round(sum(l_quantity), 2) as value, row_number() over (order by sum(l_quantity) desc, l_returnflag) as rank
from {LINES} group by 1""")
def segments_total(t):
    facts = probes.group_facts(lines(t), [("l_returnflag",)], ["l_quantity"])
    return big(rounded(probes.segments(facts, ["l_returnflag"], "l_quantity", "sum"), "value", digits=2).select("key", "value", "rank"), "rank")


@query("two_way_segments", f"""
select c_mktsegment as k1, o_orderpriority as k2, round(avg(o_totalprice), 4) as value,
  row_number() over (order by round(avg(o_totalprice), 4) desc, c_mktsegment, o_orderpriority) = 1 as peak from {VIEW} group by 1, 2""")
def two_way_segments(t):
    facts = probes.group_facts(joined(t), [("c_mktsegment", "o_orderpriority")], ["o_totalprice"])
    return probes.two_way(facts, "c_mktsegment", "o_orderpriority", "o_totalprice", "mean")


@query("measures_across_dims", "\nunion all\n".join(f"""
select '{d}' as dimension, key, round(a, 4) as a, round(b, 4) as b, rank, groups, round(a / (b + 1e-9), 4) as ratio from (
  select {d} as key, avg(o_totalprice) as a, avg(c_acctbal) as b, row_number() over (order by avg(o_totalprice) desc, {d}) as rank,
  count(*) over () as groups from {VIEW} group by 1) where rank <= 15""" for d in ("c_mktsegment", "n_name")))
def measures_across_dims(t):
    facts = probes.group_facts(joined(t), [("c_mktsegment",), ("n_name",)], ["o_totalprice", "c_acctbal"])
    return big(rounded(probes.measures_across(facts, ["c_mktsegment", "n_name"], "o_totalprice", "c_acctbal"), "a", "b", "ratio"), "rank")


@query("crosstabs", f'select o_orderpriority as k1, o_orderstatus as k2, count(*) as "count" from {VIEW} group by 1, 2')
def crosstabs(t):
    return probes.crosstab(probes.group_facts(t.orders, [("o_orderpriority", "o_orderstatus")]), "o_orderpriority", "o_orderstatus")


@query("categories", "\nunion all\n".join(f"""
select * from (select '{d}' as dimension, {d} as value, count(*) as "count", row_number() over (order by count(*) desc, {d}) as rank,
  round(100.0 * count(*) / sum(count(*)) over (), 4) as share, count(*) over () as k,
  case when count(*) over () <= 4 then 'donut' when count(*) over () <= 6 then 'pie' else 'bar' end as chart from part group by 2)
  where rank <= 12""" for d in ("p_brand", "p_type")))
def categories(t):
    facts = probes.group_facts(t.part, [("p_brand",), ("p_type",)])
    return big(rounded(probes.categories(facts, ["p_brand", "p_type"]), "share"), "rank")


# -- rows in scope ----------------------------------------------------------------

@query("scope_filter", f"""
select c_mktsegment, count(*) as n from {VIEW} where lower(trim(c_mktsegment)) in ('building', 'machinery') group by 1""")
def scope_filter(t):
    scope = {"column": "c_mktsegment", "include": [" Building", "MACHINERY"], "reason": "industrial customers."}
    return probes.scope_filter(joined(t), scope)[0].groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("scope_fail_open", "select o_orderstatus, count(*) as n from orders group by 1")
def scope_fail_open(t):
    """No row matches, so the scope is ignored."""
    scope = {"column": "o_orderstatus", "include": ["shipped"], "reason": ""}
    return probes.scope_filter(t.orders, scope)[0].groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("collapse_entity", """
select o_custkey, round(avg(o_totalprice), 6) as o_totalprice, min(o_orderpriority) as o_orderpriority, round(avg(o_orderkey), 6) as o_orderkey
from orders group by 1""")
def collapse_entity(t):
    df = t.orders.select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderkey")
    return rounded(probes.collapse_entity(df, "o_custkey"), "o_totalprice", "o_orderkey", digits=6)


# -- column choice ------------------------------------------------------------------

_GOALS = """(select event_id, case event_id % 4 when 0 then 'Which event_type has the highest Value?'
  when 1 then 'errors per user over time' when 2 then 'Profile the props, ' || event_type else 'user_id and type' end as goal from events)"""


def goals(t):
    i = F.col("event_id")
    return t.events.select(i, F.when(i % 4 == 0, "Which event_type has the highest Value?")
                           .when(i % 4 == 1, "errors per user over time")
                           .when(i % 4 == 2, F.concat(F.lit("Profile the props, "), "event_type"))
                           .otherwise("user_id and type").alias("goal"))


@query("focus_columns", f"""
with n as (select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as name),
  tok as (select name, unnest(regexp_split_to_array(name, '[^a-z0-9]+')) as tok from n),
  g as (select distinct goal from {_GOALS}),
  hit as (select g.goal, n.name, contains(lower(g.goal), n.name) as whole,
    (select count(*) from tok where tok.name = n.name and length(tok.tok) >= 3
       and regexp_matches(lower(g.goal), '\\b' || tok.tok || '\\b')) as goal_match from g, n)
select x.goal, h.name, count(*) as asked from {_GOALS} x join hit h on h.goal = x.goal where whole or goal_match > 0 group by 1, 2""")
def focus_columns(t):
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return columns.focus_columns(goals(t), names).groupBy("goal", "name").agg(F.count("*").alias("asked"))


@query("goal_match", f"""
select event_id, cast(case event_id % 4 when 1 then 1 else 0 end as bigint) as user_tokens,
  cast(case event_id % 4 when 0 then 0 when 3 then 1 else 0 end as bigint) as type_tokens from {_GOALS}""")
def goal_match(t):
    g = F.col("goal")
    return goals(t).select("event_id", text.tokens_in_goal(F.lit("user_id"), g).cast("bigint").alias("user_tokens"),
                           text.tokens_in_goal(F.lit("Event Type"), g).cast("bigint").alias("type_tokens"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("measure_order", "select name, row_number() over (order by focus desc, hits desc, spread desc) as place from (" + union_sql(
    _MEASURES, lambda i, c: f"select '{c}' as name, {int(c in ('l_discount', 'l_quantity'))} as focus, {int(c in ('l_discount', 'l_quantity'))} as hits, "
    f"stddev_samp({c}) / (abs(avg({c})) + 1e-9) as spread from lineitem") + ")")
def measure_order(t):
    facts = analysis.column_facts(t.lineitem.select(*_MEASURES))
    names = columns.measure_order(facts, "quantity sold at each discount")
    return t.spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, place bigint")


@query("segment_eligible", """
select name, distinct_count from (""" + union_sql(["p_name", "p_brand", "p_type", "p_size"], lambda i, c:
       f"select '{c}' as name, count(distinct {c}) as distinct_count from part") + """)
where distinct_count between 2 and (case when name = 'p_brand' then 60 else 12 end)""")
def segment_eligible(t):
    facts = analysis.column_facts(t.part.select("p_name", "p_brand", "p_type", "p_size"))
    kept = [(c.name, c.distinct) for c in facts if columns.segment_eligible(c, {"p_brand"}, set(), None)]
    return t.spark.createDataFrame(kept, "name string, distinct_count bigint")


@query("exclude_ids", """
select name from (""" + union_sql(["o_orderkey", "o_custkey"], lambda i, c:
       f"select '{c}' as name, count(distinct {c}) * 1.0 / count(*) as ratio from orders") + """) where ratio <= 0.9 union all select 'o_totalprice'""")
def exclude_ids(t):
    facts = analysis.column_facts(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))
    rows = max(c.n + c.nulls for c in facts)
    return t.spark.createDataFrame([(c.name,) for c in facts if not columns.is_identifier(c, rows)], "name string")


_CLAIMS = """(select event_id, case event_id % 4 when 0 then '`' || event_type || '`' when 1 then 'events.user_id'
  when 2 then ' `VALUE`' else 'props.k' end as claim from events)"""


@query("ground_columns", f"""
select claim, count(*) as n from {_CLAIMS} where event_id % 4 in (1, 2) group by 1""")
def ground_columns(t):
    i = F.col("event_id")
    claims = t.events.select(F.when(i % 4 == 0, F.concat(F.lit("`"), "event_type", F.lit("`"))).when(i % 4 == 1, "events.user_id")
                             .when(i % 4 == 2, " `VALUE`").otherwise("props.k").alias("claim"))
    return columns.ground_columns(claims, "claim", t.events.columns).groupBy("claim").agg(F.count("*").alias("n"))


@query("agg_choice", """
select 'window_qty' as name, 'sum' as agg union all select 'late', case when avg(cast(l_discount > 0.05 as int)) < 1.5 then 'sum' else 'mean' end from lineitem
union all select 'l_tax', 'mean' union all select 'l_linenumber', 'sum'""")
def agg_choice(t):
    df = t.lineitem.select(F.col("l_quantity").alias("window_qty"), (F.col("l_discount") > 0.05).cast("int").alias("late"), "l_tax", "l_linenumber")
    return columns.agg_choice_table(stats.column_stats(df))


@query("entity_column", """
select case when (select count(distinct c_name) from customer) >= 5 then 'c_name' end as entity, count(*) as "rows" from customer""")
def entity_column(t):
    facts = analysis.column_facts(t.customer)
    n = facts[0].n
    return t.spark.createDataFrame([(columns.entity_column(t.spark, facts, n, set()), n)], "entity string, rows bigint")


@query("rank_measure", """
select 'c_acctbal_score' as measure, round(max(c_acctbal), 2) as best from customer""")
def rank_measure(t):
    df = t.customer.select("c_nationkey", F.col("c_acctbal").alias("c_acctbal_score"), (F.col("c_acctbal") * 2).alias("total_value"))
    facts = analysis.column_facts(df)
    picked = columns.rank_measure(columns.measure_order(facts, ""), set(), [])
    return df.agg(F.lit(picked).alias("measure"), F.round(F.max(picked), 2).alias("best"))


_IDEA_TABLES = ["orders", "customer", "part", "documents"]
# numeric and other columns of those tables, in column order
_SHAPE = {"orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate"]),
          "customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
          "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand"]),
          "documents": (["doc_id", "n_chars"], ["text", "lang"])}


def _idea_sql():
    """Which ideas fit is decided from the tables' own columns, as DuckDB sees them."""
    numeric = "data_type in ('BIGINT', 'INTEGER', 'DOUBLE')"
    return f"""
with c as (select table_name as "table", column_name as name, {numeric} as num, column_index as i from duckdb_columns()
  where table_name in ({", ".join(f"'{n}'" for n in _IDEA_TABLES)}) and internal = false),
  k as (select "table", list(name order by i) filter (num) as n, list(name order by i) filter (not num) as c from c group by 1),
  s as (select "table", unnest([
    {{'at': 0, 'fits': len(n) >= 1 and len(c) >= 1, 'title': n[1] || ' by ' || c[1]}}, {{'at': 1, 'fits': len(n) >= 3, 'title': 'What goes along with ' || n[1]}},
    {{'at': 2, 'fits': len(n) >= 1, 'title': 'Both ends of ' || n[1]}}, {{'at': 3, 'fits': len(c) >= 2, 'title': c[1] || ' and ' || c[2] || ' together'}},
    {{'at': 4, 'fits': len(n) >= 2 and len(c) >= 1, 'title': n[1] || ' and ' || n[2] || ' within each ' || c[1]}}, {{'at': 5, 'fits': true, 'title': 'Gaps and odd values'}}]) as x from k)
select "table", position, title from (select "table", row_number() over (partition by "table" order by x.at)::integer as position, x.title as title from s where x.fits)
where position <= 5"""


@query("idea_table", _idea_sql())
def idea_table(t):
    profiles = profile.profile_tables({n: getattr(t, n) for n in _IDEA_TABLES}, samples=False)
    return columns.idea_table(profiles).select("table", "position", "title")


# -- findings ----------------------------------------------------------------------

_KINDS = ["entity", "performance", "correlation", "segment", "cohort", "category", "trend", "quality"]
_FINDINGS = f"""(select g as seq, 'f' || g as id, (['{"', '".join(_KINDS)}'])[g % 8 + 1] as kind,
  'Group ' || g || ' of ' || o_orderstatus || ' holds ' || n || ' orders, none missing' as text,
  round(0.3 + 40.0 * n / (select count(*) from orders), 4) as importance, [o_orderstatus, 'c' || (g % 5)] as columns,
  case when g % 3 > 0 then 'c' || (g % 25) end as chart_id
  from (select o_custkey % 40 * 3 + case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as g, o_orderstatus, count(*) as n from orders group by 1, 2))"""


def raw_findings(t):
    g = F.col("o_custkey") % 40 * 3 + F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    per = t.orders.groupBy(g.alias("g"), "o_orderstatus").agg(F.count("*").alias("n"))
    total = t.orders.agg(F.count("*")).scalar()
    gs = F.col("g").cast("string")
    return per.select(
        F.col("g").alias("seq"), F.concat(F.lit("f"), gs).alias("id"),
        F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("g") % 8 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("Group "), gs, F.lit(" of "), "o_orderstatus", F.lit(" holds "), F.col("n").cast("string"), F.lit(" orders, none missing")).alias("text"),
        F.round(0.3 + 40.0 * F.col("n") / total, 4).alias("importance"),
        F.array(F.col("o_orderstatus"), F.concat(F.lit("c"), (F.col("g") % 5).cast("string"))).alias("columns"),
        F.when(F.col("g") % 3 > 0, F.concat(F.lit("c"), (F.col("g") % 25).cast("string"))).alias("chart_id"))


_RANKED = f"""(with f as (select * replace (importance + case when list_contains(columns, 'P') or list_contains(columns, 'c3') then 0.45 else 0 end as importance) from {_FINDINGS}),
  r as (select *, row_number() over (order by importance desc, seq) as rank from f qualify rank <= 18),
  c as (select chart_id as cid, row_number() over (order by min(rank)) as place from r where chart_id is not null group by 1)
  select r.* replace (case when c.place <= 14 then chart_id end as chart_id) from r left join c on c.cid = r.chart_id)"""


def ranked(t):
    return findings.rank_findings(raw_findings(t), ["P", "c3"])


@query("rank_findings", f"select rank, id, kind, round(importance, 4) as importance, chart_id from {_RANKED}")
def rank_findings(t):
    return big(rounded(ranked(t), "importance").select("rank", "id", "kind", "importance", "chart_id"), "rank")


@query("section_plan", f"""
with s as (select case kind {' '.join(f"when '{k}' then {i}" for i, (_, ks) in enumerate(findings.SECTIONS) for k in ks)} end as section, * from {_RANKED})
select row_number() over (order by section) as position, ([{', '.join("'" + x + "'" for x, _ in findings.SECTIONS)}])[section + 1] as title,
  string_agg(id, ',' order by rank) as finding_ids, coalesce(string_agg(chart_id, ',' order by rank), '') as chart_ids from s group by section order by section limit 4""")
def section_plan(t):
    return big(findings.section_plan(ranked(t)).select("position", "title", F.array_join("finding_ids", ",").alias("finding_ids"),
                                                   F.array_join("chart_ids", ",").alias("chart_ids")), "position")


_PLAN = f"""(select position, case when position = 3 then '  ' else ' Part ' || position || ' ' end as title, ids from (
  select seq // 15 + 1 as position, list('f' || (seq * 2 % 130) order by seq) as ids from {_FINDINGS} group by 1))"""


@query("plan_check", f"""
with titled as (select *, row_number() over (order by position) as n from {_PLAN} where trim(title) <> ''),
  i as (select n, position, trim(title) as title, unnest(ids) as id, generate_subscripts(ids, 1) as pos from titled),
  v as (select * from i where id in (select id from {_FINDINGS})),
  o as (select *, min(n) over (partition by id) as own from v)
select position, title, string_agg(id, ',' order by pos) as finding_ids, cast(count(*) as bigint) as kept from o where own = n and n <= 6 group by 1, 2""")
def plan_check(t):
    f = raw_findings(t)
    seq = F.col("seq")
    ids = F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit("f"), (seq * 2 % 130).cast("string")).alias("id"))))
    plan = f.groupBy((F.floor(seq / 15) + 1).alias("position")).agg(ids.alias("i")).select(
        "position", F.when(F.col("position") == 3, "  ").otherwise(F.concat(F.lit(" Part "), F.col("position").cast("string"), F.lit(" "))).alias("title"),
        F.transform("i", lambda x: x["id"]).alias("finding_ids"), F.array(F.lit("c1")).alias("chart_ids"))
    charts_ = f.where("chart_id is not null").select(F.col("chart_id").alias("id"))
    return findings.plan_check(plan, f, charts_).select(
        "position", "title", F.array_join("finding_ids", ",").alias("finding_ids"), F.size("finding_ids").cast("bigint").alias("kept"))


@query("finding_lookup", f"""
with q as (select o_orderkey as request, ['f' || (o_orderkey % 120), 'f' || (o_orderkey % 7), 'f999'] as ids from orders)
select f.id, p.position, count(*) as asked, max(f.importance) as importance from (select request, unnest(ids) as id, generate_subscripts(ids, 1) - 1 as position from q) p
join {_FINDINGS} f on f.id = p.id group by 1, 2""")
def finding_lookup(t):
    k = F.col("o_orderkey")
    name = lambda n: F.concat(F.lit("f"), (k % n).cast("string"))
    requests = t.orders.select(k.alias("request"), F.array(name(120), name(7), F.lit("f999")).alias("ids"))
    return big(findings.finding_lookup(requests, raw_findings(t)).groupBy("id", "position").agg(
        F.count("*").alias("asked"), F.max("importance").alias("importance")), "position")


@query("top_chart", f"select arg_min(chart_id, rank) as chart_id from {_RANKED} where chart_id is not null")
def top_chart(t):
    return findings.top_chart(ranked(t))


@query("default_summary", f"select string_agg(text, ' ' order by rank) as summary from {_RANKED} where rank <= 2")
def default_summary(t):
    return findings.default_summary(ranked(t))


@query("default_recs", f"""
select row_number() over (order by p) - 1 as position, advice from (
  select 1 as p, '{findings.MISSING_ADVICE}' as advice from {_RANKED} where kind = 'quality' and contains(text, 'missing') limit 1)
union all select (select count(*) > 0 from {_RANKED} where kind = 'quality' and contains(text, 'missing'))::bigint, '{findings.DRIVER_ADVICE}'
where (select count(*) from {_RANKED} where kind = 'correlation') > 0""")
def default_recs(t):
    return findings.default_recommendations(ranked(t)).withColumn("position", F.col("position").cast("bigint"))


def _analysis_sql():
    """The findings the goal below must lead to, in probe order. Only the segment
    spreads depend on the data; the other weights are fixed by kind."""
    dims, focus = ["c_mktsegment", "o_orderpriority", "r_name"], 0.45
    rows, seq = [], 0

    def add(kind, weight, cols):
        nonlocal seq
        seq += 1
        rows.append(f"select {seq} as seq, '{kind}' as kind, {weight} as importance, '{'|'.join(cols)}' as columns")

    add("overview", 0.25, [])
    add("quality", 0.3, [])
    add("entity", 1.05 + focus, ["c_name", "c_acctbal"])
    add("entity", 0.9 + focus, ["c_name", "c_acctbal"])
    add("segment", 0.95 + focus, ["c_mktsegment", "c_acctbal", "o_totalprice"])
    for measure, agg in (("c_acctbal", "avg"), ("o_totalprice", "sum")):
        for d in dims:
            spread = (f"(select (max(v) - min(v)) / (abs(avg(v)) + 1e-9) from (select {agg}({measure}) as v from {VIEW} group by {d}))")
            add("segment", f"0.45 + least({spread}, 1.0) * 0.4 + {focus}", [d, measure])
    add("segment", 0.72 + focus, ["c_mktsegment", "o_orderpriority", "c_acctbal"])
    add("cohort", 0.78 + focus, ["c_acctbal", "o_totalprice"])
    add("crosstab", 0.5 + focus, ["c_mktsegment", "o_orderpriority"])
    add("category", 0.3 + focus, ["c_mktsegment"])
    add("category", 0.3, ["o_orderpriority"])
    add("category", 0.3, ["r_name"])
    add("distribution", 0.32 + focus, ["c_acctbal"])
    add("distribution", 0.32 + focus, ["o_totalprice"])
    add("trend", 0.7 + focus, ["o_orderdate", "c_acctbal"])
    return ("select row_number() over (order by importance desc, seq) as rank, kind, round(importance, 4) as importance, columns from ("
            + " union all ".join(rows) + ") qualify rank <= 18")


@query("analyze", _analysis_sql())
def analyze(t):
    """The whole battery over the assembled view."""
    goal = "Compare totalprice against acctbal by mktsegment"
    out = analysis.analyze(view(t), goal, Spec(entity_column="c_name", segment_dimensions=["c_mktsegment", "o_orderpriority", "r_name"]))
    return big(out.findings.select("rank", "kind", F.round("importance", 4).alias("importance"), F.array_join("columns", "|").alias("columns")), "rank")


# -- signals ---------------------------------------------------------------------------

@query("signal_correlations", f"""
select * from (""" + " union all ".join(
    f"select 'correlation' as kind, '{a}' as a, '{b}' as b, round(abs(corr({a}, {b})), 4) as score from {LINES}"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "tax", "revenue"])
    for b in ["l_quantity", "l_extendedprice", "tax", "revenue"][i + 1:]) + """) where score >= 0.4 order by score desc limit 4""")
def signal_correlations(t):
    out = signals.correlation_signals(lines(t), ["l_quantity", "l_extendedprice", "tax", "revenue"])
    return out.select("kind", F.get("columns", F.lit(0)).alias("a"), F.get("columns", F.lit(1)).alias("b"), F.round("score", 4).alias("score"))


_BOOSTED = "(select event_type, user_id % 3 as tier, case when event_type = 'purchase' then value * 4 else value end as amount, case when event_type = 'error' then -10 * value else value end as swing from events)"


def boosted(t):
    v, e = F.col("value"), F.col("event_type")
    return t.events.select("event_type", (F.col("user_id") % 3).cast("string").alias("tier"),
                           F.when(e == "purchase", v * 4).otherwise(v).alias("amount"), F.when(e == "error", v * -10).otherwise(v).alias("swing"))


@query("signal_contrasts", f"""
with m as (select 'amount' as num, event_type, avg(amount) as mean from {_BOOSTED} group by 2 union all
           select 'swing', event_type, avg(swing) from {_BOOSTED} group by 2),
  x as (select num, max(mean) as hi, min(mean) as lo, arg_max(event_type, mean) as hi_group, arg_min(event_type, mean) as lo_group from m group by 1),
  s as (select 'amount' as num, stddev_samp(amount) as std from {_BOOSTED} union all select 'swing', stddev_samp(swing) from {_BOOSTED})
select num, 'event_type' as cat, round(case when lo > 0 then hi / lo else (hi - lo) / std end, 4) as score from x join s using (num)
where case when lo > 0 then hi / lo >= 1.5 else (hi - lo) / std >= 1.0 end""")
def signal_contrasts(t):
    return signals.contrast_signals(boosted(t), ["event_type", "tier"], ["amount", "swing"]).select(
        F.get("columns", F.lit(0)).alias("num"), F.get("columns", F.lit(1)).alias("cat"), F.round("score", 4).alias("score"))


@query("signal_time_columns", "select 'o_orderdate' as name, count(o_orderdate) as n from orders")
def signal_time_columns(t):
    names = signals.time_signals(t.orders).first()["columns"]
    return t.orders.agg(F.lit(names[0]).alias("name"), F.count(names[0]).alias("n"))


@query("signal_skews", """
select 'cubed' as name, round(abs(skewness(pow(value, 6))), 4) as score from events where (select abs(skewness(pow(value, 6))) from events) >= 2 limit 1""")
def signal_skews(t):
    df = t.events.select("value", F.pow("value", F.lit(6)).alias("cubed"))
    return signals.skew_signals(df, ["value", "cubed"]).select(F.get("columns", F.lit(0)).alias("name"), F.round("score", 4).alias("score"))


def _digest_sql():
    """Every pair, split and column of three tables, with the same thresholds."""
    tables = {"lines": (LINES, ["l_quantity", "l_extendedprice", "l_discount", "tax", "revenue", "expected_revenue"], ["l_returnflag", "l_linestatus"], "l_shipdate"),
              "boosted": (_BOOSTED, ["amount", "swing"], ["event_type", "tier"], None),
              "orders": ("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")}
    out = []
    for name, (sql, nums, cats, time) in tables.items():
        pairs = [f"select '{a}|{b}' as columns, abs(corr({a}, {b})) as score from {sql}" for i, a in enumerate(nums) for b in nums[i + 1:]]
        out.append(f"select * from (select '{name}' as \"table\", 'correlation' as kind, columns, score from ({' union all '.join(pairs)}) where score >= 0.4 order by score desc limit 4)")
        splits = [f"""select '{n}|{c}' as columns, case when min(m) > 0 then case when max(m) / min(m) >= 1.5 then max(m) / min(m) end
          else case when (max(m) - min(m)) / (select stddev_samp({n}) from {sql}) >= 1.0 then (max(m) - min(m)) / (select stddev_samp({n}) from {sql}) end end as score
          from (select avg({n}) as m from {sql} group by {c})""" for c in cats for n in nums]
        out.append(f"select * from (select '{name}', 'contrast', columns, score from ({' union all '.join(splits)}) where score is not null order by score desc limit 4)")
        if time:
            out.append(f"select '{name}', 'time', '{time}', 1.0")
        skews = [f"select '{n}' as columns, abs(skewness({n})) as score from {sql}" for n in nums]
        out.append(f"select * from (select '{name}', 'skew', columns, score from ({' union all '.join(skews)}) where score >= 2.0 order by score desc limit 4)")
    return 'select "table", kind, columns, round(score, 4) as score from (' + " union all ".join(out) + ")"


@query("signal_digest", _digest_sql())
def signal_digest(t):
    return signals.signal_digest({"lines": lines(t), "boosted": boosted(t), "orders": t.orders}).select(
        "table", "kind", F.array_join("columns", "|").alias("columns"), F.round("score", 4).alias("score"))


# -- chart data ---------------------------------------------------------------------------

@query("chart_agg", """
select nullif(o_orderstatus, 'P') as o_orderstatus, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, count(o_totalprice) as "count",
  min(o_totalprice) as low, max(o_totalprice) as high, round(median(o_totalprice), 4) as mid from orders group by 1""")
def chart_agg(t):
    """Every aggregate a chart can ask for; the missing group is kept."""
    df = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice")
    wanted = {"total": "sum", "mean": "Average", "count": "count", "low": "min", "high": "max", "mid": "median"}
    return df.groupBy("o_orderstatus").agg(*[
        (F.round(charts.aggregate_expr(charts.normal_aggregate(a), F.col("o_totalprice")), 2 if n == "total" else 4)).alias(n)
        for n, a in wanted.items()])


@query("chart_median", """
select l_returnflag, median(l_extendedprice) as l_extendedprice, median(l_quantity) as l_quantity,
  median(nullif(l_discount, 0.05)) as discount from lineitem group by 1""")
def chart_median(t):
    """Medians of groups of which one holds half of all rows: found by brackets and shared counts."""
    df = t.lineitem.select("l_returnflag", "l_extendedprice", "l_quantity", F.nullif("l_discount", F.lit(0.05)).alias("discount"))
    return stats.grouped_medians(df, ["l_returnflag"], ["l_extendedprice", "l_quantity", "discount"], small=5_000)


_COUNTS = "(select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2)"


def counts(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


_WIDE = f"""select o_orderpriority, max(n) filter (where o_orderstatus = 'F') as "F", max(n) filter (where o_orderstatus = 'O') as "O",
  max(n) filter (where o_orderstatus = 'P') as "P" from {_COUNTS} group by 1"""


@query("pivot_series", _WIDE)
def pivot_series(t):
    return charts.pivot_series(counts(t), "o_orderpriority", "o_orderstatus", "n")


def _tall(chart):
    """A chart with series as rows: x, series, value, and how the series is drawn."""
    drawn = F.array(*[F.struct(F.lit(e["key"]).alias("series"), F.col(e["key"]).alias("value"), F.lit(e["mark"]).alias("mark"),
                               F.lit(e["axis"]).alias("axis"), F.lit(e["stack"]).alias("stack"), F.lit(e["render"]).alias("render")) for e in chart.encoding()])
    return chart.data.select(F.col(chart.xKey).alias("x"), F.inline(drawn))


def _tall_sql(mark, stack, render, pairs):
    stack = f"'{stack}'" if stack else "cast(null as varchar)"
    return f"""select x, series, n as value, '{mark}' as mark, 'left' as axis, {stack} as stack, '{render}' as render from ({pairs})"""


def _register_series(name, mark, stack, render):
    pairs = f"""select p.x, s.series, n from (select distinct o_orderpriority as x from orders) p cross join (select distinct o_orderstatus as series from orders) s
      left join {_COUNTS} c on c.o_orderpriority = p.x and c.o_orderstatus = s.series"""

    @query(name, _tall_sql(mark, stack, render, pairs))
    def build(t):
        return _tall(charts.build_chart(name, counts(t), "o_orderpriority", "n", series="o_orderstatus"))


for _row in (("grouped_bar", "bar", None, "cartesian"), ("stacked_bar", "bar", "stack", "cartesian"), ("multi_line", "line", None, "cartesian"),
             ("stacked_area", "area", "stack", "cartesian"), ("radar", "radar", None, "radar")):
    _register_series(*_row)


def _register_single(name, mark, render, aggregate, sql):
    """Each chart type with an aggregate of its own."""
    made = f"select o_orderpriority as x, 'o_totalprice' as series, {sql} as n from orders group by 1"

    @query(name, _tall_sql(mark, None, render, made))
    def build(t):
        out = _tall(charts.build_chart(name, t.orders, "o_orderpriority", "o_totalprice", aggregate=aggregate))
        return out.withColumn("value", F.round("value", 2)) if aggregate in ("sum", "mean", "median") else out


for _row in (("bar", "bar", "cartesian", "count", "count(o_totalprice)"), ("line", "line", "cartesian", "mean", "round(avg(o_totalprice), 2)"),
             ("area", "area", "cartesian", "max", "max(o_totalprice)"), ("pie", "pie", "pie", "sum", "round(sum(o_totalprice), 2)"),
             ("donut", "pie", "pie", "min", "min(o_totalprice)")):
    _register_single(*_row)


@query("dual_axis", """
select l_returnflag, round(avg(l_quantity), 4) as l_quantity, round(avg(l_discount), 4) as l_discount from lineitem group by 1""")
def dual_axis(t):
    made = charts.build_chart("dual_axis", t.lineitem, "l_returnflag", "l_quantity", y2="l_discount", aggregate="avg")
    return rounded(made.data, "l_quantity", "l_discount")


@query("scatter", "select o_totalprice, o_orderkey, o_orderstatus from orders")
def scatter(t):
    df = t.orders.select("o_totalprice", "o_orderkey", "o_orderstatus")
    return charts.build_chart("scatter", df, "o_totalprice", "o_orderkey", series="o_orderstatus").data


@query("scatter_sample", """
select l_quantity, l_extendedprice, l_orderkey from lineitem
order by md5('0|' || printf('%.6f', l_quantity) || '|' || printf('%.6f', l_extendedprice) || '|' || l_orderkey), l_quantity, l_extendedprice, l_orderkey limit 2000""")
def scatter_sample(t):
    """A sampling operator: its own limit of 2000 points is the feature."""
    return charts.point_sample(t.lineitem, ["l_quantity", "l_extendedprice", "l_orderkey"], ["l_quantity", "l_extendedprice"])


_EDGES = """(select unnest(generate_series(0, 11)) as position, min(x) as mn, max(x) as mx from {v})"""


@query("histogram", """
with v as (select l_extendedprice as x from lineitem), e as (select min(x) as mn, max(x) as mx, (max(x) - min(x)) / 12 as step from v),
  b as (select cast(position as bigint) as position, case when position = 0 then mn - 0.001 * (mx - mn) else mn + step * position end as lo,
    case when position = 11 then mx else mn + step * (position + 1) end as hi from e, (select unnest(generate_series(0, 11)) as position))
select position, round(lo, 4) as lo, round(hi, 4) as hi, format('{:.4g}–{:.4g}', lo, hi) as bin,
  (select count(*) from v where x > b.lo and x <= b.hi) as "count" from b""")
def histogram(t):
    return rounded(charts.histogram(t.lineitem, "l_extendedprice"), "lo", "hi").withColumn("position", F.col("position").cast("bigint"))


@query("hist_sample", """
with v as (select l_quantity as x from lineitem), e as (select min(x) as mn, (max(x) - min(x)) / 12 as step from v)
select cast(greatest(ceil((x - mn) / step), 1) - 1 as bigint) as position, count(*) as "count" from v, e group by 1""")
def hist_sample(t):
    """The histogram bins every value, so no sample is drawn."""
    return charts.histogram(t.lineitem, "l_quantity").select(F.col("position").cast("bigint").alias("position"), "count").where("count > 0")


@query("x_type", """
select 'o_orderdate' as name, 'time' as x_type, count(*) as n from orders union all select 'o_totalprice', 'number', count(*) from orders
union all select 'o_orderpriority', 'category', count(*) from orders union all select 'day', 'time', count(*) from orders""")
def x_type(t):
    df = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    kinds = [(c, charts.x_type(df, c)) for c in ("o_orderdate", "o_totalprice", "o_orderpriority", "day")]
    return df.agg(F.count("*").alias("n")).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(k).alias("x_type"), F.col("n").alias("n")) for c, k in kinds])))


@query("chart_from_sql", """
select l_returnflag, l_linestatus as series, round(sum(l_quantity), 2) as value from lineitem where l_discount > 0.01 group by all""")
def chart_from_sql(t):
    """The statement keeps single rows, and the chart sums all of them."""
    made = charts.chart_from_sql(t.lineitem, "SELECT l_returnflag, l_linestatus, l_quantity FROM data WHERE l_discount > 0.01",
                                 "stacked_bar", "l_returnflag", "l_quantity", series="l_linestatus", aggregate="sum")
    return _tall(made).where("value is not null").select(F.col("x").alias("l_returnflag"), "series", F.round("value", 2).alias("value"))
