"""SQL-surface queries: every relational form a guarded SELECT can reach, written
with the DataFrame API (and through the guard where the guard is the feature)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, ordered, sqlguard
from .registry import query


def dec(c, scale=2):
    """Money is summed as DECIMAL so that row order cannot change the result."""
    return F.col(c).cast(f"decimal(18,{scale})")


@query("sql_group_order", """
select l_returnflag, l_linestatus, count(*) as n,
       cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty,
       round(avg(l_extendedprice), 2) as avg_price
from lineitem group by l_returnflag, l_linestatus order by 1, 2""")
def sql_group_order(t):
    return (t.lineitem.groupBy("l_returnflag", "l_linestatus")
            .agg(F.count("*").alias("n"), F.sum(dec("l_quantity")).cast("double").alias("sum_qty"),
                 F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))
            .orderBy("l_returnflag", "l_linestatus"))


@query("run_sql", """
with a as (select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as dearest from orders group by all order by n desc, o_orderstatus, o_orderpriority limit 7)
select *, true as truncated from a""")
def run_sql(t):
    """The guarded text form; the row cap is the operator's own feature, and so is the flag
    that tells of more rows."""
    out = sqlguard.run_sql(t.orders, """
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS dearest FROM data
        GROUP BY ALL ORDER BY n DESC, o_orderstatus, o_orderpriority;""", max_rows=7)
    return t.spark.createDataFrame([(*r.values(), out.truncated) for r in out.rows],
                                   "o_orderstatus string, o_orderpriority string, n bigint, dearest double, truncated boolean")


@query("query_tables", """
select r_name, count(*) as customers, round(avg(c_acctbal), 2) as avg_balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by r_name""")
def query_tables(t):
    return sqlguard.query_tables(
        {"customer": t.customer, "nation": t.nation, "region": t.region}, """
        SELECT r_name, COUNT(*) AS customers, ROUND(AVG(c_acctbal), 2) AS avg_balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")


_STATEMENTS_SQL = """
select event_type, verb, accepted, count(*) as n from (
  select event_type, verb, verb in ('SELECT', 'WITH', 'SELECT ''copy; drop'' AS y, x.* FROM') as accepted from (
    select event_type, case event_id % 6 when 0 then 'SELECT' when 1 then 'DROP' when 2 then 'WITH'
      when 3 then 'CREATE' when 4 then 'SELECT ''copy; drop'' AS y, x.* FROM' else 'PRAGMA' end as verb from events) a) b
group by event_type, verb, accepted"""


@query("validate_select", _STATEMENTS_SQL)
def validate_select(t):
    """The guard over a column of statements, as used on a log of questions."""
    verbs = ["SELECT", "DROP", "WITH", "CREATE", "SELECT 'copy; drop' AS y, x.* FROM", "PRAGMA"]
    verb = F.element_at(F.array(*[F.lit(v) for v in verbs]), (F.col("event_id") % 6 + 1).cast("int"))
    logged = t.events.select("event_type", verb.alias("verb")).withColumn(
        "statement", F.concat("verb", F.lit(" x AS (SELECT 1 AS a) SELECT a FROM x")))
    return (logged.withColumn("accepted", sqlguard.is_read_only(F.col("statement")))
            .groupBy("event_type", "verb", "accepted").agg(F.count("*").alias("n")))


@query("sql_cte", """
with big as (select o_custkey, o_totalprice from orders where o_totalprice > 250000),
     per as (select o_custkey, count(*) as n from big group by o_custkey)
select n as orders_per_customer, count(*) as customers from per group by n""")
def sql_cte(t):
    per = t.orders.where("o_totalprice > 250000").groupBy("o_custkey").count()
    return per.groupBy(F.col("count").alias("orders_per_customer")).agg(F.count("*").alias("customers"))


@query("sql_filter_having", """
select l_suppkey, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty
from lineitem where l_discount >= 0.05 and l_shipdate >= timestamp '1996-01-01'
group by l_suppkey having sum(l_quantity) > 2000""")
def sql_filter_having(t):
    return (t.lineitem.where((F.col("l_discount") >= 0.05) & (F.col("l_shipdate") >= "1996-01-01"))
            .groupBy("l_suppkey").agg(F.count("*").alias("n"),
                                      F.sum(dec("l_quantity")).cast("double").alias("qty"))
            .where("qty > 2000"))


@query("inner_join", """
select n_name, count(*) as orders from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey group by n_name""")
def inner_join(t):
    return (t.orders.select("o_custkey").join(t.customer.select("c_custkey", "c_nationkey"),
                                              F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.count("*").alias("orders")))


@query("sql_inner_join", """
select p_brand, count(*) as lines, round(avg(l_extendedprice), 2) as avg_price
from lineitem join part on l_partkey = p_partkey where p_size < 20 group by p_brand""")
def sql_inner_join(t):
    part = t.part.where("p_size < 20").select("p_partkey", "p_brand")
    return (t.lineitem.select("l_partkey", "l_extendedprice").join(part, F.expr("l_partkey = p_partkey"))
            .groupBy("p_brand").agg(F.count("*").alias("lines"),
                                    F.round(F.avg("l_extendedprice"), 2).alias("avg_price")))


@query("sql_left_join", """
select d.lang, count(*) as docs, count(l.doc_id) as labelled, count(l.quality) filter (where l.quality = 1) as good
from documents d left join labels l on d.doc_id = l.doc_id group by d.lang""")
def sql_left_join(t):
    labels = t.labels.select("doc_id", "quality", F.col("doc_id").alias("hit"))
    return (t.documents.select("doc_id", "lang").join(labels, "doc_id", "left").groupBy("lang")
            .agg(F.count("*").alias("docs"), F.count("hit").alias("labelled"),
                 F.count_if(F.col("quality") == 1).alias("good")))


_LATE = "select user_id, count(*) as errors from events where event_type = 'error' group by user_id"
_BUY = "select user_id, count(*) as buys from events where event_type = 'purchase' and value > 40 group by user_id"


@query("sql_right_full_join", f"""
select 'right' as kind, count(*) as n, count(errors) as has_left, count(buys) as has_right
from ({_LATE}) e right join ({_BUY}) b on e.user_id = b.user_id
union all
select 'full', count(*), count(errors), count(buys)
from ({_LATE}) e full join ({_BUY}) b on e.user_id = b.user_id""")
def sql_right_full_join(t):
    late = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))
    buys = t.events.where("event_type = 'purchase' and value > 40").groupBy("user_id").agg(
        F.count("*").alias("buys"))
    parts = [late.join(buys, "user_id", how).agg(
        F.lit(how).alias("kind"), F.count("*").alias("n"), F.count("errors").alias("has_left"),
        F.count("buys").alias("has_right")) for how in ("right", "full")]
    return parts[0].unionByName(parts[1])


@query("sql_semi_anti", """
select 'semi' as kind, c_mktsegment, count(*) as n from customer
where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_mktsegment
union all
select 'anti', c_mktsegment, count(*) from customer
where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_mktsegment""")
def sql_semi_anti(t):
    big = t.orders.where("o_totalprice > 300000").select("o_custkey")
    parts = [t.customer.join(big, F.expr("c_custkey = o_custkey"), f"left_{k}").groupBy("c_mktsegment")
             .agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "c_mktsegment", "n")
             for k in ("semi", "anti")]
    return parts[0].unionByName(parts[1])


@query("sql_range_join", """
with ship as (select l_orderkey, l_linenumber, l_shipdate from lineitem),
     promo as (select o_orderkey as promo_id, o_orderdate as starts, o_orderdate + interval 2 day as ends
               from orders where o_totalprice > 340000)
select promo_id, count(*) as shipped from promo join ship on l_shipdate >= starts and l_shipdate < ends
group by promo_id""")
def sql_range_join(t):
    """Lines shipped inside two-day windows, counted by position: no line meets a window."""
    promo = t.orders.where("o_totalprice > 340000").select(
        F.col("o_orderkey").alias("promo_id"), F.col("o_orderdate").alias("starts"),
        (F.col("o_orderdate") + F.expr("interval 2 days")).alias("ends"))
    return joins.range_counts(t.lineitem.select("l_shipdate"), promo, "l_shipdate", "starts", "ends", "shipped").where("shipped > 0").select("promo_id", "shipped")


_LONG_SPANS = """(select n_nationkey as span_id, timestamp '1992-01-01' + to_days((n_nationkey * 60)::int) as starts,
  timestamp '1992-01-01' + to_days((n_nationkey * 60 + (n_nationkey % 5) * 400)::int) + to_hours(6) as ends from nation)"""


@query("sql_range_join_pairs", f"""
select span_id, count(*) as met, min(e.o_orderkey) as lowest, cast(sum(cast(e.o_totalprice as decimal(18,2))) as double) as total
from {_LONG_SPANS} s join orders e on e.o_orderdate >= s.starts and e.o_orderdate < s.ends group by span_id""")
def sql_range_join_pairs(t):
    """Orders inside spans of six hours to four years: each span meets them on its aligned blocks of days."""
    key, start = F.col("n_nationkey"), F.lit("1992-01-01").cast("timestamp")
    spans = t.nation.select(
        key.alias("span_id"), (start + F.make_dt_interval(key.cast("int") * 60)).alias("starts"),
        (start + F.make_dt_interval((key * 60 + key % 5 * 400).cast("int"), F.lit(6))).alias("ends"))
    points = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    return joins.range_join(points, spans, "o_orderdate", "starts", "ends", bucket_seconds=86400).groupBy("span_id").agg(
        F.count("*").alias("met"), F.min("o_orderkey").alias("lowest"), F.sum(dec("o_totalprice")).cast("double").alias("total"))


@query("asof_join", """
with clicks as (select event_id, user_id, ts from events where event_type = 'click'),
     views as (select user_id, ts as view_ts, event_id as view_id from events where event_type = 'view'),
     best as (select c.event_id, max(v.view_ts) as at from clicks c join views v
              on v.user_id = c.user_id and v.view_ts <= c.ts group by c.event_id)
select c.event_id, max(v.view_id) as view_id from clicks c
left join best b on b.event_id = c.event_id
left join views v on v.user_id = c.user_id and v.view_ts = b.at group by c.event_id""")
def asof_join(t):
    clicks = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof_join(clicks, views, on="ts", by=["user_id"], value="view_id").select("event_id", "view_id")


@query("sql_distinct_agg", """
select o_orderpriority, count(distinct o_custkey) as customers, count(distinct o_orderstatus) as statuses,
       (select count(*) from (select distinct o_orderpriority, o_orderstatus from orders)) as combinations
from orders group by o_orderpriority""")
def sql_distinct_agg(t):
    o = t.orders
    pairs = o.select("o_orderpriority", "o_orderstatus").distinct().agg(F.count("*"))
    return o.groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses")
    ).withColumn("combinations", pairs.scalar())


_CUSTOMER_NATION = "customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _placed(t):
    return (t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey"))
            .join(t.region, F.expr("n_regionkey = r_regionkey")))


def _level(col):
    return F.coalesce(F.col(col), F.lit("(all)")).alias(col)


_LEVELS = """coalesce(r_name, '(all)') as r_name, coalesce(c_mktsegment, '(all)') as c_mktsegment,
count(*) as n, cast(grouping(r_name) * 2 + grouping(c_mktsegment) as bigint) as gid"""


def _levels(grouped):
    return grouped.agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).select(
        _level("r_name"), _level("c_mktsegment"), "n", "gid")


@query("sql_grouping_sets", f"""select {_LEVELS} from {_CUSTOMER_NATION}
group by grouping sets ((r_name), (c_mktsegment), (r_name, c_mktsegment))""")
def sql_grouping_sets(t):
    r, m = F.col("r_name"), F.col("c_mktsegment")
    return _levels(_placed(t).groupingSets([[r], [m], [r, m]], r, m))


@query("sql_cube", f"select {_LEVELS} from {_CUSTOMER_NATION} group by cube (r_name, c_mktsegment)")
def sql_cube(t):
    return _levels(_placed(t).cube("r_name", "c_mktsegment"))


@query("sql_rollup", f"select {_LEVELS} from {_CUSTOMER_NATION} group by rollup (r_name, c_mktsegment)")
def sql_rollup(t):
    return _levels(_placed(t).rollup("r_name", "c_mktsegment"))


# A tenth of the customers, and one priority, are missing: null is a key like any other.
_SOME_KEYS = """(select o_orderkey, case when o_custkey % 10 <> 0 then o_custkey end as c, nullif(o_orderpriority, '3-MEDIUM') as p,
  o_totalprice, o_orderdate from orders)"""


def _some_keys(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("c"),
                           F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("p"), "o_totalprice", "o_orderdate")


@query("sql_rank_windows", f"""
select o_orderkey, row_number() over w as rn, rank() over (partition by c order by p) as rk,
       dense_rank() over (partition by c order by p) as drk, ntile(3) over w as tile,
       round(percent_rank() over w, 4) as pr
from {_SOME_KEYS} window w as (partition by c order by o_totalprice, o_orderkey)""")
def sql_rank_windows(t):
    ranked = ordered.row_ranks(_some_keys(t), ["c"], ["o_totalprice", "o_orderkey"], tiles=3)
    labels = ordered.label_ranks(ranked, ["c"], "p")
    return labels.select("o_orderkey", "rn", "rk", "drk", "tile", F.round("pr", 4).alias("pr"))


@query("sql_lag_lead", f"""
select o_orderkey, lag(o_totalprice) over w as previous, lead(o_totalprice) over w as next,
       first_value(o_totalprice) over w as first_price,
       last_value(o_totalprice) over (partition by c order by o_orderdate, o_orderkey
         rows between unbounded preceding and unbounded following) as last_price
from {_SOME_KEYS} window w as (partition by c order by o_orderdate, o_orderkey)""")
def sql_lag_lead(t):
    keys, order = ["c"], ["o_orderdate", "o_orderkey"]
    o = _some_keys(t)
    near = ordered.framed(o, keys, order, 1, 1, {
        "previous": lambda w: F.lag("o_totalprice").over(w), "next": lambda w: F.lead("o_totalprice").over(w)})
    whole = ordered.ends(near, keys, order, {"first_price": "o_totalprice"}, {"last_price": "o_totalprice"})
    return whole.select("o_orderkey", "previous", "next", "first_price", "last_price")


@query("sql_frames", """
select o_orderkey,
       count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as last3,
       count(*) over (partition by o_custkey order by cast(epoch(o_orderdate) as bigint)
                      range between 31536000 preceding and current row) as past_year,
       max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey
                      rows between 1 following and 3 following) as max_next3
from orders""")
def sql_frames(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = ordered.framed(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2, 3, {
        "last3": lambda w: F.count("*").over(w.rowsBetween(-2, 0)),
        "max_next3": lambda w: F.max("o_totalprice").over(w.rowsBetween(1, 3))})
    year = joins.rolling_span(rows, ["o_custkey"], "o_orderdate", 31536000, F.count("*"), "past_year")
    return year.select("o_orderkey", "last3", "past_year", "max_next3")


@query("rolling_agg", """
select event_id, round(avg(value) over (partition by user_id order by ts, event_id
       rows between 6 preceding and current row), 8) as rolling
from events""")
def rolling_agg(t):
    return joins.rolling_agg(t.events, ["user_id"], ["ts", "event_id"], 7, F.avg("value"), "rolling").select(
        "event_id", F.round("rolling", 8).alias("rolling"))


@query("rolling_span", """
select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as recent
from events""")
def rolling_span(t):
    return joins.rolling_span(t.events, ["user_id"], "ts", 21600, F.count("*"), "recent").select("event_id", "recent")


_A = "select o_custkey % 50 as k from orders where o_orderpriority = '1-URGENT'"
_B = "select o_custkey % 70 as k from orders where o_orderstatus = 'P'"


@query("sql_set_ops", f"""
select op, k, count(*) as n from (
  select 'union' as op, k from ({_A} union {_B}) union all
  select 'union_all', k from ({_A} union all {_B}) union all
  select 'intersect', k from ({_A} intersect {_B}) union all
  select 'intersect_all', k from ({_A} intersect all {_B}) union all
  select 'except', k from ({_B} except {_A}) union all
  select 'except_all', k from ({_B} except all {_A})) group by op, k""")
def sql_set_ops(t):
    a = t.orders.where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 50).alias("k"))
    b = t.orders.where("o_orderstatus = 'P'").select((F.col("o_custkey") % 70).alias("k"))
    parts = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b),
             "intersect_all": a.intersectAll(b), "except": b.subtract(a), "except_all": b.exceptAll(a)}
    out = None
    for op, df in parts.items():
        one = df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "k", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("sql_subquery", """
select o_orderkey, o_totalprice from orders o
where o_totalprice > 1.5 * (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)
  and o_totalprice > (select avg(o_totalprice) from orders)
  and o_custkey in (select c_custkey from customer where c_acctbal > 5000)""")
def sql_subquery(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    own = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("own_avg"))
    overall = o.agg(F.avg("o_totalprice")).scalar()
    return (o.join(rich, "o_custkey", "left_semi").join(own, "o_custkey")
            .where((F.col("o_totalprice") > 1.5 * F.col("own_avg")) & (F.col("o_totalprice") > overall))
            .select("o_orderkey", "o_totalprice"))


@query("sql_topk_paging", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40""")
def sql_topk_paging(t):
    return (t.orders.select("o_orderkey", "o_totalprice")
            .orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20))


@query("sql_scalar_strings", """
select p_partkey, upper(p_name) as up, length(p_name) as len, substring(p_brand, 7) as brand_no,
       replace(p_type, ' ', '_') as kind, p_name || '/' || p_brand as joined, strpos(p_name, 'e') as first_e,
       reverse(p_brand) as back, lpad(cast(p_size as varchar), 4, '0') as padded, split_part(p_name, ' ', 1) as word
from part""")
def sql_scalar_strings(t):
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("bigint").alias("len"),
        F.expr("substring(p_brand, 7)").alias("brand_no"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"),
        F.concat_ws("/", "p_name", "p_brand").alias("joined"),
        F.instr("p_name", "e").cast("bigint").alias("first_e"), F.reverse("p_brand").alias("back"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))


@query("sql_scalar_dates", """
select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(quarter(o_orderdate) as bigint) as qtr,
       strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start,
       strftime(last_day(o_orderdate), '%Y-%m-%d') as month_end,
       date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as days,
       strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as expires
from orders""")
def sql_scalar_dates(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", F.year(d).cast("bigint").alias("y"), F.quarter(d).cast("bigint").alias("qtr"),
        F.date_format(F.date_trunc("month", d), "yyyy-MM-dd").alias("month_start"),
        F.date_format(F.last_day(d), "yyyy-MM-dd").alias("month_end"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
        F.date_format(F.date_add(d, 30), "yyyy-MM-dd").alias("expires"))


@query("sql_scalar_math", """
select c_custkey, round(c_acctbal, 1) as r1, abs(c_acctbal) as magnitude, ceil(c_acctbal) as up,
       floor(c_acctbal) as down, cast(sign(c_acctbal) as int) as s, round(sqrt(abs(c_acctbal)), 4) as root,
       c_custkey % 7 as m, greatest(c_acctbal, 0) as clamped, round(ln(abs(c_acctbal) + 1), 4) as logged
from customer""")
def sql_scalar_math(t):
    b = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.round(b, 1).alias("r1"), F.abs(b).alias("magnitude"), F.ceil(b).cast("double").alias("up"),
        F.floor(b).cast("double").alias("down"), F.sign(b).cast("int").alias("s"),
        F.round(F.sqrt(F.abs(b)), 4).alias("root"), (F.col("c_custkey") % 7).alias("m"),
        F.greatest(b, F.lit(0.0)).alias("clamped"), F.round(F.log(F.abs(b) + 1), 4).alias("logged"))


@query("sql_json_extract", """
select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total,
       count(json_extract_string(props, '$.missing')) as missing from events group by event_type""")
def sql_json_extract(t):
    return (t.events.select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                            F.get_json_object("props", "$.missing").alias("none"))
            .groupBy("event_type").agg(F.sum("k").alias("total"), F.count("none").alias("missing")))
