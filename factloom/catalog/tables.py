"""Cleaning, profiling and descriptive-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean, joins, ordered, profile, sqlguard, stats
from ..session import scratch_dir
from .registry import query


def union_sql(columns, one) -> str:
    return "\nunion all\n".join(one(i, c) for i, c in enumerate(columns))


# -- profiling ---------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_KIND = {"o_orderkey": "'integer'", "o_custkey": "'integer'", "o_totalprice": "'float'", "o_orderdate": "'datetime'"}


def _profile_sql(table, columns, kinds):
    def one(i, c):
        kind = kinds.get(c, f"case when count(distinct {c}) <= 0.5 * count({c}) then 'categorical' else 'text' end")
        span = (f"cast(min({c}) as varchar)", f"cast(max({c}) as varchar)") if c in kinds else ("null", "null")
        return (f"select '{c}' as name, {kind} as dtype, {i} as position, count(*) - count({c}) as null_count, "
                f"count(distinct {c}) as distinct_count, {span[0]} as min_value, {span[1]} as max_value, "
                f"(select string_agg(cast(v as varchar), '|' order by v) from (select distinct {c} as v "
                f"from {table} where {c} is not null order by 1 limit 5)) as samples from {table}")
    return union_sql(columns, one)


@query("profile", _profile_sql("orders", _ORDERS, _KIND))
def profile_orders(t):
    return profile.profile(t.orders).select(
        "name", "dtype", "position", "null_count", "distinct_count", "min_value", "max_value",
        F.array_join("sample_values", "|").alias("samples"))


@query("semantic_dtype", union_sql(["doc_id", "text", "lang", "source", "n_chars"], lambda i, c:
       f"select '{c}' as name, " + ("'integer'" if c in ("doc_id", "n_chars") else
       f"(select case when count(distinct {c}) <= 0.5 * count({c}) then 'categorical' else 'text' end from documents)") +
       " as dtype"))
def semantic_dtype(t):
    return profile.profile(t.documents, samples=False).select("name", "dtype")


@query("sample_values", "select 'event_type' as name, string_agg(v, '|' order by seen) as samples from "
       "(select event_type as v, min(event_id) as seen from events group by event_type order by seen limit 5) "
       "union all select 'user_id', string_agg(v, '|' order by seen) from (select cast(user_id as varchar) as v, "
       "min(event_id) as seen from events group by user_id order by seen limit 5)")
def sample_values(t):
    """First five distinct values in event order."""
    e = t.events.select("event_id", "event_type", "user_id")
    return (profile.profile(e, ordered_by="event_id").where("name <> 'event_id'")
            .select("name", F.array_join("sample_values", "|").alias("samples")))


_LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]


@query("column_stats", union_sql(_LINE_NUM, lambda i, c:
       f"select '{c}' as name, count(x) as n, count(*) - count(x) as nulls, round(avg(x), 4) as mean, "
       f"round(stddev_samp(x), 4) as std, min(x) as min, max(x) as max, "
       f"round(stddev_samp(x) / (abs(avg(x)) + 1e-9), 4) as spread, round(skewness(x), 4) as skew "
       f"from (select cast(" + (f"nullif({c}, 0)" if c == "l_tax" else c) + " as double) as x from lineitem)"))
def column_stats(t):
    df = t.lineitem.select(*_LINE_NUM).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return stats.column_stats(df).select(
        "name", "n", "nulls", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max",
        F.round("spread", 4).alias("spread"), F.round("skew", 4).alias("skew"))


@query("spread", union_sql(_LINE_NUM[4:], lambda i, c:
       f"select '{c}' as name, round(stddev_samp({c}) / (abs(avg({c})) + 1e-9), 4) as spread from lineitem"))
def spread(t):
    return stats.column_stats(t.lineitem.select(*_LINE_NUM[4:])).select("name", F.round("spread", 4).alias("spread"))


@query("skew", """
select event_type, round(skewness(value), 4) as skew, round(skewness(value * value * value), 4) as cube_skew
from events group by event_type""")
def skew(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(
        F.round(stats.adjusted_skewness(v), 4).alias("skew"),
        F.round(stats.adjusted_skewness(v * v * v), 4).alias("cube_skew"))


@query("distinct_counts", union_sql(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
       lambda i, c: f"select '{c}' as name, count(distinct {c}) as distinct_count from part"))
def distinct_counts(t):
    return stats.distinct_counts(t.part)


@query("shared_columns", """
select 'doc_id' as name, 'documents|labels' as tables,
       (select count(distinct doc_id) from documents) as most_values
union all
select 'text', 'benchmark|conversations|documents',
       greatest((select count(distinct text) from documents), (select count(distinct text) from benchmark),
                (select count(distinct text) from conversations))""")
def shared_columns(t):
    profiles = profile.profile_tables({n: getattr(t, n) for n in ("documents", "labels", "benchmark", "conversations")}, samples=False)
    found = profile.shared_columns(profiles)
    most = profiles.groupBy("name").agg(F.max("distinct_count").alias("most_values"))
    return found.join(most, "name").select("name", F.array_join("tables", "|").alias("tables"), "most_values")


@query("dimension_values", """
select distinct 'o_orderstatus' as name, o_orderstatus as value from orders union all
select distinct 'o_orderpriority', o_orderpriority from orders""")
def dimension_values(t):
    return profile.dimension_values(t.orders, profile.profile(t.orders, samples=False))


_DESCRIBE = ["o_orderkey", "o_custkey", "o_totalprice"]
_NO_MOMENTS = ", ".join(f"cast(null as varchar) as {c}" for c in profile.MOMENTS)
_QUARTER = {"p25_at": 0.25, "p50_at": 0.5, "p75_at": 0.75}


@query("describe", union_sql(_DESCRIBE, lambda i, c:
       f"select '{c}' as \"column\", count({c}) as \"count\", cast(null as bigint) as \"unique\", "
       f"cast(null as varchar) as top, cast(null as bigint) as freq, round(avg({c}), 4) as mean, "
       f"round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min, "
       f"round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, "
       f"round(quantile_cont({c}, 0.75), 4) as p75, cast(max({c}) as double) as max, {_NO_MOMENTS} from orders") +
       f""" union all select 'o_orderpriority', count(o_orderpriority), count(distinct o_orderpriority),
       (select o_orderpriority from orders group by 1 order by count(*) desc, 1 limit 1),
       (select count(*) from orders group by o_orderpriority order by 1 desc limit 1),
       null, null, null, null, null, null, null, {_NO_MOMENTS} from orders
       union all select 'o_orderdate', count(o_orderdate), null, null, null, null, null, null, null, null, null, null,
       strftime(make_timestamp(round(avg(epoch_us(o_orderdate)))::bigint), '%Y-%m-%d %H:%M:%S'), strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S'),
       {", ".join(f"strftime(make_timestamp(round(quantile_cont(epoch_us(o_orderdate)::double, {q}))::bigint), '%Y-%m-%d %H:%M:%S')" for q in _QUARTER.values())},
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') from orders""")
def describe(t):
    out = profile.describe(t.orders, [*_DESCRIBE, "o_orderpriority", "o_orderdate"]).drop("position")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("exact_quantiles", union_sql(["l_quantity", "l_extendedprice", "l_discount"], lambda i, c:
       f"select '{c}' as name, round(quantile_cont({c}, 0.1), 4) as p10, round(quantile_cont({c}, 0.5), 4) as p50, "
       f"round(quantile_cont({c}, 0.99), 4) as p99 from lineitem where {c} <> 0.05"))
def exact_quantiles(t):
    """Values of 0.05 stand as NaN in the table: missing."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    df = t.lineitem.select(*[F.when(F.col(c) == 0.05, float("nan")).otherwise(F.col(c)).alias(c) for c in names])
    got = stats.exact_quantiles(df, names, [0.1, 0.5, 0.99])
    rows = [(c, *[round(v, 4) for v in vs]) for c, vs in got.items()]
    return t.spark.createDataFrame(rows, "name string, p10 double, p50 double, p99 double")


@query("value_counts", """
select nullif(event_type, 'error') as value, count(*) as "count" from events group by 1 order by 2 desc, 1 limit 20""")
def value_counts(t):
    return profile.value_counts(t.events.withColumn("event_type", F.nullif("event_type", F.lit("error"))), "event_type")


# -- correlation -------------------------------------------------------------

_CORR_VIEW = ("(select l_quantity, l_extendedprice, nullif(l_tax, 0) as tax, "
              "l_extendedprice * (1 - l_discount) as revenue from lineitem)")


def _corr_view(t):
    return t.lineitem.select("l_quantity", "l_extendedprice", F.nullif("l_tax", F.lit(0.0)).alias("tax"),
                             (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def _matrix_sql(view, columns, one):
    return "\nunion all\n".join(
        f"select '{a}' as a, '{b}' as b, " + ("1.0" if a == b else f"round(({one(a, b)}), 4)") + " as r"
        for a in columns for b in columns).replace("1.0 as r", "cast(1.0 as double) as r")


@query("correlate", _matrix_sql(_CORR_VIEW, ["l_quantity", "l_extendedprice", "tax", "revenue"],
                                lambda a, b: f"select corr({a}, {b}) from {_CORR_VIEW}"))
def correlate(t):
    return stats.correlate(_corr_view(t))


@query("correlate_spearman", _matrix_sql(None, ["l_quantity", "tax", "revenue"], lambda a, b: f"""
  select corr(ra, rb) from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra,
    rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
    from {_CORR_VIEW} where {a} is not null and {b} is not null)"""))
def correlate_spearman(t):
    return stats.correlate(_corr_view(t), ["l_quantity", "tax", "revenue"], "spearman")


_BANDS = ("(select l_quantity, l_discount, floor(l_extendedprice / 4000) as band from lineitem)")


@query("correlate_kendall", _matrix_sql(None, ["l_quantity", "l_discount", "band"], lambda a, b: f"""
  with c as (select {a} as a, {b} as b, count(*) as w from {_BANDS} group by 1, 2),
       s as (select sum(x.w * y.w * sign(x.b - y.b)) as s from c x join c y on x.a > y.a),
       n as (select sum(w) as n from c),
       ta as (select sum(t * (t - 1) / 2) as t from (select sum(w) as t from c group by a)),
       tb as (select sum(t * (t - 1) / 2) as t from (select sum(w) as t from c group by b))
  select s.s / (sqrt(n.n * (n.n - 1) / 2 - ta.t) * sqrt(n.n * (n.n - 1) / 2 - tb.t)) from s, n, ta, tb"""))
def correlate_kendall(t):
    df = t.lineitem.select("l_quantity", "l_discount", F.floor(F.col("l_extendedprice") / 4000).alias("band"))
    return stats.correlate(df, method="kendall")


@query("value_ranks", """
select value, n, cast(sum(n) over (order by value) - n as bigint) as before, row_number() over (order by value) as dense
from (select l_extendedprice as value, count(*) as n from lineitem group by 1)""")
def value_ranks(t):
    return ordered.value_ranks(t.lineitem, "l_extendedprice")


# -- projection and filters --------------------------------------------------

@query("project_columns", "select o_orderkey, o_orderpriority from orders")
def project_columns(t):
    return sqlguard.project_columns(t.orders, ["o_orderkey", "o_orderpriority"])


@query("drop_duplicate_names", """
select d.doc_id, lang, quality from documents d join labels l on d.doc_id = l.doc_id""")
def drop_duplicate_names(t):
    d, l = t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality")
    return sqlguard.drop_duplicate_names(d.join(l, d["doc_id"] == l["doc_id"]))


@query("null_drop", """
select l_returnflag, count(*) as n from (select l_returnflag, nullif(l_tax, 0) as tax, nullif(l_discount, 0.1) as disc
from lineitem) where tax is not null and disc is not null group by l_returnflag""")
def null_drop(t):
    df = t.lineitem.select("l_returnflag", F.nullif("l_tax", F.lit(0.0)).alias("tax"),
                           F.nullif("l_discount", F.lit(0.1)).alias("disc"))
    return df.dropna(subset=["tax", "disc"]).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("read_parquet", "select count(*) as n, min(p_retailprice) as cheapest, max(p_size) as largest from part")
def read_parquet(t):
    return t.part.agg(F.count("*").alias("n"), F.min("p_retailprice").alias("cheapest"), F.max("p_size").alias("largest"))


@query("write_parquet", """
select c_mktsegment, count(*) as n, round(avg(c_acctbal), 4) as avg_balance from customer group by c_mktsegment""")
def write_parquet(t):
    path = scratch_dir(t.spark, "customer")
    t.customer.write.parquet(path)
    return (t.spark.read.parquet(path).groupBy("c_mktsegment")
            .agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance")))


@query("inner_join_unique_check", """
select 'orders' as side, (select max(n) from (select count(*) as n from orders group by o_custkey)) = 1 as one_per_key
union all select 'customer', (select max(n) from (select count(*) as n from customer group by c_custkey)) = 1""")
def inner_join_unique_check(t):
    per = lambda df, k, n: df.groupBy(k).count().agg((F.max("count") == 1).alias("one_per_key")).select(
        F.lit(n).alias("side"), "one_per_key")
    return per(t.orders, "o_custkey", "orders").unionByName(per(t.customer, "c_custkey", "customer"))


# -- cleaning ----------------------------------------------------------------

_DIRTY = """(select '$' || cast(cast(floor(o_totalprice / 20000) * 20000 as bigint) as varchar) as " amount ",
  case when o_orderkey % 7 = 0 then lower(o_orderpriority) else '  ' || o_orderpriority || ' ' end as priority,
  case o_orderkey % 5 when 0 then 'N/A' when 1 then ' - ' else 'note ' || o_orderstatus end as note,
  strftime(date_trunc('month', o_orderdate), '%m/%d/%Y') as "day", cast(null as varchar) as blank, 'x' as fixed from orders)"""


def dirty(t):
    """Orders as a careless CSV export would hold them."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return t.orders.select(
        F.concat(F.lit("$"), (F.floor(F.col("o_totalprice") / 20000) * 20000).cast("string")).alias(" amount "),
        F.when(k % 7 == 0, F.lower(p)).otherwise(F.concat(F.lit("  "), p, F.lit(" "))).alias("priority"),
        F.when(k % 5 == 0, "N/A").when(k % 5 == 1, " - ").otherwise(F.concat(F.lit("note "), "o_orderstatus")).alias("note"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "MM/dd/yyyy").alias("day"),
        F.lit(None).cast("string").alias("blank"), F.lit("x").alias("fixed"))


_NORMAL = "trim(regexp_replace(priority, '\\s+', ' ', 'g'))"
_CLEANED = f"""(with d as (select cast(replace(" amount ", '$', '') as double) as amount, {_NORMAL} as priority,
    case when trim(note) in ('N/A', '-') then null else note end as note, "day" from {_DIRTY}),
  c as (select priority, count(*) as n from d group by 1),
  best as (select lower(priority) as low, arg_min(priority, struct_pack(a := -n, b := priority)) as canonical from c group by 1)
  select distinct amount, canonical as priority, note, strftime(strptime("day", '%m/%d/%Y'), '%Y-%m-%d') as "day"
  from d join best on lower(d.priority) = low)"""


@query("clean", f"select * from {_CLEANED}")
def clean_table(t):
    return clean.clean(dirty(t))[0].withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_AUDIT = f"""select 'trim_headers' as code, 'amount' as columns, cast(1 as bigint) as n
union all select 'null_tokens', 'note', count(*) from {_DIRTY} where trim(note) in ('N/A', '-')
union all select 'coerce_numeric', 'amount', 1 union all select 'coerce_datetime', 'day', 1
union all select 'merge_case', 'priority', 1 union all select 'drop_empty_cols', 'blank', 1
union all select 'drop_constant_cols', 'fixed', 1
union all select 'drop_dup_rows', '', (select count(*) from orders) - (select count(*) from {_CLEANED})"""


@query("clean_audit", f"select * from ({_AUDIT}) where n > 0")
def clean_audit(t):
    return clean.audit(dirty(t)).select("code", F.array_join("columns", "|").alias("columns"), "n")


@query("apply_cleaning", f"""select (select count(*) from {_CLEANED}) as row_count, 4 as col_count,
  'amount:float|day:datetime|note:categorical|priority:categorical' as columns""")
def apply_cleaning(t):
    source, target = scratch_dir(t.spark, "raw"), scratch_dir(t.spark, "clean")
    dirty(t).write.parquet(source)
    rows, cols, profiled, _ = clean.apply_cleaning(t.spark, source, target)
    return profiled.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "dtype"))), "|").alias("columns")
                        ).select(F.lit(rows).cast("bigint").alias("row_count"), F.lit(cols).alias("col_count"), "columns")


@query("trim_headers", f"""select count(" amount ") as amount_cells, count(priority) as priority_cells from {_DIRTY}""")
def trim_headers(t):
    df, _ = clean.trim_headers(dirty(t))
    return df.agg(F.count("amount").alias("amount_cells"), F.count("priority").alias("priority_cells"))


@query("norm_text", r"""
select doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g'))) as digest from documents""")
def norm_text(t):
    return t.documents.select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("digest"))


@query("null_tokens", f"""
select sum(case when trim(note) in ('N/A', '-') then 1 else 0 end)::bigint as changed, count(*) as cells from {_DIRTY}""")
def null_tokens(t):
    note = text.norm_text(F.col("note"))
    return dirty(t).agg(F.count_if(text.is_null_token(note)).alias("changed"), F.count("note").alias("cells"))


_NUMBER_TEXT = """(select event_id, case event_id % 8 when 0 then '$' || cast(event_id as varchar) || '.5'
  when 1 then cast(event_id as varchar) || '%' when 2 then '1,' || lpad(cast(event_id % 1000 as varchar), 3, '0')
  when 3 then '-$' || cast(event_id as varchar) when 4 then '(' || cast(event_id as varchar) || ')'
  when 5 then cast(event_id as varchar) || 'd' when 6 then ' € ' || cast(event_id as varchar) || 'e1 '
  else event_type end as raw from events)"""


def number_text(t):
    i = F.col("event_id")
    s = i.cast("string")
    return t.events.select("event_id", F.when(i % 8 == 0, F.concat(F.lit("$"), s, F.lit(".5")))
                           .when(i % 8 == 1, F.concat(s, F.lit("%")))
                           .when(i % 8 == 2, F.concat(F.lit("1,"), F.lpad((i % 1000).cast("string"), 3, "0")))
                           .when(i % 8 == 3, F.concat(F.lit("-$"), s))
                           .when(i % 8 == 4, F.concat(F.lit("("), s, F.lit(")")))
                           .when(i % 8 == 5, F.concat(s, F.lit("d")))
                           .when(i % 8 == 6, F.concat(F.lit(" € "), s, F.lit("e1 ")))
                           .otherwise(F.col("event_type")).alias("raw"))


@query("to_number", f"""select event_id, case when event_id % 8 in (3, 4, 5) then null else
  try_cast(replace(rtrim(trim(ltrim(trim(raw), '$€£₹¥')), '%'), ',', '') as double) end as number from {_NUMBER_TEXT}""")
def to_number(t):
    return number_text(t).select("event_id", text.to_number(F.col("raw")).alias("number"))


@query("coerce_numeric", f"""
select count(*) as n, count(number) as parsed, round(sum(number), 2) as total from (select case when event_id % 40 = 3
  then null else try_cast(replace(rtrim(trim(ltrim(trim(raw), '$€£₹¥')), '%'), ',', '') as double) end as number
  from (select event_id, case when event_id % 8 > 2 and event_id % 40 <> 3 then '$' || cast(event_id as varchar) else raw end as raw
    from {_NUMBER_TEXT}))""")
def coerce_numeric(t):
    """Over nine tenths of the cells parse, so the column turns numeric; the rest become null."""
    i = F.col("event_id")
    raw = number_text(t).select(i, F.when((i % 8 > 2) & (i % 40 != 3), F.concat(F.lit("$"), i.cast("string"))).otherwise(F.col("raw")).alias("raw"))
    fixed, _, _ = clean.plan_changes(raw)
    return fixed.agg(F.count("*").alias("n"), F.count("raw").alias("parsed"), F.round(F.sum("raw"), 2).alias("total"))


_DATE_COLS = {"iso": "strftime(o_orderdate, '%Y-%m-%d')", "us": "strftime(o_orderdate, '%m/%d/%Y')",
              "word": "o_orderpriority", "year": "strftime(o_orderdate, '%Y')"}


@query("looks_like_datetime", union_sql(_DATE_COLS, lambda i, c:
       f"select '{c}' as name, cast({int(c in ('iso', 'us'))} as boolean) as date_like, count({_DATE_COLS[c]}) as n from orders"))
def looks_like_datetime(t):
    d = F.col("o_orderdate")
    df = t.orders.select(F.date_format(d, "yyyy-MM-dd").alias("iso"), F.date_format(d, "MM/dd/yyyy").alias("us"),
                         F.col("o_orderpriority").alias("word"), F.date_format(d, "yyyy").alias("year"))
    aggs = [a for i, c in enumerate(df.columns)
            for a in (F.count(c).alias(f"n{i}"), *profile.date_rates(F.col(c), i))]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("name"), profile.is_date_like(*[F.col(f"{k}{i}") for k in ("n", "dig", "ts")]).alias("date_like"),
        F.col(f"n{i}").alias("n")) for i, c in enumerate(df.columns)])))


_LAYOUTS = {"us": "M/d/yyyy H:mm", "half_day": "M/d/yyyy h:mm a", "day_first": "dd/MM/yyyy", "dashes": "dd-MM-yyyy HH:mm", "dots": "d.M.yyyy", "compact": "yyyyMMdd",
            "short": "d-MMM-yyyy", "long": "MMMM d, yyyy", "mail": "EEE, dd MMM yyyy HH:mm:ss 'GMT'"}


@query("coerce_datetime", " union all ".join(f"""
select '{k}' as layout, strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, count(*) as n from orders group by all""" for k in _LAYOUTS))
def coerce_datetime(t):
    raw = t.orders.select("o_orderkey", *[F.date_format("o_orderdate", v).alias(k) for k, v in _LAYOUTS.items()])
    fixed, _, _ = clean.plan_changes(raw)
    tall = fixed.select(F.inline(F.array(*[F.struct(F.lit(k).alias("layout"), F.col(k).alias("day")) for k in _LAYOUTS])))
    return tall.groupBy("layout", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("merge_case", f"""
with d as (select {_NORMAL} as priority from {_DIRTY}), c as (select priority, count(*) as n from d group by 1)
select priority as value, first_value(priority) over (partition by lower(priority) order by n desc, priority) as canonical from c""")
def merge_case(t):
    labels = clean.label_counts(clean.normalised_text(dirty(t)), ["priority"])
    return clean.case_map(labels).select("value", "canonical")


@query("drop_empty_cols", f"select 'amount|day|fixed|note|priority' as kept, count(*) as n from {_DIRTY}")
def drop_empty_cols(t):
    fixed, changes, n = clean.plan_changes(dirty(t))
    constant = next(cols for code, cols, _ in changes if code == "drop_constant_cols")
    kept = "|".join(sorted([*fixed.columns, *constant]))
    return fixed.agg(F.lit(kept).alias("kept"), F.count("*").alias("n"))


@query("drop_constant_cols", f"""
select 'amount|day|note|priority' as kept, count(*) as n, count(distinct priority) as priorities
from (select lower({_NORMAL}) as priority from {_DIRTY})""")
def drop_constant_cols(t):
    fixed, _, _ = clean.plan_changes(dirty(t))
    return fixed.agg(F.lit("|".join(sorted(fixed.columns))).alias("kept"), F.count("*").alias("n"),
                     F.count_distinct("priority").alias("priorities"))


@query("drop_dup_rows", """
select l_returnflag, count(*) as n from (select distinct l_returnflag, l_linestatus, l_quantity, l_discount, nullif(l_tax, 0)
from lineitem) group by 1""")
def drop_dup_rows(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount",
                           F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return df.dropDuplicates().groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("is_unique", """
select (select count(*) = count(distinct c_custkey) from customer) as customer_key,
       (select count(*) = count(distinct o_custkey) from orders) as order_customer""")
def is_unique(t):
    c, o = joins.is_unique(t.customer, ["c_custkey"]), joins.is_unique(t.orders, ["o_custkey"])
    return t.customer.agg(F.lit(c).alias("customer_key"), F.lit(o).alias("order_customer"))
