"""Source, sink, naming and text-function queries."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import udf
from ..session import cut_lineage, scratch_dir
from ..sources import archives, csv, ingest
from .registry import query


def drop_csvs(t):
    """The given tables as the CSV files of an upload: line items in three parts with
    slightly different columns, orders, and customers."""
    root = scratch_dir(t.spark, "upload")
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    # Parts one and two keep their empty cells; part three has an extra column.
    parts = {
        "2024/lines.csv": line.where("l_linenumber <= 2"),
        "2024/more lines.csv": line.where("l_linenumber between 3 and 4").drop("shipped"),
        "2025/lines.csv": line.where("l_linenumber > 4").withColumn("note", F.when(F.col("l_quantity") > 25, "big")),
        "orders.csv": t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
        "people/customers.csv": t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lit("N/A").alias("comment")),
    }
    out = []
    for name, df in parts.items():
        path = f"{root}/{name}"
        df.write.option("header", True).csv(path)
        out.append((name, path))
    return out


@query("read_csv", """
select count(*) as n, count(l_quantity) as filled, sum(l_orderkey)::bigint as keys, round(sum(l_quantity), 2) as quantity from (
  select l_orderkey, nullif(l_quantity, 7) as l_quantity from lineitem)""")
def read_csv(t):
    """Written with 'NA' for missing cells, read back and typed."""
    path = scratch_dir(t.spark, "csv")
    df = t.lineitem.select("l_orderkey", F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"), "l_returnflag")
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    back = csv.infer_types(csv.read_csv(t.spark, [path]).drop(csv.BAD_RECORD))
    return back.agg(F.count("*").alias("n"), F.count("l_quantity").alias("filled"), F.sum("l_orderkey").alias("keys"),
                    F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("cluster_by_schema", """
select * from (values ('l_linenumber|l_orderkey|l_quantity|l_returnflag|note|shipped', 3), ('o_custkey|o_orderkey|o_orderpriority|o_totalprice', 1),
  ('c_custkey|c_mktsegment|c_name|comment', 1)) v(columns, files)""")
def cluster_by_schema(t):
    paths = [p for _, p in drop_csvs(t)]
    clusters = ingest.cluster_by_schema(csv.read_headers(t.spark, paths))
    return t.spark.createDataFrame([("|".join(sorted(c.columns)), len(c.files)) for c in clusters], "columns string, files int")


@query("stack_tables", """
select l_returnflag, count(*) as n, count(*) filter (where l_linenumber not between 3 and 4) as dated,
  count(*) filter (where l_linenumber > 4 and l_quantity > 25) as noted from lineitem group by 1""")
def stack_tables(t):
    paths = [p for _, p in drop_csvs(t)]
    headers = csv.read_headers(t.spark, paths)
    table = ingest.stack_tables(t.spark, ingest.cluster_by_schema(headers)[0], headers)
    return table.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("shipped").alias("dated"), F.count("note").alias("noted"))


_INGESTED = """(select 't_2024_lines' as name, '2024/lines.csv +2 more' as filename, count(*) as row_count, 5 as col_count from (
  select distinct l_orderkey, l_linenumber, l_quantity, l_returnflag, case when l_linenumber between 3 and 4 then null else cast(l_shipdate as date) end from lineitem)
union all select 'orders', 'orders.csv', count(*), 4 from orders
union all select 'people_customers', 'people/customers.csv', count(*), 3 from customer)"""


@query("ingest_tables", f"select * from {_INGESTED}")
def ingest_tables(t):
    """The stacked note column holds one repeated value and goes, as does the blank comment."""
    tables, _, _ = ingest.ingest_tables(t.spark, drop_csvs(t), scratch_dir(t.spark, "dataset"))
    return t.spark.createDataFrame([(x.name, x.filename, x.row_count, x.col_count) for x in tables],
                                   "name string, filename string, row_count bigint, col_count int")


@query("dataset_summary", f"""
select cast(5 as bigint) as files, count(*) as tables, cast(sum(row_count) as bigint) as "rows", cast(sum(col_count) as bigint) as "columns" from {_INGESTED}""")
def dataset_summary(t):
    files = drop_csvs(t)
    tables, _, _ = ingest.ingest_tables(t.spark, files, scratch_dir(t.spark, "dataset"))
    return ingest.dataset_summary(t.spark, tables, len(files)).drop("bytes")


@query("expand_archives", """
select 'data/' || o_orderstatus || '.csv' as member, cast(null as varchar) as error, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1
union all select null, 'not a valid ZIP archive', count(*), sum(n_nationkey)::bigint from nation""")
def expand_archives(t):
    """Orders are packed into ZIPs (one per batch of rows, with junk members), then
    expanded and read; refused archives are counted with the rest."""
    def pack(batches):
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for status, rows in batch.groupby("o_orderstatus"):
                    z.writestr(f"../data/{status}.csv", rows[["o_orderkey"]].to_csv(index=False))
                z.writestr("__MACOSX/._x.csv", "junk")
                z.writestr("readme.txt", "not data")
            yield pd.DataFrame({"path": [f"batch-{batch['o_orderkey'].iloc[0]}.zip"], "content": [buffer.getvalue()]})

    zips = t.orders.select("o_orderkey", "o_orderstatus").mapInPandas(pack, "path string, content binary")
    broken = t.nation.select(F.concat(F.lit("broken-"), F.col("n_nationkey").cast("string")).alias("path"), F.encode("n_name", "UTF-8").alias("content"))
    members = archives.expand(cut_lineage(zips, "zips").union(broken))
    rows = members.where("error is null").select("member", "error", F.explode(F.slice(archives.member_lines(F.col("content")), 2, 2**31 - 1)).alias("line"))
    refused = members.where("error is not null").select("member", "error", F.substring_index("archive", "-", -1).alias("line"))
    return rows.union(refused).groupBy("member", "error").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("bigint")).alias("keys"))


_PATHS = "(select doc_id, source || '/' || lang || ' Data ' || (doc_id % 50) || '!.csv' as path from documents)"


@query("table_name", f"""
with b as (select doc_id, path, trim(regexp_replace(regexp_replace(lower(path), '\\.[^./]*$', ''), '[^a-z0-9]+', '_', 'g'), '_') as base from {_PATHS}),
  k as (select *, row_number() over (partition by base order by doc_id) as k from b)
select doc_id, case when base similar to '[0-9].*' then 't_' else '' end || base || case when k = 1 then '' else '_' || k end as table_name from k""")
def table_name(t):
    files = t.documents.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(" Data "), (F.col("doc_id") % 50).cast("string"), F.lit("!.csv")).alias("path"))
    return ingest.named(files, "path", "doc_id").select("doc_id", "table_name")


@query("records_sink", """
select event_type, count(*) as n, sum(length(record)) ::bigint as bytes, count(*) filter (where contains(record, '"value":null')) as missing from (
  select event_type, '{"event_id":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","value":' ||
    case when event_type = 'click' then 'null' else '1' end || '}' as record from events) group by 1""")
def records_sink(t):
    df = t.events.select("event_type", "event_id", F.col("ts").alias("at"), F.when(F.col("event_type") != "click", 1).alias("value"))
    records = df.select("event_type", F.struct("event_id", "at", "value").alias("r"))
    # The sink keeps one record per row; the type travels next to it for the check.
    json = ingest.records_sink(records.select("r.*", "event_type"))
    bare = F.regexp_replace("record", r',"event_type":"[a-z]+"', "")
    return (json.select(F.get_json_object("record", "$.event_type").alias("event_type"), bare.alias("record"))
            .groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("record")).alias("bytes"),
                                       F.count_if(F.contains("record", F.lit('"value":null'))).alias("missing")))


# -- text functions -----------------------------------------------------------------

@query("str_basic", """
select c_custkey, trim('  ' || lower(c_name) || ' ') as low, replace(c_name, '#', '') as plain, regexp_replace(c_name, '[^0-9]', '', 'g') as digits,
  regexp_matches(c_name, '[0-9]') as has_digit, ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') as stripped,
  array_to_string(string_split(c_name, '#'), '+') as rejoined, contains(c_name, '9') as nine from customer""")
def str_basic(t):
    n = F.col("c_name")
    digits = F.regexp_replace(n, "[^0-9]", "")
    return t.customer.select(
        "c_custkey", F.trim(F.concat(F.lit("  "), F.lower(n), F.lit(" "))).alias("low"), F.replace(n, F.lit("#"), F.lit("")).alias("plain"),
        digits.alias("digits"), text.has_digit(n).alias("has_digit"), F.ltrim(digits, F.lit("0")).alias("stripped"),
        F.array_join(F.split(n, "#"), "+").alias("rejoined"), F.contains(n, F.lit("9")).alias("nine"))


@query("sanitize_text", r"""
select doc_id, md5(substring(trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0B-\x1F]', '', 'g'), '</?\s*user_request\s*>', '', 'gi'), E' \n\t\r'), 1, 1000)) as digest
from (select doc_id, '  </user_request>' || chr(7) || text || '< user_request >' as raw from documents)""")
def sanitize_text(t):
    raw = F.concat(F.lit("  </user_request>"), F.char(F.lit(7)), "text", F.lit("< user_request >"))
    return t.documents.select("doc_id", F.md5(text.sanitize_prompt(raw)).alias("digest"))


@query("usable_prompt", """
select count(*) filter (where length(trim(p_type)) >= 10) as usable, count(*) filter (where length(trim(p_type)) < 10) as short from part""")
def usable_prompt(t):
    ok = text.usable_prompt(F.col("p_type"))
    return t.part.agg(F.count(ok).alias("usable"), F.count_if(ok.isNull()).alias("short"))


@query("safe_title", """
with b as (select p_partkey, substring(regexp_replace(trim(regexp_replace('**' || p_type || '**: ' || p_size % 5 || '!', '[^\\w\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 80) as base from part),
  k as (select *, row_number() over (partition by base order by p_partkey) as k from b)
select p_partkey, base || case when k = 1 then '' else '-v' || k end as title from k""")
def safe_title(t):
    raw = F.concat(F.lit("**"), "p_type", F.lit("**: "), (F.col("p_size") % 5).cast("string"), F.lit("!"))
    from ..plans.usage import file_titles
    return file_titles(t.part.select("p_partkey", raw.alias("title")), "title", "p_partkey").select("p_partkey", F.col("file_title").alias("title"))


@query("strip_markdown", """
select p_partkey, 'Part ' || p_name || ' is ' || p_type || chr(10) || '• code' as plain from part""")
def strip_markdown(t):
    md = F.concat(F.lit("# Part **"), "p_name", F.lit("** is *"), "p_type", F.lit("*\n- `code` "))
    return t.part.select("p_partkey", text.strip_markdown(md).alias("plain"))


@query("goal_text", """
select o_orderkey, trim(o_orderpriority || ' ' || o_orderstatus || case when o_orderkey % 3 = 0 then '' else
  ' Where they help, use varied charts such as: bar, ' || lower(o_orderstatus) || '.' end) as goal,
  case when o_totalprice < 1024 then cast(floor(o_totalprice) as bigint) || ' B' when o_totalprice < 1048576 then cast(floor(floor(o_totalprice) / 1024 + 0.5) as bigint) || ' KB' end as size_text from orders""")
def goal_text(t):
    kinds = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("bar"), F.lower("o_orderstatus")))
    return t.orders.select("o_orderkey", text.goal_text(F.col("o_orderpriority"), F.col("o_orderstatus"), kinds).alias("goal"),
                           text.byte_size_text(F.floor("o_totalprice")).alias("size_text"))


@query("num_basic", """
select l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) as r4, cast(ceil(l_quantity / 7) as bigint) as up, greatest(least(l_quantity, 40), 5) as clamped,
  round(l_tax / (l_discount + 1e-9), 4) as ratio, try_cast(l_returnflag as double) as parsed, abs(l_quantity - 25) as off from lineitem""")
def num_basic(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * d, 4).alias("r4"), F.ceil(q / 7).alias("up"),
        F.greatest(F.least(q, F.lit(40.0)), F.lit(5.0)).alias("clamped"), F.round(F.col("l_tax") / (d + 1e-9), 4).alias("ratio"),
        F.col("l_returnflag").try_cast("double").alias("parsed"), F.abs(q - 25).alias("off"))


@query("date_basic", """
select event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, strftime(date_trunc('month', ts), '%Y-%m-%d') as month,
  date_diff('day', date '2024-01-01', cast(ts as date)) as days, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, strftime(ts + interval 30 day, '%Y-%m-%d') as expires from events""")
def date_basic(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week"), F.date_format(F.date_trunc("month", ts), "yyyy-MM-dd").alias("month"),
        F.datediff(ts, F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.date_format(ts + F.make_interval(days=F.lit(30)), "yyyy-MM-dd").alias("expires"))


@query("array_basic", """
select event_id, array_to_string([event_type, 'k' || (event_id % 3)], ',') as firsts, len(string_split(props, '"')) as parts, list_contains(['click', 'view'], event_type) as seen,
  array_to_string([event_type, 'k' || (event_id % 3)][1:1], ',') as head from events""")
def array_basic(t):
    k = F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))
    firsts = F.array_distinct(F.flatten(F.array(F.array(F.col("event_type"), k), F.array(k, F.col("event_type")))))
    return t.events.select("event_id", F.array_join(firsts, ",").alias("firsts"), F.size(F.split("props", '"')).cast("bigint").alias("parts"),
                           F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("event_type")).alias("seen"),
                           F.array_join(F.slice(firsts, 1, 1), ",").alias("head"))


@query("parse_json_block", """
select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 4 = 0 then 0 else 1 end as ideas,
  case when o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then null else 'Why ' || o_orderpriority end as title,
  case when o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then 'bar,line' else 'pie' end as charts from orders""")
def parse_json_block(t):
    """Ideas inside free text; some items lack a title, some name unknown charts."""
    k = F.col("o_orderkey")
    item = F.concat(F.lit('[{"title": " '), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Why "), "o_orderpriority")),
                    F.lit('", "question": "What moves '), "o_orderstatus", F.lit('?", "chart_types": ["HeatMap"'),
                    F.when(k % 3 == 0, "").otherwise(', " Pie "'), F.lit("]}]"))
    body = F.when(k % 5 == 0, "Sorry, no ideas.").otherwise(F.concat(F.lit("Sure, here:\n"), item, F.lit("\nHope it helps")))
    ideas = t.orders.select("o_orderkey", text.parse_ideas(body).alias("i"))
    first = F.get("i", F.lit(0))
    return ideas.select("o_orderkey", F.when(F.col("i").isNotNull(), F.size("i")).alias("ideas"), first["title"].alias("title"),
                        F.array_join(first["chart_types"], ",").alias("charts"))


# -- user functions --------------------------------------------------------------------

@query("apply_pandas", """
select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge from lineitem""")
def apply_pandas(t):
    def charge(frame):
        frame["charge"] = (frame["l_extendedprice"] * (1 - frame["l_discount"]) * (1 + frame["l_tax"]))
        return frame[["l_orderkey", "l_linenumber", "charge"]]

    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return udf.apply_pandas(df, charge, "l_orderkey bigint, l_linenumber int, charge double").withColumn("charge", F.round("charge", 6))


@query("apply_pandas_first_rows", "select least(count(*), 1000) as row_count, count(*) > 1000 as truncated, 2 as width from lineitem")
def apply_pandas_first_rows(t):
    """A function's rows as a caller gets them: the first thousand, and whether there were more."""
    out = udf.run_user_function(t.lineitem.select("l_orderkey", "l_quantity"), lambda f: f.assign(l_quantity=f["l_quantity"] * 2),
                                "l_orderkey bigint, l_quantity double", max_rows=1000)
    return t.lineitem.agg(F.lit(out.row_count).cast("bigint").alias("row_count"), F.lit(out.truncated).alias("truncated"),
                                      F.lit(len(out.columns)).alias("width"))


@query("apply_pandas_series", "select l_returnflag as label, sum(l_quantity) as value from lineitem group by 1")
def apply_pandas_series(t):
    """A function that gives a series: quantities by return flag, per batch, merged by Spark."""
    return udf.merged_series(t.lineitem.select("l_returnflag", "l_quantity"), lambda f: f.groupby("l_returnflag")["l_quantity"].sum())


@query("apply_pandas_value", "select max(l_extendedprice / l_quantity) as dearest, count(*)::double as n from lineitem")
def apply_pandas_value(t):
    """Functions that give one number."""
    df = t.lineitem.select("l_extendedprice", "l_quantity")
    dearest = udf.run_user_value(df, lambda f: (f["l_extendedprice"] / f["l_quantity"]).max(), "max").value
    n = udf.run_user_value(df, len).value
    return t.lineitem.agg(F.lit(dearest).alias("dearest"), F.lit(n).alias("n"))


@query("apply_pandas_grouped", """
select o_custkey, max(o_totalprice) - min(o_totalprice) as span from orders group by 1""")
def apply_pandas_grouped(t):
    """Lowest and highest price per customer and batch, merged by Spark."""
    def ends(frame):
        price = frame["o_totalprice"]
        return {"o_custkey": frame["o_custkey"].iat[0], "lo": price.min(), "hi": price.max()}

    return udf.apply_pandas_merged(t.orders.select("o_custkey", "o_totalprice"), ends, "o_custkey bigint, lo double, hi double",
                                   ["o_custkey"], [(F.max("hi") - F.min("lo")).alias("span")])
