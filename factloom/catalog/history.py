"""Ledger, usage and streaming queries. The ledger, report history and payment events
are derived from the given tables by the same rule on both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from ..plans import ledger as ledger_plans
from ..plans import usage
from ..session import scratch_dir
from ..streaming import balances as balance_streams
from ..streaming import batches, ingest, trends
from .battery import rounded
from .registry import query

# -- the derived ledger ----------------------------------------------------------

_MOVES = """(select event_id as id, user_id, ts, case event_type when 'signup' then 'signup_bonus' when 'purchase' then 'purchase'
    when 'click' then 'report_hold' when 'view' then 'report_capture' when 'error' then 'report_release' end as entry_type,
  cast(case event_type when 'signup' then 50 when 'purchase' then ceil(value) when 'click' then -10 when 'view' then 0 when 'error' then 10 end as bigint) as amount from events)"""
LEDGER = f"""(with m as (select * from {_MOVES}),
  h as (select id, user_id, row_number() over (partition by user_id order by ts, id) as k from m where entry_type = 'report_hold'),
  s as (select id, user_id, row_number() over (partition by user_id order by ts, id) as k from m where entry_type in ('report_capture', 'report_release'))
  select m.*, h.id as related_hold_id, case when entry_type in ('signup_bonus', 'purchase') then m.user_id || ':' || entry_type || ':' || strftime(m.ts, '%Y-%m-%d') end as idempotency_key
  from m left join s on s.id = m.id left join h on h.user_id = s.user_id and h.k = s.k)"""


def moves(events):
    kind = F.col("event_type")
    entry = (F.when(kind == "signup", "signup_bonus").when(kind == "purchase", "purchase").when(kind == "click", "report_hold")
             .when(kind == "view", "report_capture").when(kind == "error", "report_release"))
    amount = (F.when(kind == "signup", 50).when(kind == "purchase", F.ceil("value")).when(kind == "click", -10)
              .when(kind == "view", 0).when(kind == "error", 10)).cast("bigint")
    return events.select(F.col("event_id").alias("id"), "user_id", "ts", entry.alias("entry_type"), amount.alias("amount"))


def ledger(t):
    m = moves(t.events)
    kth = lambda df: ordered.numbered(df.select("id", "user_id", "ts"), ["user_id"], ["ts", "id"], "k")
    holds = kth(m.where("entry_type = 'report_hold'")).select("user_id", "k", F.col("id").alias("related_hold_id"))
    settles = kth(m.where("entry_type in ('report_capture', 'report_release')")).select("user_id", "k", "id")
    pairs = settles.join(holds, ["user_id", "k"]).select("id", "related_hold_id")
    key = F.when(F.col("entry_type").isin("signup_bonus", "purchase"),
                 F.concat_ws(":", F.col("user_id").cast("string"), "entry_type", F.date_format("ts", "yyyy-MM-dd")))
    return m.join(pairs, "id", "left").withColumn("idempotency_key", key)


@query("balances", f"""
with o as (select user_id, cast(sum(-amount) as bigint) as held from {LEDGER} where entry_type = 'report_hold'
  and id not in (select related_hold_id from {LEDGER} where related_hold_id is not null) group by 1),
  a as (select user_id, cast(sum(amount) as bigint) as available from {LEDGER} group by 1)
select a.user_id, available, coalesce(held, 0) as held, available + coalesce(held, 0) as total from a left join o using (user_id)""")
def balances(t):
    return ledger_plans.balances(ledger(t))


_RUNNING = f"""(select *, cast(sum(amount) over (partition by case when user_id % 10 <> 3 then user_id end order by ts, id) as bigint) as balance_after
  from {LEDGER})"""


@query("running_balance", f"select id, balance_after, id % 97 = 0 as drifted from {_RUNNING}")
def running_balance(t):
    """Every 97th stored balance is off by one; the check must find exactly those. Movements
    without a user have a running balance of their own."""
    rows = moves(t.events).withColumn("user_id", F.when(F.col("user_id") % 10 != 3, F.col("user_id")))
    stored = ledger_plans.running_balance(rows).withColumn(
        "stored", F.col("balance_after") + F.when(F.col("id") % 97 == 0, 1).otherwise(0)).drop("balance_after")
    wrong = ledger_plans.drifted(stored, "stored").select("id", F.lit(True).alias("drifted"))
    return (ledger_plans.running_balance(rows).join(wrong, "id", "left")
            .select("id", "balance_after", F.coalesce("drifted", F.lit(False)).alias("drifted")))


@query("reconcile", f"""
with l as (select user_id, cast(sum(amount) as bigint) as ledger_available from {_MOVES} group by 1),
  c as (select user_id, ledger_available + case when user_id % 10 = 0 then 5 else 0 end as available from l where user_id % 7 <> 0)
select coalesce(l.user_id, c.user_id) as user_id, available, ledger_available from l full join c on l.user_id = c.user_id
where available is distinct from ledger_available or coalesce(available, 0) < 0 or coalesce(ledger_available, 0) < 0""")
def reconcile(t):
    m = moves(t.events)
    cached = m.where("user_id % 7 <> 0").groupBy("user_id").agg(
        (F.sum("amount") + F.when(F.col("user_id") % 10 == 0, 5).otherwise(0)).alias("available"))
    return ledger_plans.reconcile(m, cached)


@query("hold_pairing", f"""
select s.id, s.entry_type, s.related_hold_id as hold_id, cast(date_diff('second', h.ts, s.ts) as bigint) as seconds from {LEDGER} s
left join {LEDGER} h on h.id = s.related_hold_id where s.entry_type in ('report_capture', 'report_release')""")
def hold_pairing(t):
    return ledger_plans.hold_pairing(ledger(t)).select(
        "id", "entry_type", "hold_id", (F.unix_seconds("ts") - F.unix_seconds("hold_ts")).alias("seconds"))


@query("hold_lifecycle", f"""
select h.id as hold_id, h.user_id, -h.amount as amount, case s.entry_type when 'report_capture' then 'captured' when 'report_release' then 'released' else 'open' end as outcome,
  cast(date_diff('second', h.ts, s.ts) as bigint) as settle_seconds from {LEDGER} h left join {LEDGER} s on s.related_hold_id = h.id where h.entry_type = 'report_hold'""")
def hold_lifecycle(t):
    return ledger_plans.hold_lifecycle(ledger(t))


@query("report_cost", """
select o_orderkey, cost, case when cost <= 0 then 0 else greatest(1, cast(round_even(cost / 3.0, 0) as bigint)) end as again from (
  select o_orderkey, cast(case when o_totalprice >= 250000 then ceil(base * 1.5) else base end as bigint) as cost from (
    select *, case o_orderstatus when 'F' then 5 when 'O' then 10 else 20 end as base from orders))""")
def report_cost(t):
    kind = F.when(F.col("o_orderstatus") == "F", "quick").when(F.col("o_orderstatus") == "O", "standard").otherwise("deep")
    rows = F.floor(F.col("o_totalprice") / 5)
    cost = ledger_plans.report_cost(kind, rows)
    return t.orders.select("o_orderkey", cost.alias("cost"), ledger_plans.regeneration_cost(cost).alias("again"))


@query("token_cost", """
select o_orderkey, round(o_orderkey % 5000 * 10 / 1e6 * 0.30 + o_custkey * 10 / 1e6 * 2.50, 6) as cost from orders""")
def token_cost(t):
    return t.orders.select("o_orderkey", ledger_plans.token_cost(F.col("o_orderkey") % 5000 * 10, F.col("o_custkey") * 10).alias("cost"))


_LOW = f"""(with r as (select id, user_id, ts, amount, sum(amount) over w as s from {_MOVES} window w as (partition by user_id order by ts, id)),
  m as (select *, min(s) over (partition by user_id order by ts, id) as low,
    min(s) over (partition by user_id order by ts, id rows between unbounded preceding and 1 preceding) as before from r)
  select id, cast(s - least(0, low) as bigint) as available,
    cast(case when amount < 0 then least(-amount, s - amount - least(0, coalesce(before, 0))) else 0 end as bigint) as taken from m)"""


@query("clamped_removal", f"select * from {_LOW}")
def clamped_removal(t):
    return ledger_plans.clamped_removal(moves(t.events)).select("id", "available", "taken")


@query("free_credit_expiry", f"""
select user_id, cast(sum(amount) as bigint) as expired, count(*) as grants from {_MOVES}
where entry_type = 'signup_bonus' and ts + interval 30 day < timestamp '2024-02-15' group by 1""")
def free_credit_expiry(t):
    return ledger_plans.free_credit_expiry(moves(t.events), F.lit("2024-02-15").cast("timestamp"))


@query("idempotent_grants_batch", f"""
select id, user_id, amount from {LEDGER} where entry_type in ('signup_bonus', 'purchase')
qualify row_number() over (partition by idempotency_key order by ts, id) = 1""")
def idempotent_grants_batch(t):
    grants = ledger(t).where("entry_type in ('signup_bonus', 'purchase')")
    return ledger_plans.first_per_key(grants, "idempotency_key", ["ts", "id"]).select("id", "user_id", "amount")


_PACKS = "(select p_partkey as pack_id, p_brand as pack, p_size as credits, p_partkey % 4 as bonus, p_partkey % 3 = 0 as active, p_size as sort_order from part)"


def packs(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("pack_id"), F.col("p_brand").alias("pack"), F.col("p_size").alias("credits"), (k % 4).alias("bonus"),
                         (k % 3 == 0).alias("active"), F.col("p_size").alias("sort_order"))


@query("purchases_by_pack", f"""
select p.pack_id, pack, status, count(*) as purchases, cast(sum(ceil(value)) as bigint) as credits, cast(sum(ceil(value) * 3) as bigint) as price from (
  select event_id % 200 + 1 as pack_id, case when event_id % 11 = 0 then 'refunded' else 'completed' end as status, value from events where event_type = 'purchase') p
join {_PACKS} k on k.pack_id = p.pack_id group by 1, 2, 3""")
def purchases_by_pack(t):
    bought = t.events.where("event_type = 'purchase'").select(
        (F.col("event_id") % 200 + 1).alias("pack_id"), F.when(F.col("event_id") % 11 == 0, "refunded").otherwise("completed").alias("status"),
        F.ceil("value").alias("credits"), (F.ceil("value") * 3).alias("price"))
    return ledger_plans.purchases_by_pack(bought, packs(t)).select("pack_id", "pack", "status", "purchases", "credits", "price")


@query("active_packs", f"select pack_id, pack, credits + bonus as total from {_PACKS} where active order by sort_order, pack_id")
def active_packs(t):
    return ledger_plans.active_packs(packs(t)).select("pack_id", "pack", "total")


_PAYMENTS = "(select event_id, ts, 'p' || (event_id // 3) as pid, event_id % 5 as place, event_id % 4 as kind from events)"


def payments(t):
    """Paid events carrying the purchase id in one of five places, with an empty string
    in an earlier one now and then."""
    pid = F.concat(F.lit("p"), F.floor(F.col("event_id") / 3).cast("string"))
    place, kind = F.col("event_id") % 5, F.col("event_id") % 4
    at = lambda n: F.when(place == n, pid)
    notes = lambda n: F.struct(at(n).alias("purchase_id"))
    event = F.element_at(F.array(*[F.lit(x) for x in ("payment_link.paid", "order.paid", "payment.captured", "payment.failed")]), (kind + 1).cast("int"))
    body = F.struct(event.alias("event"), F.struct(
        F.struct(F.struct(notes(0).alias("notes"), F.when(place == 1, pid).when(place == 2, "").alias("reference_id")).alias("entity")).alias("payment_link"),
        F.struct(F.struct(notes(2).alias("notes"), at(3).alias("receipt")).alias("entity")).alias("order"),
        F.struct(F.struct(notes(4).alias("notes"), F.lit("pay").alias("id")).alias("entity")).alias("payment")).alias("payload"))
    return t.events.select("event_id", "ts", F.to_json(body).alias("payload"))


@query("event_completion", f"""
select pid as purchase_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) as event_id, count(*) as events from {_PAYMENTS} where kind < 3 group by 1""")
def event_completion(t):
    return ledger_plans.completed_purchases(payments(t))


# -- report history ------------------------------------------------------------------

REPORTS = """(select o_orderkey as id, o_custkey % 100 as user_id, o_custkey % 7 as dataset_id, o_orderpriority as goal,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status, o_orderdate as created_at,
  case when o_totalprice >= 250000 then 15 else 10 end as credit_cost, cast(floor(o_totalprice / 100) as bigint) as row_count, o_orderkey % 11 = 0 as archived from orders)"""


def reports(t):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return t.orders.select(
        k.alias("id"), (c % 100).alias("user_id"), (c % 7).alias("dataset_id"), F.col("o_orderpriority").alias("goal"),
        F.when(s == "F", "completed").when(s == "O", "running").otherwise("failed").alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_totalprice") >= 250000, 15).otherwise(10).alias("credit_cost"), F.floor(F.col("o_totalprice") / 100).alias("row_count"),
        (k % 11 == 0).alias("archived"))


def sections(t):
    """Report content from line items: a section per line number, a chart per line."""
    kind = F.when(F.col("l_returnflag") == "N", "bar").when(F.col("l_returnflag") == "A", "line").otherwise("scatter")
    chart = F.struct("l_partkey", "l_suppkey", kind.alias("type"))
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.sort_array(F.collect_list(chart)).alias("charts"))
    return per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "charts"))).alias("content"))


_CHARTS = """(select l_orderkey as id, l_linenumber as section, l_partkey as p, l_suppkey as s,
  case l_returnflag when 'N' then 'bar' when 'A' then 'line' else 'scatter' end as type from lineitem)"""


@query("owner_archived_filter", f"""
select id, goal, status from {REPORTS} where user_id = 42 and not archived order by created_at desc, id desc""")
def owner_archived_filter(t):
    return usage.owned(reports(t), 42).select("id", "goal", "status")


@query("cached_report_lookup", f"""
with d as (select *, row_number() over (partition by user_id, dataset_id, goal order by created_at desc, id desc) as n from {REPORTS} where status = 'completed'),
  k as (select user_id, dataset_id, goal, max(id) filter (where n = 1) as a, max(id) filter (where n = 2) as b from d group by 1, 2, 3)
select r.id, case when k.a <> r.id then k.a else k.b end as cached_id from {REPORTS} r left join k using (user_id, dataset_id, goal)""")
def cached_report_lookup(t):
    return usage.cached_report(reports(t))


@query("report_versions", f"""
select id, row_number() over (partition by user_id, dataset_id, goal order by created_at, id) as version,
  count(*) over (partition by user_id, dataset_id, goal) as versions,
  first_value(id) over (partition by user_id, dataset_id, goal order by created_at desc, id desc) as newest_id
from (select * replace (nullif(goal, '2-HIGH') as goal, nullif(dataset_id, 3) as dataset_id) from {REPORTS}) where not archived""")
def report_versions(t):
    """Reports without a goal or a dataset are versions of each other."""
    some = reports(t).withColumns({"goal": F.nullif("goal", F.lit("2-HIGH")), "dataset_id": F.nullif("dataset_id", F.lit(3))})
    return usage.report_versions(some).select("id", "version", "versions", "newest_id")


@query("content_stats", f"""
with f as (select id, type, min(cast(section as bigint) * 1000000000000 + cast(p as bigint) * 1000000 + s) as seen from {_CHARTS} group by 1, 2)
select c.id, count(distinct section) as section_count, count(*) as chart_count,
  (select string_agg(type, ',' order by seen) from f where f.id = c.id) as chart_types from {_CHARTS} c group by c.id""")
def content_stats(t):
    return usage.content_stats(sections(t)).select(
        "id", F.col("section_count").cast("bigint"), F.col("chart_count").cast("bigint"), F.array_join("chart_types", ",").alias("chart_types"))


@query("chart_mix", f'select type, count(*) as "count" from {_CHARTS} group by 1')
def chart_mix(t):
    return usage.chart_mix(sections(t))


@query("dashboard_kpis", f"""
with c as (select id, count(distinct section) as sc, count(*) as cc from {_CHARTS} group by 1),
  r as (select r.*, coalesce(sc, 0) as sc, coalesce(cc, 0) as cc from {REPORTS} r left join c using (id) where status = 'completed')
select cast(sum(credit_cost) as bigint) as credits_used, count(*) as reports_made, cast(sum(row_count) as bigint) as rows_analysed,
  (select id from r order by cc desc, sc desc, id desc limit 1) as featured_id from r""")
def dashboard_kpis(t):
    return usage.dashboard_kpis(reports(t).join(sections(t), "id", "left"))


@query("affordability", f"""
with b as (select user_id, cast(sum(amount) as bigint) as available from {_MOVES} group by 1),
  q as (select user_id, dataset_id, count(*) * 2500 as row_count from {REPORTS} group by 1, 2)
select q.user_id, q.dataset_id, cast(case when row_count >= 50000 then 15 else 10 end as bigint) as cost, coalesce(available, 0) as available,
  coalesce(available, 0) >= case when row_count >= 50000 then 15 else 10 end as affordable from q left join b on b.user_id = q.user_id""")
def affordability(t):
    quotes = reports(t).groupBy("user_id", "dataset_id").agg((F.count("*") * 2500).alias("row_count"))
    return ledger_plans.affordability(ledger(t), quotes).select("user_id", "dataset_id", "cost", "available", "affordable")


_SECTION_ROWS = """(select l_orderkey as report_id, l_returnflag as flag, l_linenumber as number,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as section from lineitem)"""


@query("assemble_sections", f"""
select report_id, section, 'Line ' || number as title, flag || '-' || flag as narrative, lower(flag) as charts from {_SECTION_ROWS}""")
def assemble_sections(t):
    """Six events per line: a stray token before each section start is ignored."""
    n = ordered.numbered(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "rank")
    flag = F.col("l_returnflag")
    events = [("token", F.lit("stray")), ("section_start", F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"))),
              ("token", F.concat(flag, F.lit("-"))), ("token", flag), ("chart", F.lower(flag)), ("section_end", F.lit(None).cast("string"))]
    log = n.select(F.col("l_orderkey").alias("report_id"), F.inline(F.array(*[
        F.struct((F.col("rank") * len(events) + i).alias("seq"), F.lit(e).alias("event"), d.alias("data")) for i, (e, d) in enumerate(events)])))
    return usage.assemble_sections(log).select("report_id", "section", "title", "narrative", F.array_join("charts", ",").alias("charts"))


@query("recent_turns", """
select conv_id, turn, role, md5(text) as digest from conversations where role in ('user', 'assistant') and length(text) > 0
qualify row_number() over (partition by conv_id order by turn desc) <= 12""")
def recent_turns(t):
    return usage.recent_turns(t.conversations).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("suggestion_funnel", """
select o_custkey % 7 as dataset_id, count(*) filter (where o_orderstatus = 'O') as suggested, count(*) filter (where o_orderstatus = 'F') as generated,
  count(*) filter (where o_orderstatus = 'P') as dismissed from orders group by 1""")
def suggestion_funnel(t):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "generated").when(s == "O", "suggested").otherwise("dismissed")
    return usage.suggestion_funnel(t.orders.select((F.col("o_custkey") % 7).alias("dataset_id"), status.alias("status")))


@query("signup_segments", """
select c_mktsegment as referral_source, c_nationkey % 6 as use_purpose, c_acctbal > 0 as verified, count(*) as users from customer group by 1, 2, 3""")
def signup_segments(t):
    return usage.signup_segments(t.customer.select(F.col("c_mktsegment").alias("referral_source"), (F.col("c_nationkey") % 6).alias("use_purpose"),
                                                   (F.col("c_acctbal") > 0).alias("verified")))


# -- streams -----------------------------------------------------------------------------

@query("ingest_stream", """
select event_type, count(*) as n, count(value) as valued, strftime(max(ts), '%Y-%m-%d') as last_day, sum(length('say "hi", ' || event_id || chr(10) || 'again'))::bigint as said from (
  select event_id, event_type, ts, nullif(value, 0) as value from events) group by 1""")
def ingest_stream(t):
    """Files with two orders of columns, quotes, line breaks and an extra column."""
    landing, target = scratch_dir(t.spark, "landing"), scratch_dir(t.spark, "ingested")
    df = t.events.select("event_id", F.concat(F.lit(" "), "event_type", F.lit("  ")).alias("event_type"),
                         F.coalesce(F.concat(F.lit("$"), F.nullif("value", F.lit(0.0)).cast("string")), F.lit("N/A")).alias("value"),
                         F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("ts"),
                         F.concat(F.lit('say "hi", '), F.col("event_id").cast("string"), F.lit("\nagain")).alias("said"), F.lit(1).alias("more"))
    for k, order in enumerate((["event_id", "event_type", "value", "ts", "said"], ["said", "ts", "more", "event_id", "value", "event_type"])):
        df.where(F.col("event_id") % 2 == k).select(*order).write.option("header", True).option("escape", '"').csv(f"{landing}/{k}")
    ingest.ingest_stream(t.spark, landing, target, f"{target}/checkpoint",
                         {"event_id": "number", "event_type": "text", "value": "number", "ts": "timestamp", "said": "text"}, files_per_batch=3)
    return t.spark.read.parquet(f"{target}/data").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("value").alias("valued"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
        F.sum(F.length("said")).alias("said"))


@query("profile_stream", "\nunion all\n".join(f"""
select '{c}' as name, count(*) as "rows", count(*) - count({c}) as nulls, cast(min({c}) as double) as min, cast(max({c}) as double) as max, round(avg({c}), 4) as mean,
  round(stddev_samp({c}), 4) as std, cast(cast(min({c}) as bigint) as varchar) as min_text, cast(cast(max({c}) as bigint) as varchar) as max_text from {v}"""
    for c, v in (("user_id", "events"), ("far", "(select 1000000000 + event_id % 7 as far from events)"))))
def profile_stream(t):
    """Several batches of files, one column far from zero."""
    landing, root = scratch_dir(t.spark, "batches"), scratch_dir(t.spark, "profile")
    rows = t.events.select("user_id", (1000000000 + F.col("event_id") % 7).alias("far"))
    rows.repartition(6).write.parquet(landing)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    out = ingest.profile_stream(stream, f"{root}/state", f"{root}/checkpoint")
    return rounded(out, "mean", "std").select("name", "rows", "nulls", "min", "max", "mean", "std", "min_text", "max_text")


def _twice(stream):
    """Each event delivered twice."""
    return stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")


@query("dedupe_events", "select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def dedupe_events(t):
    stream = _twice(batches.table_stream(t.spark, t.sf_dir, "events").select("event_id", "ts", "event_type"))
    out = batches.collected(t.spark, trends.dedupe_events(stream, "ts"), "dedupe")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("idempotent_grants", f"""
select user_id, count(distinct idempotency_key) + 2 * count(*) filter (where id % 5 = 0) as grants from (
  select user_id, id, case when id % 5 > 0 then idempotency_key end as idempotency_key from {LEDGER} where idempotency_key is not null) group by 1""")
def idempotent_grants(t):
    """Every grant comes twice; a fifth have no key, so both of them count."""
    m = moves(batches.table_stream(t.spark, t.sf_dir, "events"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), "entry_type", F.date_format("ts", "yyyy-MM-dd"))
    grants = m.where("entry_type in ('signup_bonus', 'purchase')").withColumn("idempotency_key", F.when(F.col("id") % 5 > 0, key))
    out = batches.collected(t.spark, trends.idempotent_grants(_twice(grants)), "grants")
    return out.groupBy("user_id").agg(F.count("*").alias("grants"))


_STEPS = f"""(with recursive m as (select *, row_number() over (partition by user_id order by ts, id) as k from {_MOVES}),
  s(id, user_id, k, accepted, available, held) as (
    select cast(0 as bigint), user_id, cast(0 as bigint), true, cast(0 as bigint), cast(0 as bigint) from (select distinct user_id from events)
    union all
    select m.id, m.user_id, m.k,
      case m.entry_type when 'report_hold' then s.available >= -m.amount when 'report_capture' then s.held >= 0 when 'report_release' then s.held >= m.amount else true end,
      cast(case when m.entry_type in ('signup_bonus', 'purchase') then s.available + m.amount
        when m.entry_type = 'report_hold' and s.available >= -m.amount then s.available + m.amount
        when m.entry_type = 'report_release' and s.held >= m.amount then s.available + m.amount else s.available end as bigint),
      cast(case when m.entry_type = 'report_hold' and s.available >= -m.amount then s.held - m.amount
        when m.entry_type = 'report_release' and s.held >= m.amount then s.held - m.amount else s.held end as bigint)
    from s join m on m.user_id = s.user_id and m.k = s.k + 1)
  select id, user_id, accepted, available, held from s where k > 0)"""


@query("balance_stream", f"select * from {_STEPS}")
def balance_stream(t):
    m = moves(batches.table_stream(t.spark, t.sf_dir, "events", 1 << 30))
    return batches.collected(t.spark, balance_streams.balance_stream(m), "balances").drop("batch_id")


@query("balance_batch", f"select * from {_STEPS}")
def balance_batch(t):
    return balance_streams.balance_batch(moves(t.events))


@query("trend_stream", """
select strftime(cast(ts as date), '%Y-%m-%d') as day, round(avg(value), 8) as mean, count(value) as n from events group by 1""")
def trend_stream(t):
    stream = batches.table_stream(t.spark, t.sf_dir, "events")
    out = batches.latest(batches.collected(t.spark, trends.trend_stream(stream, "ts", "value"), "trend", "update"), ["start", "end"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("mean", 8).alias("mean"), "n")


@query("trend_stream_sliding", """
with d as (select generate_series as start from generate_series(timestamp '2023-12-31 12:00:00', timestamp '2024-02-05', interval 12 hour))
select strftime(start, '%Y-%m-%d %H') as start, event_type, round(avg(value), 8) as mean, count(value) as n
from d join events on ts >= start and ts < start + interval 1 day group by 1, 2""")
def trend_stream_sliding(t):
    stream = batches.table_stream(t.spark, t.sf_dir, "events")
    s = trends.trend_stream(stream, "ts", "value", "1 day", "12 hours", keys=["event_type"])
    out = batches.latest(batches.collected(t.spark, s, "sliding", "update"), ["start", "end", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", F.round("mean", 8).alias("mean"), "n")


_SESSIONS = """
with g as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(value) as n, round(avg(value), 8) as mean from s group by user_id, session"""


@query("trend_stream_sessions", _SESSIONS)
def trend_stream_sessions(t):
    stream = batches.table_stream(t.spark, t.sf_dir, "events")
    s = trends.session_stream(stream, "ts", "value", ["user_id"], "6 hours", late="40 days")
    # Sessions can merge between batches, so the whole result is read from the last one.
    out = batches.collected(t.spark, s, "sessions", "complete")
    last = out.agg(F.max("batch_id")).first()[0]
    return out.where(F.col("batch_id") == last).select(
        "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean", 8).alias("mean"))


def _shares(t, label, shares):
    """Goes for ``accounted``: each writes its share of rows into one folder, which is read as a stream."""
    landing = scratch_dir(t.spark, label)
    schema = shares[0].schema

    def go(k, rows):
        def put():
            rows.write.parquet(f"{landing}/part={k}")
            return t.spark.readStream.schema(schema).parquet(f"{landing}/part=*")
        return put
    return [go(k, rows) for k, rows in enumerate(shares)]


@query("session_stream_append", _SESSIONS)
def session_stream_append(t):
    """Sessions given out once, when they are over. The last ones end by a marker far ahead in time."""
    events = t.events.select("user_id", "ts", "value")
    end = t.events.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(
        F.lit(None).cast("bigint").alias("user_id"), "ts", F.lit(None).cast("double").alias("value"))
    goes = _shares(t, "sessions", [events, end])
    stream = lambda go: lambda: trends.session_stream(go(), "ts", "value", ["user_id"], "6 hours", late="40 days")
    out = batches.accounted(t.spark, [stream(g) for g in goes], "append")
    return out.rows.where("user_id is not null").select(
        "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("mean", 8).alias("mean"))


_CUT = "(select max(ts) - interval 1 day as cut, max(ts) - interval 2 day as mark from events)"


@query("late_rows", f"""
select event_type, count(*) filter (where ts >= cut or ts > mark) as kept,
  (select count(*) from events, {_CUT} where ts <= mark) as late, (select 2 * count(*) from events, {_CUT} where ts > mark)
  + (select count(*) from events, {_CUT} where ts <= mark) as read
from events, {_CUT} group by 1 having kept > 0""")
def late_rows(t):
    """Events of the last day come first, twice each; then all older ones, of which those beyond the
    watermark of two days are first deliveries that come too late. Every row read is kept, a repeat or late."""
    events = t.events.select("event_id", "ts", "event_type")
    last = t.events.agg(F.max("ts")).first()[0]
    dated = events.withColumn("day", F.when(F.col("ts") >= F.lit(last) - F.expr("interval 1 day"), 0).when(
        F.col("ts") > F.lit(last) - F.expr("interval 2 days"), 1).otherwise(2))
    of = lambda *days: dated.where(F.col("day").isin(*days)).select("event_id", "ts", "event_type")
    goes = _shares(t, "late", [_twice(of(0)), _twice(of(1)).union(of(2))])
    stream = lambda go: lambda: trends.dedupe_events(go(), "ts")
    out = batches.accounted(t.spark, [stream(g) for g in goes], "late")
    return out.rows.groupBy("event_type").agg(F.count("*").alias("kept")).select(
        "event_type", "kept", F.lit(out.late).cast("bigint").alias("late"), F.lit(out.read).cast("bigint").alias("read"))
