"""Analytics over an append-only credit ledger: (id, user_id, ts, entry_type, amount,
related_hold_id, idempotency_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ROWS_PER_RANGE, Running, range_bounds, running

# Prices and terms.
BASE_COST = {"quick": 5, "standard": 10, "deep": 20}
LARGE_ROWS = 50_000
LARGE_FACTOR = 1.5
REGENERATION_DIVISOR = 3
FREE_CREDIT_DAYS = 30
DOLLARS_PER_MILLION_IN = 0.30
DOLLARS_PER_MILLION_OUT = 2.50
# end of fixed values

HOLD, CAPTURE, RELEASE = "report_hold", "report_capture", "report_release"


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows that share a key only the first counts; rows without a key all do. The
    rank filter is applied before the shuffle too, so a hot key sends one row per task."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def open_holds(ledger: DataFrame) -> DataFrame:
    """Holds that no capture or release refers to."""
    settled = ledger.where(F.col("entry_type").isin(CAPTURE, RELEASE) & F.col("related_hold_id").isNotNull())
    return ledger.where(F.col("entry_type") == HOLD).join(
        settled.select(F.col("related_hold_id").alias("id")), "id", "left_anti")


def balances(ledger: DataFrame) -> DataFrame:
    """(user_id, available, held, total)."""
    held = open_holds(ledger).select("user_id", F.lit(0).cast("bigint").alias("a"), (-F.col("amount")).alias("h"))
    moves = ledger.select("user_id", F.col("amount").alias("a"), F.lit(0).cast("bigint").alias("h"))
    return moves.unionByName(held).groupBy("user_id").agg(
        F.sum("a").alias("available"), F.sum("h").alias("held"), F.sum(F.col("a") + F.col("h")).alias("total"))


def running_balance(ledger: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``balance_after``."""
    return running(ledger, ["user_id"], ["ts", "id"], [Running("balance_after", "sum", F.col("amount"))], rows_per_range)


def drifted(ledger: DataFrame, stored: str) -> DataFrame:
    """Rows whose stored running balance differs from the recomputed one."""
    return running_balance(ledger).where(~F.col(stored).eqNullSafe(F.col("balance_after")))


def reconcile(ledger: DataFrame, cached: DataFrame) -> DataFrame:
    """Users whose cached balance differs from the ledger or is negative: (user_id,
    available, ledger_available)."""
    truth = ledger.groupBy("user_id").agg(F.sum("amount").alias("ledger_available"))
    both = cached.select("user_id", "available").join(truth, "user_id", "full")
    return both.where(~F.col("available").eqNullSafe(F.col("ledger_available"))
                      | (F.coalesce("available", F.lit(0)) < 0) | (F.coalesce("ledger_available", F.lit(0)) < 0))


def hold_pairing(ledger: DataFrame) -> DataFrame:
    """Each capture or release with its hold: (id, entry_type, hold_id, hold_ts, ts)."""
    settle = ledger.where(F.col("entry_type").isin(CAPTURE, RELEASE))
    holds = ledger.where(F.col("entry_type") == HOLD).select(
        F.col("id").alias("related_hold_id"), F.col("ts").alias("hold_ts"), F.col("amount").alias("hold_amount"))
    return settle.join(holds, "related_hold_id", "left").select(
        "id", "user_id", "entry_type", F.col("related_hold_id").alias("hold_id"), "hold_ts", "ts", "hold_amount")


def hold_lifecycle(ledger: DataFrame) -> DataFrame:
    """(hold_id, user_id, amount, outcome, settle_seconds) of every hold."""
    holds = ledger.where(F.col("entry_type") == HOLD).select(
        F.col("id").alias("hold_id"), "user_id", F.col("ts").alias("held_at"), (-F.col("amount")).alias("amount"))
    # One settlement per hold counts, the earliest.
    settle = ledger.where(F.col("entry_type").isin(CAPTURE, RELEASE) & F.col("related_hold_id").isNotNull()).groupBy(
        F.col("related_hold_id").alias("hold_id")).agg(
        F.min_by("entry_type", F.struct("ts", "id")).alias("how"), F.min("ts").alias("settled_at"))
    outcome = F.when(F.col("how") == CAPTURE, "captured").when(F.col("how") == RELEASE, "released").otherwise("open")
    return holds.join(settle, "hold_id", "left").select(
        "hold_id", "user_id", "amount", outcome.alias("outcome"),
        (F.unix_seconds("settled_at") - F.unix_seconds("held_at")).alias("settle_seconds"))


def clamped_removal(ledger: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Balance when every removal takes at most what is there: adds ``available`` and
    ``taken``.

    max(b + x, 0) applied step by step equals the plain running sum minus its lowest
    value so far (if below zero), so no step-by-step state is needed.
    """
    bounds = range_bounds(ledger, "ts", rows_per_range)
    summed = running(ledger, ["user_id"], ["ts", "id"], [Running("_sum", "sum", F.col("amount"))], bounds=bounds)
    low = running(summed, ["user_id"], ["ts", "id"], [
        Running("_low", "min", F.col("_sum")), Running("_low_before", "min", F.col("_sum"), inclusive=False)], bounds=bounds)
    floor = lambda c: F.least(F.lit(0).cast("bigint"), F.coalesce(c, F.lit(0).cast("bigint")))
    before = F.col("_sum") - F.col("amount") - floor(F.col("_low_before"))
    return low.select(*ledger.columns, (F.col("_sum") - floor(F.col("_low"))).alias("available"),
                      F.when(F.col("amount") < 0, F.least(-F.col("amount"), before)).otherwise(F.lit(0)).alias("taken"))


def free_credit_expiry(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Bonus credits past their term per user: (user_id, expired, grants)."""
    term = F.coalesce(F.col("expires_at"), F.col("ts") + F.make_interval(days=F.lit(FREE_CREDIT_DAYS))) \
        if "expires_at" in ledger.columns else F.col("ts") + F.make_interval(days=F.lit(FREE_CREDIT_DAYS))
    return (ledger.where((F.col("entry_type") == "signup_bonus") & (term < as_of))
            .groupBy("user_id").agg(F.sum("amount").alias("expired"), F.count(F.lit(1)).alias("grants")))


# -- prices ----------------------------------------------------------------------

def report_cost(report_class: Column, rows: Column) -> Column:
    base = F.lit(BASE_COST["standard"])
    for name, cost in BASE_COST.items():
        base = F.when(report_class == name, cost).otherwise(base)
    return F.when(F.coalesce(rows, F.lit(0)) >= LARGE_ROWS, F.ceil(base * F.lit(LARGE_FACTOR))).otherwise(base).cast("bigint")


def regeneration_cost(cost: Column) -> Column:
    return F.when(cost <= 0, 0).otherwise(F.greatest(F.lit(1), F.bround(cost / REGENERATION_DIVISOR, 0))).cast("bigint")


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(tokens_in / 1e6 * DOLLARS_PER_MILLION_IN + tokens_out / 1e6 * DOLLARS_PER_MILLION_OUT, 6)


def affordability(ledger: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes (user_id, dataset_id, row_count) with cost, available and affordable."""
    have = balances(ledger).select("user_id", "available")
    priced = quotes.withColumn("cost", report_cost(F.lit("standard"), F.col("row_count")))
    joined = priced.join(have, "user_id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return joined.withColumn("affordable", F.col("available") >= F.col("cost"))


# -- purchases ---------------------------------------------------------------------

def purchases_by_pack(purchases: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, status, purchases, credits, price) from (pack_id, status, credits, price)."""
    per = purchases.groupBy("pack_id", "status").agg(
        F.count(F.lit(1)).alias("purchases"), F.sum("credits").alias("credits"), F.sum("price").alias("price"))
    return per.join(packs.select("pack_id", "pack"), "pack_id")


def active_packs(packs: DataFrame) -> DataFrame:
    return packs.where("active").withColumn("total", F.col("credits") + F.col("bonus")).orderBy("sort_order", "pack_id")


def completed_purchases(events: DataFrame) -> DataFrame:
    """Paid provider events (event_id, ts, payload) resolved to one row per purchase.
    Several kinds of event report one payment; the earliest stands."""
    entity = lambda more: f"struct<entity:struct<notes:struct<purchase_id:string>,{more}:string>>"
    shape = f"event string, payload struct<payment_link:{entity('reference_id')},order:{entity('receipt')},payment:{entity('id')}>"
    # Parsed once; notes that are no object leave the other fields as they are.
    events = events.withColumn("_said", F.from_json("payload", shape))
    at = lambda path: F.nullif(F.col(f"_said.payload.{path}"), F.lit(""))
    purchase = F.coalesce(at("payment_link.entity.notes.purchase_id"), at("payment_link.entity.reference_id"),
                          at("order.entity.notes.purchase_id"), at("order.entity.receipt"), at("payment.entity.notes.purchase_id"))
    kind = F.col("_said.event")
    return (events.where(kind.isin("payment_link.paid", "order.paid", "payment.captured"))
            .withColumn("purchase_id", purchase).where("purchase_id is not null").groupBy("purchase_id")
            .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("events")))
