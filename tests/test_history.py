import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.plans import ledger, usage
from factloom.session import scratch_dir
from factloom.streaming import balances, batches, ingest, trends


@pytest.fixture(scope="module")
def moves(spark):
    """Movements of five users; user 1 has more than half of them."""
    rnd = random.Random(8)
    kinds = {"signup_bonus": 30, "purchase": 12, "report_hold": -10, "report_capture": 0, "report_release": 10}
    rows = []
    for i in range(400):
        kind = rnd.choice(list(kinds))
        rows.append((i, 1 if rnd.random() < 0.6 else rnd.randint(2, 5), pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rnd.randint(0, 3000)),
                     kind, kinds[kind] if kind != "report_hold" else rnd.choice([-10, -25])))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "user_id", "ts", "entry_type", "amount"])).cache()


def by_user(moves):
    pdf = moves.toPandas().sort_values(["ts", "id"])
    return {u: g for u, g in pdf.groupby("user_id")}


@pytest.mark.parametrize("size", [10_000, 30])
def test_clamped_removal_step_by_step(moves, size):
    want = {}
    for g in by_user(moves).values():
        have = 0
        for r in g.itertuples():
            taken = min(-r.amount, have) if r.amount < 0 else 0
            have = have + r.amount if r.amount >= 0 else have - taken
            want[r.id] = (have, taken)
    got = {r["id"]: (r["available"], r["taken"]) for r in ledger.clamped_removal(moves, size).collect()}
    assert got == want


def test_running_balance_and_drift(moves):
    got = {r["id"]: r["balance_after"] for r in ledger.running_balance(moves, 25).collect()}
    want = {}
    for g in by_user(moves).values():
        want.update(dict(zip(g["id"], g["amount"].cumsum())))
    assert got == want
    stored = ledger.running_balance(moves).withColumn("stored", F.when(F.col("id") != 5, F.col("balance_after"))).drop("balance_after")
    assert [r["id"] for r in ledger.drifted(stored, "stored").collect()] == [5]


def expected_outcomes(moves):
    want = {}
    for g in by_user(moves).values():
        a = h = 0
        for r in g.itertuples():
            ok, a, h = balances.settle(r.entry_type, r.amount, a, h)
            want[r.id] = (ok, a, h)
    return want


def test_settle_rules():
    assert balances.settle("report_hold", -10, 5, 0) == (False, 5, 0)
    assert balances.settle("report_hold", -10, 10, 0) == (True, 0, 10)
    assert balances.settle("report_release", 10, 0, 10) == (True, 10, 0)
    assert balances.settle("report_release", 10, 3, 5) == (False, 3, 5)
    assert balances.settle("purchase", 7, 1, 0) == (True, 8, 0)


def test_batch_and_stream_balances_agree(spark, moves):
    want = expected_outcomes(moves)
    got = {r["id"]: (r["accepted"], r["available"], r["held"]) for r in balances.balance_batch(moves).collect()}
    assert got == want
    assert min(v[1] for v in want.values()) >= 0 and any(not v[0] for v in want.values())
    # Four files in time order, one per micro-batch.
    root = scratch_dir(spark, "moves")
    pdf = moves.toPandas().sort_values(["ts", "id"])
    for i in range(4):
        spark.createDataFrame(pdf.iloc[i * 100:(i + 1) * 100]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = batches.collected(spark, balances.balance_stream(stream), "bal")
    assert out.select("batch_id").distinct().count() == 4
    assert {r["id"]: (r["accepted"], r["available"], r["held"]) for r in out.collect()} == want


def test_holds(spark):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, 1, t(0), "purchase", 100, None), (2, 1, t(1), "report_hold", -10, None), (3, 1, t(2), "report_hold", -10, None),
            (4, 1, t(3), "report_hold", -10, None), (5, 1, t(4), "report_capture", 0, 2), (6, 1, t(9), "report_release", 10, 3)]
    df = spark.createDataFrame(rows, "id long, user_id long, ts timestamp, entry_type string, amount long, related_hold_id long")
    b = ledger.balances(df).first()
    assert (b["available"], b["held"], b["total"]) == (80, 10, 90)
    life = {r["hold_id"]: (r["outcome"], r["settle_seconds"]) for r in ledger.hold_lifecycle(df).collect()}
    assert life == {2: ("captured", 180), 3: ("released", 420), 4: ("open", None)}
    cached = spark.createDataFrame([(1, 85), (2, -5)], "user_id long, available long")
    assert {r["user_id"] for r in ledger.reconcile(df, cached).collect()} == {1, 2}


def test_prices(spark):
    def one(expr):
        return spark.range(1).select(expr).first()[0]
    assert [one(ledger.report_cost(F.lit(k), F.lit(n))) for k, n in (("quick", 1), ("quick", 50_000), ("deep", 50_000), ("other", None))] == [5, 8, 30, 10]
    assert [one(ledger.regeneration_cost(F.lit(c))) for c in (0, 1, 5, 10, 15)] == [0, 1, 2, 3, 5]
    assert one(ledger.token_cost(F.lit(1_000_000), F.lit(100_000))) == 0.55


def test_cached_report_never_answers_itself(spark):
    rows = [(i, 1, 1, "g", "completed" if i in (1, 3, 4) else "running", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), False) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "id long, user_id long, dataset_id long, goal string, status string, created_at timestamp, archived boolean")
    assert {r["id"]: r["cached_id"] for r in usage.cached_report(df).collect()} == {1: 4, 2: 4, 3: 4, 4: 3, 5: 4}
    v = {r["id"]: (r["version"], r["versions"], r["newest_id"]) for r in usage.report_versions(df, 2).collect()}
    assert v == {i: (i, 5, 5) for i in range(1, 6)}
    assert [r["id"] for r in usage.owned(df, 1).collect()] == [5, 4, 3, 2, 1]


def test_content_stats(spark):
    df = spark.createDataFrame([(1, [("s1", [("bar",), ("pie",)]), ("s2", None), ("s3", [("bar",), (None,)])]), (2, None)],
                               "id long, content array<struct<title:string,charts:array<struct<type:string>>>>")
    got = {r["id"]: (r["section_count"], r["chart_count"], r["chart_types"]) for r in usage.content_stats(df).collect()}
    assert got[1] == (3, 3, ["bar", "pie"]) and got[2][:2] == (0, 0)


@pytest.mark.parametrize("size", [10_000, 3])
def test_sections_from_an_event_log(spark, size):
    log = [(1, 0, "token", "lost"), (1, 1, "section_start", "A"), (1, 2, "token", "x"), (1, 3, "chart", "c1"), (1, 4, "token", "y"),
           (1, 5, "section_end", None), (1, 6, "token", "lost"), (1, 7, "section_start", "B"), (1, 8, "section_end", None)]
    df = spark.createDataFrame(log, "report_id long, seq long, event string, data string")
    got = {r["title"]: (r["section"], r["narrative"], r["charts"]) for r in usage.assemble_sections(df, size).collect()}
    assert got == {"A": (1, "xy", ["c1"]), "B": (2, "", [])}


def test_recent_turns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(30)] + [(1, 30, "tool", "z"), (1, 31, "user", "")]
    got = usage.recent_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r["turn"] for r in got] == list(range(18, 30))


def test_funnel_fills_zeros(spark):
    df = spark.createDataFrame([(1, "suggested"), (1, "generated"), (2, "dismissed")], "dataset_id long, status string")
    got = {r["dataset_id"]: (r["suggested"], r["generated"], r["dismissed"]) for r in usage.suggestion_funnel(df).collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 1)}


# -- streams ---------------------------------------------------------------------------

def test_ingest_stream_takes_each_file_once(spark):
    landing, target = scratch_dir(spark, "land"), scratch_dir(spark, "out")
    types = {"id": "number", "day": "timestamp", "who": "text"}
    def drop(rows):
        spark.createDataFrame(rows, "id string, day string, who string").coalesce(1).write.mode("append").option("header", True).csv(landing)
    drop([("$1,000", "1/2/2024", " Ann  B "), ("x", "2024-01-03", "N/A")])
    assert sum(r["rows"] for r in ingest.ingest_stream(spark, landing, target, f"{target}/cp", types).collect()) == 2
    drop([("3", "soon", "Carl")])
    m = ingest.ingest_stream(spark, landing, target, f"{target}/cp", types).collect()
    assert sorted(r["rows"] for r in m) == [1, 2]
    ingest.ingest_stream(spark, landing, target, f"{target}/cp", types)
    data = spark.read.parquet(f"{target}/data").orderBy("who").collect()
    assert [(r["who"], r["id"], str(r["day"])) for r in data] == [(None, None, "2024-01-03 00:00:00"), ("Ann B", 1000.0, "2024-01-02 00:00:00"), ("Carl", 3.0, "None")]
    p = {r["name"]: r for r in ingest.merged_profile(spark.read.parquet(f"{target}/profile")).collect()}
    assert p["id"]["rows"] == 3 and p["id"]["nulls"] == 1 and p["id"]["max"] == 1000.0 and p["who"]["distinct_about"] == 2


def test_merged_state_equals_whole(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    parts = ingest.column_state(df.where("v < 10")).unionByName(ingest.column_state(df.where("v >= 10")))
    whole, merged = ingest.merged_profile(ingest.column_state(df)).first(), ingest.merged_profile(parts).first()
    assert merged["std"] == pytest.approx(whole["std"]) and merged["rows"] == 1000 and merged["distinct_about"] == 37
    assert whole["std"] == pytest.approx(df.toPandas()["v"].std())


def test_stream_windows_equal_batch_and_late_rows_are_dropped(spark):
    root = scratch_dir(spark, "late")
    day = lambda d, h=0: pd.Timestamp("2024-01-01") + pd.Timedelta(days=d, hours=h)
    first = [(i, day(i % 3, i), float(i)) for i in range(20)] + [(50, day(9), 1.0)]
    # The watermark of a batch rules from the batch after the next one.
    for part in (first, [(97, day(9, 1), 3.0)], [(99, day(0), 1000.0), (98, day(9, 3), 5.0)]):
        spark.createDataFrame(pd.DataFrame(part, columns=["event_id", "ts", "v"])).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    got = batches.latest(batches.collected(spark, trends.trend_stream(stream(), "ts", "v"), "w", "update"), ["start", "end"])
    got = {str(r["start"].date()): (r["n"], r["mean"]) for r in got.collect()}
    pdf = pd.DataFrame(first, columns=["event_id", "ts", "v"])
    want = pdf.groupby(pdf["ts"].dt.date)["v"].agg(["count", "mean"])
    for d, row in want.iterrows():
        if str(d) != "2024-01-10":
            assert got[str(d)] == (row["count"], pytest.approx(row["mean"]))
    assert got["2024-01-10"] == (3, 3.0)


def test_duplicates_across_batches(spark):
    root = scratch_dir(spark, "dup")
    for part in ([(1, 1), (2, 2), (2, 2)], [(1, 1), (3, 3)]):
        rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for i, h in part]
        spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "ts"])).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = batches.collected(spark, trends.dedupe_events(stream, "ts"), "dd")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3]


def test_payment_events_with_odd_payloads(spark):
    import json

    def event(kind, **parts):
        return json.dumps({"event": kind, "payload": {k: {"entity": v} for k, v in parts.items()}})

    rows = [("e1", 1, event("order.paid", order={"receipt": "p1", "notes": []}, payment={"notes": [], "id": "x"})),
            ("e2", 2, event("payment.captured", payment={"notes": {"purchase_id": "p1"}})),
            ("e3", 3, event("payment_link.paid", payment_link={"reference_id": "p2", "notes": {"purchase_id": ""}})),
            ("e4", 4, event("payment.failed", payment={"notes": {"purchase_id": "p3"}})),
            ("e5", 5, "{broken"), ("e6", 6, None), ("e7", 7, event("order.paid", order={"receipt": 77}))]
    got = ledger.completed_purchases(spark.createDataFrame(rows, "event_id string, ts long, payload string")).collect()
    assert sorted((r.purchase_id, r.event_id, r.events) for r in got) == [("77", "e7", 1), ("p1", "e1", 2), ("p2", "e3", 1)]


def test_late_first_deliveries_are_counted(spark):
    """Every row read is kept, a repeat, or counted as late; late rows add up over several goes."""
    landing = scratch_dir(spark, "late")
    day = lambda *rows: spark.createDataFrame(list(rows), "event_id long, day long").select("event_id", F.timestamp_seconds(F.col("day") * 86_400).alias("ts"))
    shares = [day((1, 10), (1, 10), (2, 10)), day((3, 9), (4, 1), (4, 1), (2, 10)), day((5, 2), (6, 10), (7, None))]

    def go(k):
        def stream():
            shares[k].write.parquet(f"{landing}/part={k}")
            return trends.dedupe_events(spark.readStream.schema(shares[k].schema).parquet(f"{landing}/part=*"), "ts")
        return stream

    out = batches.accounted(spark, [go(k) for k in range(3)], "late")
    kept = sorted(r.event_id for r in out.rows.collect())
    assert [k for k in kept if k != 7] == [1, 2, 3, 6] and (out.read, out.late) == (10, 3 + (7 not in kept))


@pytest.mark.parametrize("seed, generous", [(1, True), (2, False), (3, None)])
def test_busy_users_are_cut_into_blocks(spark, seed, generous):
    """A user with half of all movements: blocks that reject nothing are added, others are replayed, and
    beyond a number of rounds folded; always as one movement after the other."""
    rnd = random.Random(seed)
    weights = {True: [8, 3, 2, 2], False: [1, 6, 4, 4], None: [3, 4, 2, 2]}[generous]
    rows = []
    for i in range(700):
        user = 1 if i % 2 else rnd.choice([2, 3, None])
        kind = rnd.choices(["purchase", "report_hold", "report_capture", "report_release"], weights)[0]
        rows.append((i, user, rnd.randrange(300), kind, rnd.randrange(1, 60) * (-1 if kind == "report_hold" else 1)))
    df = spark.createDataFrame(rows, "id long, user_id long, ts long, entry_type string, amount long")
    want, state = {}, {}
    for i, user, _, kind, amount in sorted(rows, key=lambda r: (r[2], r[0])):
        ok, a, h = balances.settle(kind, amount, *state.get(user, (0, 0)))
        state[user] = a, h
        want[i] = (user, ok, a, h)
    assert any(not x[1] for x in want.values())
    for block, rounds in ((1000, 5), (200, 3), (40, 100), (40, 2)):
        got = {r.id: (r.user_id, r.accepted, r.available, r.held) for r in balances.balance_batch(df, block, rounds).collect()}
        assert got == want, (block, rounds)
