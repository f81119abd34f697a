"""Running values must not depend on how the order is cut into ranges."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import joins, ordered
from factloom.operators.ordered import Running


@pytest.fixture(scope="module")
def hot(spark):
    """600 rows; one user holds half of them, one instant holds a sixth of the rows."""
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        user = 1 if i % 2 else rnd.randint(2, 9)
        at = 777 if i % 6 == 0 else rnd.randint(0, 2000)
        rows.append((i, user, at, rnd.randint(-5, 5), None if i % 4 else i))
    return spark.createDataFrame(rows, "id long, user long, at long, x long, mark long").cache()


def items():
    return [Running("s", "sum", F.col("x")), Running("lo", "min", F.col("x")), Running("hi", "max", F.col("x")),
            Running("seen", "last", F.col("mark")), Running("before", "sum", F.col("x"), inclusive=False),
            Running("last_before", "last", F.col("mark"), inclusive=False)]


@pytest.mark.parametrize("keys", [["user"], []])
def test_ranges_give_the_same_result_as_one_window(hot, keys, as_rows):
    plain = ordered.running(hot, keys, ["at", "id"], items(), rows_per_range=10_000)
    cut = ordered.running(hot, keys, ["at", "id"], items(), rows_per_range=25)
    assert len(ordered.range_bounds(hot, "at", 25)) > 10
    assert as_rows(cut) == as_rows(plain)


def test_hot_value_gets_a_range_of_its_own(hot):
    bounds = ordered.range_bounds(hot, "at", 25)
    ranged = ordered.with_range(hot, "at", bounds)
    at_777 = ranged.where("at = 777").select("_range").distinct().collect()
    assert len(at_777) == 1
    others = ranged.where(F.col("_range") == at_777[0][0]).where("at <> 777").count()
    assert others <= 50


def test_numbered_matches_row_number(hot):
    pdf = hot.toPandas().sort_values(["user", "at", "id"])
    pdf["rn"] = pdf.groupby("user").cumcount() + 1
    got = ordered.numbered(hot, ["user"], ["at", "id"], rows_per_range=40).toPandas()
    merged = got.merge(pdf[["id", "rn"]], on="id")
    assert (merged["rn_x"] == merged["rn_y"]).all()


def test_value_ranks(spark):
    df = spark.createDataFrame([(float(v % 50),) for v in range(500)] + [(None,)], "v double")
    got = {r["value"]: (r["n"], r["before"], r["dense"]) for r in ordered.value_ranks(df, "v", rows_per_range=10).collect()}
    assert got == {float(v): (10, 10 * v, v + 1) for v in range(50)}


def test_asof_join_brute_force(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randint(1, 4), rnd.randint(0, 100)) for i in range(120)]
    right = [(rnd.randint(1, 4), rnd.randint(0, 100), i) for i in range(90)]
    ldf = spark.createDataFrame(left, "id long, k long, at long")
    rdf = spark.createDataFrame(right, "k long, at long, v long")
    want = {}
    for i, k, at in left:
        seen = [(a, v) for kk, a, v in right if kk == k and a <= at]
        want[i] = max(seen)[1] if seen else None
    for size in (10_000, 20):
        got = {r["id"]: r["v"] for r in joins.asof_join(ldf, rdf, "at", ["k"], "v", rows_per_range=size).collect()}
        assert got == want


def test_rolling_blocks_equal_one_window(hot):
    small = joins.rolling_agg(hot, ["user"], ["at", "id"], 5, F.sum("x"), "r", rows_per_range=20)
    pdf = hot.toPandas().sort_values(["user", "at", "id"])
    pdf["want"] = pdf.groupby("user")["x"].transform(lambda s: s.rolling(5, min_periods=1).sum())
    merged = small.toPandas().merge(pdf[["id", "want"]], on="id")
    assert len(merged) == 600 and (merged["r"] == merged["want"]).all()


@pytest.mark.parametrize("size", [10_000, 11])
def test_frames_across_blocks(hot, size):
    got = ordered.framed(hot, ["user"], ["at", "id"], 1, 2, {
        "prev": lambda w: F.lag("x").over(w), "next2": lambda w: F.lead("x", 2).over(w)}, rows_per_range=size).toPandas()
    pdf = hot.toPandas().sort_values(["user", "at", "id"])
    pdf["p"], pdf["n"] = pdf.groupby("user")["x"].shift(1), pdf.groupby("user")["x"].shift(-2)
    m = got.merge(pdf[["id", "p", "n"]], on="id")
    assert len(m) == 600 and m["prev"].equals(m["p"]) and m["next2"].equals(m["n"])


@pytest.mark.parametrize("tiles", [1, 3, 7])
def test_row_ranks_equal_window_functions(hot, tiles):
    from pyspark.sql import Window
    w = Window.partitionBy("user").orderBy("at", "id")
    want = hot.select("id", F.row_number().over(w).alias("rn"), F.ntile(tiles).over(w).alias("tile"), F.percent_rank().over(w).alias("pr")).toPandas()
    m = ordered.row_ranks(hot, ["user"], ["at", "id"], tiles, rows_per_range=30).toPandas().merge(want, on="id")
    assert len(m) == 600 and (m["rn_x"] == m["rn_y"]).all() and (m["tile_x"] == m["tile_y"]).all() and (m["pr_x"] - m["pr_y"]).abs().max() < 1e-12


def test_span_blocks_equal_one_window(spark, hot):
    timed = hot.withColumn("ts", F.timestamp_micros(F.col("at") * 1_000_000))
    got = joins.rolling_span(timed, ["user"], "ts", 60, F.sum("x"), "r", spans_per_block=2).toPandas()
    pdf = hot.toPandas()
    want = {r.id: pdf[(pdf["user"] == r.user) & (pdf["at"] <= r.at) & (pdf["at"] >= r.at - 60)]["x"].sum() for r in pdf.itertuples()}
    assert {r.id: r.r for r in got.itertuples()} == want


def test_range_join_brute_force(spark):
    base = pd.Timestamp("2024-01-01")
    pts = [(i, base + pd.Timedelta(minutes=i * 37)) for i in range(200)]
    spans = [(j, base + pd.Timedelta(hours=j * 9), base + pd.Timedelta(hours=j * 9 + 20)) for j in range(12)]
    pdf = spark.createDataFrame(pd.DataFrame(pts, columns=["p", "at"]))
    sdf = spark.createDataFrame(pd.DataFrame(spans, columns=["s", "lo", "hi"]))
    got = {(r["p"], r["s"]) for r in joins.range_join(pdf, sdf, "at", "lo", "hi", 3600).collect()}
    want = {(p, s) for (p, at), (s, lo, hi) in itertools.product(pts, spans) if lo <= at < hi}
    assert got == want


def test_null_keys_keep_their_rows(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", None, 2.0), (3, None, "x", 3.0), (4, None, "y", 4.0), (5, None, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, k string, label string, v double")
    for per in (2_000_000, 2):
        got = {r["id"]: (r["rn"], r["tile"], r["pr"]) for r in ordered.row_ranks(df, ["k"], ["v", "id"], 2, per).collect()}
        assert got == {1: (1, 1, 0.0), 2: (2, 2, 1.0), 3: (1, 1, 0.0), 4: (2, 1, 0.5), 5: (3, 2, 1.0)}
        total = ordered.running(df, ["k"], ["v", "id"], [ordered.Running("t", "sum", F.col("v"))], per)
        assert {r["id"]: r["t"] for r in total.collect()} == {1: 1.0, 2: 3.0, 3: 3.0, 4: 7.0, 5: 12.0}
    labels = {r["id"]: (r["rk"], r["drk"]) for r in ordered.label_ranks(df, ["k"], "label").collect()}
    assert labels == {1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (2, 2), 5: (3, 3)}
    ends = {r["id"]: (r["first"], r["last"]) for r in ordered.ends(df, ["k"], ["v", "id"], {"first": "v"}, {"last": "v"}).collect()}
    assert ends == {1: (1.0, 2.0), 2: (1.0, 2.0), 3: (3.0, 5.0), 4: (3.0, 5.0), 5: (3.0, 5.0)}


def test_zoneless_order_columns(spark):
    df = spark.sql("select k, cast(t as timestamp_ntz) t from values ('a', '2024-01-02'), ('a', '2024-01-01') v(k, t)")
    got = ordered.running(df, ["k"], ["t"], [ordered.Running("n", "sum", F.lit(1))], rows_per_range=1).orderBy("t").collect()
    assert [r["n"] for r in got] == [1, 2]


@pytest.mark.parametrize("kind", ["long", "string", "timestamp"])
def test_one_instant_of_one_key_is_spread(spark, as_rows, kind):
    """Rows of one key at one instant are cut by the next column of the order, whatever its type."""
    rnd = random.Random(9)
    ids = rnd.sample(range(100_000), 500)
    df = spark.createDataFrame([(1 if i % 9 else 2, 50 if i % 5 else i % 100, n, rnd.randint(-9, 9), i if i % 7 == 0 else None)
                                for i, n in enumerate(ids)], "user long, at long, n long, x long, mark long")
    of = {"long": F.col("n"), "string": F.concat(F.lit("k"), F.lpad(F.col("n").cast("string"), 6, "0")), "timestamp": F.timestamp_seconds("n")}[kind]
    df = df.withColumn("id", F.when(F.col("n") != ids[1], of)).cache()  # one id is null
    order = ["at", "id"]
    assert as_rows(ordered.running(df, ["user"], order, items(), rows_per_range=20)) == as_rows(
        ordered.running(df, ["user"], order, items(), rows_per_range=10_000))
    bounds = ordered.range_bounds(df, "at", 20)
    finer = ordered.with_finer_ranges(ordered.with_range(df, "at", bounds), order, bounds, 20)
    spread = finer.where("at = 50").groupBy("_range").count().agg(F.max("count"), F.count("*")).first()
    assert spread[0] <= 60 and spread[1] > 8
    # The ranges follow the order.
    edges = finer.groupBy("_range").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")).orderBy("_range").collect()
    key = lambda r: (r[0], r[1] is not None, r[1] if r[1] is not None else 0)
    assert all(key(a.hi) < key(b.lo) for a, b in zip(edges, edges[1:]) if a.hi[1] is not None)


def spans_and_points(spark):
    rnd = random.Random(4)
    points = [(k, rnd.choice([5_000, rnd.randrange(-200_000, 300_000)])) for k in range(400)] + [(900, None)]
    spans = [(k, a := rnd.randrange(-200_000, 300_000), a + rnd.choice([0, 1, 50, 5_000, 90_000, 400_000, -5])) for k in range(60)]
    spans += [(100, 5_000, 5_001), (101, 4_999, 5_000), (102, None, 7), (103, 7, None), (104, -10**9, 10**9), (104, -10**9, 10**9)]
    moment = lambda c: F.timestamp_seconds(c).alias(c)
    p = spark.createDataFrame(points, "pid long, at long").select("pid", moment("at"))
    s = spark.createDataFrame(spans, "sid long, lo long, hi long").select("sid", moment("lo"), moment("hi"))
    pairs = sorted((sid, pid) for sid, lo, hi in spans for pid, at in points if None not in (lo, hi, at) and lo <= at < hi)
    return p, s, spans, pairs


@pytest.mark.parametrize("bucket", [1, 60, 86_400])
def test_range_join_of_short_and_long_spans(spark, bucket):
    p, s, _, pairs = spans_and_points(spark)
    got = joins.range_join(p, s, "at", "lo", "hi", bucket_seconds=bucket)
    assert sorted((r.sid, r.pid) for r in got.collect()) == pairs
    assert joins.range_join(p, s.limit(0), "at", "lo", "hi", bucket_seconds=bucket).count() == 0


def test_long_spans_have_few_pieces(spark):
    df = spark.createDataFrame([(a, b) for a in range(-9, 40, 3) for b in range(a, 41)] + [(-5, 10**11)], "a long, b long")
    for r in df.select("a", "b", joins.dyadic_pieces("a", "b").alias("x")).collect():
        if r.b < 10**6:
            covered = sorted(k for level, piece in r.x for k in range(piece << level, (piece + 1) << level))
            assert covered == list(range(r.a, r.b + 1))
        assert len(r.x) <= 2 * max(1, (r.b - r.a + 1).bit_length())


@pytest.mark.parametrize("size", [10_000, 20])
def test_range_counts_equal_pairs(spark, size):
    p, s, spans, pairs = spans_and_points(spark)
    got = joins.range_counts(p, s, "at", "lo", "hi", "n", size)
    want = sorted((sid, sum(x == sid for x, _ in pairs) // (2 if sid == 104 else 1)) for sid, _, _ in spans)
    assert sorted((r.sid, r.n) for r in got.collect()) == want
    assert joins.range_counts(p.limit(0), s, "at", "lo", "hi").agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("small", [10_000, 40, 0])
def test_grouped_medians(spark, small):
    """A group with half of all rows, a null key, ties, an even and an odd size, gaps and NaN."""
    from factloom.operators import charts, stats
    rnd = random.Random(6)
    rows = [("big" if i % 2 else rnd.choice(["a", "b", None]), float(rnd.choice([rnd.randint(0, 9), rnd.random() * 100])), rnd.choice([None, float("nan"), 1.0, 2.0, -3.5]))
            for i in range(900)] + [("one", 4.0, None), ("two", 1.0, 5.0), ("two", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    want = pdf.groupby("g", dropna=False)[["x", "y"]].median()
    got = {r.g: (r.x, r.y) for r in stats.grouped_medians(df, ["g"], ["x", "y"], small).collect()}
    assert len(got) == len(want)
    for g, row in want.iterrows():
        a, b = got[None if pd.isna(g) else g]
        assert a == pytest.approx(row.x, abs=1e-12) and (b is None if pd.isna(row.y) else b == pytest.approx(row.y))
    assert charts.chart_agg(df, ["g"], ["x"], "Median").columns == ["g", "x"]
    whole = stats.grouped_medians(df, [], ["x"], small).collect()
    assert [r.x for r in whole] == [pytest.approx(pdf.x.median())]


def test_only_crowded_keys_are_cut(spark, hot, as_rows):
    """Keys that fit a task take one shuffle and no join, however many rows the table has."""
    small = hot.where("user <> 1")
    got = ordered.running(small, ["user"], ["at", "id"], items(), rows_per_range=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert small.count() > 100 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    plain = ordered.running(hot, ["user"], ["at", "id"], items(), bounds=[])
    assert as_rows(ordered.running(hot, ["user"], ["at", "id"], items(), rows_per_range=100)) == as_rows(plain)
    assert [r["user"] for r in ordered.crowded_keys(hot, ["user"], 100).collect()] == [1]
