import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.model import QueryError
from factloom.operators import profile, stats


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        a = round(rnd.gauss(50, 20), 1)
        rows.append((a, round(a * 2 + rnd.gauss(0, 30), 0), None if i % 9 == 0 else float(rnd.randint(1, 6)), 7.0))
    return spark.createDataFrame(rows, "a double, b double, c double, k double").cache()


def test_quantiles_large_path_is_exact(numbers):
    pdf = numbers.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = stats.exact_quantiles(numbers, ["a", "c"], probs, small=20)
    for c in ("a", "c"):
        assert got[c] == pytest.approx(list(pdf[c].dropna().quantile(probs)), abs=1e-9)


def test_quantiles_with_a_hot_value(spark):
    df = spark.createDataFrame([(5.0,)] * 300 + [(float(i),) for i in range(100)], "v double")
    want = list(df.toPandas()["v"].quantile([0.05, 0.5, 0.95]))
    assert stats.exact_quantiles(df, ["v"], [0.05, 0.5, 0.95], small=10)["v"] == pytest.approx(want)


@pytest.mark.parametrize("small", [3, 50])
def test_quantiles_of_skewed_columns(spark, small):
    rnd = random.Random(2)
    rows = [(float(2 ** rnd.randint(-40, 90)), float(rnd.choice([0, 0, 0, 1])), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "e double, z double, u double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = stats.exact_quantiles(df, ["e", "z", "u"], probs, small=small)
    for c in got:
        assert got[c] == pytest.approx(list(df.toPandas()[c].quantile(probs)), rel=1e-12, abs=1e-12)


def test_pearson_matches_pandas_with_and_without_gaps(numbers):
    want = numbers.toPandas().corr()
    for r in stats.pearson_pairs(numbers, ["a", "b", "c", "k"]).collect():
        w = want.loc[r["a"], r["b"]]
        assert (r["r"] is None and math.isnan(w)) or r["r"] == pytest.approx(w, abs=1e-12)


@pytest.mark.parametrize("size", [10_000, 30])
def test_spearman_with_gaps_and_ties(numbers, size):
    pdf = numbers.toPandas()
    columns = ["a", "b", "c", "k"]
    got = {(r.a, r.b): r.r for r in stats.spearman_pairs(numbers, columns, size).collect()}
    alone = {(r.pair): r.r for r in stats.spearman_cells(numbers, list(itertools.combinations(columns, 2)), size).collect()}
    assert list(got) and len(got) == 6
    for n, (a, b) in enumerate(itertools.combinations(columns, 2)):
        d = pdf[[a, b]].dropna()
        want = d[a].rank().corr(d[b].rank())
        for r in (got[a, b], alone.get(n)):
            assert r is None and math.isnan(want) or r == pytest.approx(want, abs=1e-12)


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_jobs_do_not_grow_with_the_pairs(spark, method):
    """One value in a third of the rows, and twenty columns in as many jobs as four."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, (300, 20)).astype(float)
    values[:100] = 7.0
    df = spark.createDataFrame(pd.DataFrame(values, columns=[f"c{i}" for i in range(20)])).repartition(4)
    few = jobs_of(spark, f"{method}-4", lambda: stats.correlate(df, [f"c{i}" for i in range(4)], method).collect())
    found = []
    many = jobs_of(spark, f"{method}-20", lambda: found.extend(stats.correlate(df, method=method, digits=9).collect()))
    assert many <= few + 4
    frame = pd.DataFrame(values, columns=df.columns)
    assert len(found) == 400
    for r in found if method == "spearman" else [r for r in found if r.a == "c3" and r.b in ("c3", "c9", "c19")]:
        want = frame[r.a].rank().corr(frame[r.b].rank()) if method == "spearman" else brute_tau(frame[r.a], frame[r.b])
        assert r.r == pytest.approx(want, abs=1e-8)


def test_rank_correlation_without_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (None, 2.0, 5.0), (float("nan"), 3.0, 2.0)], "x double, y double, z double")
    for method in ("spearman", "kendall"):
        got = {(r.a, r.b): r.r for r in stats.correlate(df, method=method).collect()}
        assert got["x", "y"] is None and got["y", "x"] is None and got["y", "z"] == -1.0 and len(got) == 9


def brute_tau(xs, ys):
    s = tx = ty = 0
    for (x1, y1), (x2, y2) in itertools.combinations(list(zip(xs, ys)), 2):
        s += np.sign(x1 - x2) * np.sign(y1 - y2)
        tx += x1 == x2
        ty += y1 == y2
    n = len(xs) * (len(xs) - 1) / 2
    return s / math.sqrt((n - tx) * (n - ty))


def test_kendall_brute_force(numbers):
    d = numbers.toPandas()[["b", "c"]].dropna()
    want = brute_tau(list(d["b"]), list(d["c"]))
    for size, bits in ((10_000, 3), (25, 2)):
        got = stats.kendall_pairs(numbers, ["b", "c"], size, bits).first()["r"]
        assert got == pytest.approx(want, abs=1e-12)


def test_correlate_is_symmetric_and_checks_columns(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("B", 2, 4.5), ("C", 3, 5.0)], "s string, x long, y double")
    m = {(r["a"], r["b"]): r["r"] for r in stats.correlate(df).collect()}
    assert m["x", "y"] == m["y", "x"] and m["x", "x"] == 1.0
    with pytest.raises(QueryError):
        stats.correlate(df.select("s", "x"))
    with pytest.raises(QueryError):
        stats.correlate(df, ["s", "x"])


def test_skewness_of_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 9.0)], "k double, v double")
    row = df.agg(stats.adjusted_skewness(F.col("k")).alias("k"), stats.adjusted_skewness(F.col("v")).alias("v")).first()
    assert row["k"] == 0.0 and row["v"] == pytest.approx(pd.Series([1.0, 2.0, 9.0]).skew())
    assert df.limit(2).agg(stats.adjusted_skewness(F.col("v")).alias("v")).first()["v"] is None


def test_profile_types(spark):
    rows = [(1, 1.5, True, "red", f"t{i}", "2024-01-0%d" % (i + 1), None, "Jan") for i in range(4)]
    df = spark.createDataFrame(rows, "i long, f double, b boolean, cat string, txt string, day string, nothing string, month string")
    got = {r["name"]: r for r in profile.profile(df).collect()}
    kinds = {k: r["dtype"] for k, r in got.items()}
    assert kinds == {"i": "integer", "f": "float", "b": "boolean", "cat": "categorical", "txt": "text",
                     "day": "datetime", "nothing": "text", "month": "categorical"}
    assert got["day"]["min_value"].startswith("2024-01-01") and got["nothing"]["null_count"] == 4
    assert got["txt"]["sample_values"] == ["t0", "t1", "t2", "t3"] and got["cat"]["min_value"] is None


def test_profile_statistics_come_along(numbers):
    got = {r["name"]: r for r in profile.profile(numbers, with_stats=True, samples=False).collect()}
    pdf = numbers.toPandas()
    for c in ("a", "b", "c"):
        assert got[c]["mean"] == pytest.approx(pdf[c].mean()) and got[c]["skew"] == pytest.approx(pdf[c].skew())
    assert got["c"]["null_count"] == int(pdf["c"].isna().sum())


def test_long_texts_are_counted_by_digest(spark):
    rows = [("x" * 300 + str(i % 40), "s") for i in range(200)] + [(None, "s"), ("x" * 300 + "1", None)]
    df = spark.createDataFrame(rows, "body string, short string")
    assert stats.long_text_columns(df) == {"body"}
    got = {r["name"]: r for r in profile.profile(df).collect()}
    assert got["body"]["distinct_count"] == 40 and got["body"]["null_count"] == 1
    assert got["body"]["sample_values"] == sorted({r[0] for r in rows if r[0]})[:5]
    assert "sha2" in distinct_plan(df)


def distinct_plan(df):
    return stats.distinct_counts(df, ["body"])._jdf.queryExecution().executedPlan().toString()


def test_fused_distinct_counts_agree(numbers, as_rows):
    assert as_rows(stats.distinct_counts(numbers)) == as_rows(stats.distinct_counts(numbers, fused=True))


@pytest.fixture(scope="module")
def attendance(spark):
    return spark.createDataFrame([
        ("Aisha", "Jan", 18, 20, 90.0), ("Aisha", "Feb", 20, 20, 100.0), ("Ben", "Jan", 15, 20, 75.0),
        ("Ben", "Feb", 16, 20, 80.0), ("Carlos", "Jan", 19, 20, 95.0)],
        "student string, month string, present long, total long, pct double")


def test_describe_and_value_counts(attendance):
    d = {r["column"]: r for r in profile.describe(attendance).collect()}
    assert d["pct"]["mean"] == 88.0 and d["pct"]["p50"] == 90.0 and d["student"]["top"] == "Aisha" and d["student"]["freq"] == 2
    counts = {r["value"]: r["count"] for r in profile.value_counts(attendance, "student").collect()}
    assert counts == {"Aisha": 2, "Ben": 2, "Carlos": 1}
    with pytest.raises(QueryError):
        profile.value_counts(attendance, "nope")
    with pytest.raises(QueryError):
        profile.describe(attendance, ["nope"])


def test_shared_columns(spark):
    orders = spark.createDataFrame([(1, 10)], "order_id long, cust_id long")
    customers = spark.createDataFrame([(10, "W")], "cust_id long, region string")
    found = profile.shared_columns(profile.profile_tables({"orders": orders, "customers": customers})).collect()
    assert [(r["name"], r["tables"]) for r in found] == [("cust_id", ["customers", "orders"])]


def test_quantiles_of_many_columns_are_ranked_apart(spark):
    """The values that decide the quantiles are ranked in one table by target, not in one task by a union
    of windows without a key, and a sketch serves all targets of a column."""
    rnd = np.random.default_rng(8)
    pdf = pd.DataFrame({f"x{i}": rnd.normal(size=3000) if i else rnd.integers(0, 9, 3000).astype(float) for i in range(3)})
    df = spark.createDataFrame(pdf).repartition(4).cache()
    calls = []
    agg = type(df).agg

    def counted(self, *exprs):
        calls.append(sum("percentile_approx" in str(e) for e in exprs))
        return agg(self, *exprs)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "agg", counted)
        got = stats.exact_quantiles(df, list(pdf), [0.25, 0.5, 0.75], small=900)
    for c in pdf:
        assert got[c] == pytest.approx(list(pdf[c].quantile([0.25, 0.5, 0.75])))
    assert max(calls) <= 2


def test_common_values_are_not_dealt_by_value(spark):
    """Cells of a column with few values: each keeps its rank, and no task gets all cells of a value."""
    cells = spark.range(4000).selectExpr("0 as pair", "cast(if(id < 3900, 1, id) as double) as a", "cast(id as double) as b", "1L as w")
    ranks = stats._mid_ranks(cells, "pair", "a", F.col("w"), 1_000_000, 4000)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = stats._with_ranks(cells, ranks, "pair", "a", "rank", "ra", 50).withColumn("p", F.spark_partition_id()).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 4000 and (got["ra"] == got["a"].rank()).all()
    assert got[got["a"] == 1.0].groupby("p").size().max() < 2000
