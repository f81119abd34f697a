import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.model import Spec
from factloom.operators import columns, joins
from factloom.plans import analysis, findings, probes, signals


@pytest.fixture(scope="module")
def harbour(spark):
    """Ships of four classes with their delay and the delay that was forecast."""
    classes = ["tug"] * 5 + ["ferry"] * 35 + ["barge"] * 30 + ["yacht"] * 30
    return spark.createDataFrame(pd.DataFrame({
        "ship": [f"S{i:03d}" for i in range(100)], "class": classes,
        "delay": [60 - 3 * (i % 17) for i in range(100)], "expected_delay": [45 - 2 * (i % 13) for i in range(100)]}))


def spec(**scope):
    return Spec(segment_dimensions=["class"], rank_measures=["delay"], scope=scope or None)


def test_scope_keeps_forty_rows_and_says_so(harbour):
    out = analysis.analyze(harbour, "delay vs expected", spec(column="class", include=["Ferry ", "TUG"], reason="working ships"))
    assert out.scope_note == "working ships: 40 rows of 100 are used, those with class in ferry, tug."
    rows = out.findings.collect()
    overview = next(r for r in rows if r["kind"] == "overview")
    assert overview["text"].startswith("40 rows")
    assert out.skipped == []
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert {"segment", "entity", "category", "distribution"} <= {r["kind"] for r in rows}


def test_performance_gap_pairs_the_tracking_measure(spark):
    rows = [(f"p{i}", "AB"[i % 2], float(i), i + (3.0 if i % 2 else -1.0), (i * 37 % 50) * 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "player string, side string, goals double, expected_goals double, goals_noise double")
    out = analysis.analyze(df, "goals against expected goals by side", Spec(segment_dimensions=["side"]))
    found = [r for r in out.findings.collect() if r["kind"] == "performance"]
    assert len(found) == 2 and found[0]["columns"] == ["goals", "expected_goals"]
    assert found[0]["metrics"]["over"] == 30 and found[0]["metrics"]["mean_gap"] == pytest.approx(-1.0)
    assert found[1]["metrics"] == {"best": 1.0, "worst": -3.0}


@pytest.mark.parametrize("include", [["tug", "ferry", "barge", "yacht"], ["raft"], ["tug"], []])
def test_scope_fails_open(harbour, include):
    df, found = probes.scope_filter(harbour, {"column": "class", "include": include, "reason": ""})
    assert found is None and df.count() == 100
    assert probes.scope_filter(harbour, {"column": "nope", "include": ["x"]})[1] is None


def test_spec_is_checked_against_columns():
    s = Spec.checked({"entity_column": "player", "rank_measures": ["goals", "x"], "scope": {"column": "nope", "include": ["a"]}}, {"player", "goals"})
    assert (s.entity_column, s.rank_measures, s.scope) == ("player", ["goals"], None)
    assert Spec.checked({"scope": {"column": "p", "include": []}}, {"p"}).scope is None
    assert Spec.checked({"scope": {"column": "p", "include": ["D", 1], "reason": " r "}}, {"p"}).scope == {
        "column": "p", "include": ["D", "1"], "reason": "r"}


def test_charts_of_the_report_can_be_drawn(harbour):
    out = analysis.analyze(harbour, "delay vs expected by class", spec())
    cited = [r["chart_id"] for r in out.findings.collect() if r["chart_id"]]
    assert set(cited) == set(out.charts) and len(cited) <= 14
    for c in out.charts.values():
        assert c.to_dict()["data"]


def test_entity_grain_collapses_rows(spark):
    rows = [(f"name{i % 8}", i % 3, float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "name string, grade long, score double")
    b = analysis.Battery(df, "", Spec(entity_column="name", entity_grain=True))
    assert b.n == 8 and b.df.count() == 8
    want = pd.DataFrame(rows, columns=["name", "g", "s"]).groupby("name")["s"].mean().to_dict()
    assert {r["name"]: r["score"] for r in b.df.collect()} == pytest.approx(want)


def test_ids_are_not_measures(harbour):
    b = analysis.Battery(harbour.withColumn("row_id", F.monotonically_increasing_id()), "", Spec())
    assert "row_id" not in b.numeric and "delay" in b.numeric


def test_nested_columns_are_left_out(spark):
    df = spark.createDataFrame([([float(i), 1.0], i % 3, i * 1.5) for i in range(40)], "vec array<double>, label long, score double")
    out = analysis.analyze(df)
    assert out.skipped == [] and not any("vec" in r["columns"] for r in out.findings.collect())


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "a double, b string")
    out = analysis.analyze(empty)
    assert out.skipped == [] and {r["kind"] for r in out.findings.collect()} <= {"overview", "quality"}
    one = spark.createDataFrame([(1.0, "x"), (None, None)], "a double, b string")
    assert analysis.analyze(one).skipped == []
    assert signals.table_signals(empty).count() == 0


def test_cohorts_skip_tied_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 60 + [(float(i), 2.0) for i in range(1, 20)], "m double, o double")
    assert probes.cohort_means(df, "m", ["o"]) is None


def test_group_facts_drop_missing_keys(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 3.0), (None, "x", 5.0), ("b", "y", None)], "d1 string, d2 string, m double")
    got = {(r["set"], r["k1"], r["k2"]): (r["rows"], r["sum_m"], r["avg_m"]) for r in
           probes.group_facts(df, [("d1",), ("d2",), ("d1", "d2")], ["m"]).collect()}
    assert got == {("d1", "a", None): (2, 4.0, 2.0), ("d1", "b", None): (1, 0.0, None), ("d2", "x", None): (2, 6.0, 3.0),
                   ("d2", "y", None): (1, 0.0, None), ("d1|d2", "a", "x"): (1, 1.0, 1.0), ("d1|d2", "b", "y"): (1, 0.0, None)}


@pytest.mark.parametrize("days, unit, label", [(10, "day", "2024-01-01"), (200, "week", "2024-01-07"), (500, "month", "2024-01-31")])
def test_trend_periods_end_where_pandas_ends_them(spark, days, unit, label):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=days), "v": range(days)})
    df = spark.createDataFrame(pdf)
    assert probes.trend_unit(df, "t")[0] == unit
    got = {str(r["period"]): r["value"] for r in probes.trends(df, "t", "v").collect()}
    freq = {"day": "D", "week": "W", "month": "ME"}[unit]
    want = pdf.set_index("t")["v"].resample(freq).mean()
    assert got == {k.date().isoformat(): v for k, v in want.items()} and label in got


def test_column_choice(spark):
    assert columns.in_focus("goals_scored", "Actual goals scored vs xG") and not columns.in_focus("id_x", "ideal")
    assert columns.goal_match("Solo Streams", "solo and lead streams by country") == 2
    F_ = columns.ColumnFacts
    facts = [F_("user_id", "text", 0, 100), F_("club", "categorical", 1, 20), F_("full_name", "text", 2, 95)]
    assert columns.entity_column(spark, facts, 100, set()) == "full_name"
    assert columns.rank_measure(["total_x", "market_value", "rating"], set(), []) == "rating"
    assert columns.rank_measure(["total_x", "rating"], {"total_x"}, []) == "total_x"
    assert columns.agg_choice(F_("awards", "float", 0)) == "sum"
    assert columns.agg_choice(F_("flag", "integer", 0, n=5, mean=0.3, min=0.0, integral=True)) == "sum"
    assert columns.agg_choice(F_("price", "float", 0, n=5, mean=0.3, min=0.0)) == "mean"


def test_ideas(spark):
    rows = [("t", "region", "categorical", 0), ("t", "revenue", "float", 1), ("t", "cost", "float", 2), ("u", "only", "text", 0)]
    ideas = columns.idea_table(spark.createDataFrame(rows, "table string, name string, dtype string, position int")).collect()
    t = [r for r in ideas if r["table"] == "t"]
    assert len(t) == 5 and all(r["title"] and r["question"] and r["chart_types"] for r in t)
    assert t[0]["title"] == "revenue by region"
    assert len([r for r in ideas if r["table"] == "u"]) == 5


def test_assembly_prefers_the_fact_table_and_never_multiplies(spark):
    orders = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "order_id long, cust_id long")
    customers = spark.createDataFrame([(10, "W"), (11, "E")], "cust_id long, region string")
    view, note = joins.assemble_tables({"customers": customers, "orders": orders})
    assert view.count() == 3 and set(view.columns) == {"order_id", "cust_id", "region"} and "orders" in note
    twice = customers.union(customers)
    view, note = joins.assemble_tables({"orders": orders, "customers": twice})
    assert "Left out" in note


# -- signals -------------------------------------------------------------------------

def digest(spark, **tables):
    return "\n".join(signals.digest_lines(signals.signal_digest(tables)))


def test_signals_correlation_and_contrast(spark):
    df = spark.createDataFrame([("A", 100, 1, 2), ("A", 110, 2, 4), ("A", 90, 3, 6), ("B", 10, 4, 8), ("B", 12, 5, 10), ("B", 8, 6, 12)],
                               "region string, sales long, x long, y long")
    d = digest(spark, t=df)
    assert "y follows x closely, r +1.00" in d and "sales differs by region: A has 10.0 times the mean of B" in d


def test_signals_on_signed_measures(spark):
    df = spark.createDataFrame([("A", -50), ("A", -40), ("A", -60), ("B", 500), ("B", 520), ("B", 480)], "region string, profit long")
    assert "B is far above A" in digest(spark, t=df)


def test_signals_time_none_and_many(spark):
    t = spark.createDataFrame(pd.DataFrame({"day": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"]), "value": [1, 2, 3]}))
    assert "dates to follow over time: day" in digest(spark, t=t)
    assert digest(spark, t=spark.createDataFrame([(i,) for i in range(1, 6)], "a long")) == ""
    o = spark.createDataFrame([(100, "A"), (200, "A"), (300, "B"), (400, "B")], "amount long, region string")
    c = spark.createDataFrame([(1, 2), (2, 4), (3, 6), (4, 8)], "x long, y long")
    d = digest(spark, orders=o, customers=c)
    assert "orders:" in d and "customers:" in d


def test_a_broken_table_is_reported_and_skipped(spark):
    good = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.5)], "x long, y double")
    bad = good.withColumn("z", F.assert_true(F.col("x") < 3, F.lit("broken row")).cast("string"))
    failed = {}
    out = signals.signal_digest({"bad": bad, "good": good}, failed)
    assert {r["table"] for r in out.collect()} == {"good"} and list(failed) == ["bad"]


def test_fallback_on_any_failure(spark):
    small, large = spark.range(2), spark.range(5)
    broken = large.select((F.lit(1) / (F.col("id") - 3)).alias("x"))
    view, note = joins.assembled_or_largest({"small": small, "large": large}, lambda: broken)
    assert view.count() == 5 and note == "Only large is used, the largest of 2 tables."
    assert joins.assembled_or_largest({"small": small}, lambda: small)[1] == "Joined from small."


# -- layout -----------------------------------------------------------------------------

FINDINGS = "seq int, id string, kind string, text string, importance double, columns array<string>, chart_id string"


def test_rank_focus_bonus_caps_and_charts(spark):
    rows = [(i, f"f{i}", "segment", "t", 0.5 + (i % 3) * 0.01, ["a"] if i == 7 else ["b"], f"c{i}") for i in range(25)]
    got = findings.rank_findings(spark.createDataFrame(rows, FINDINGS), ["a"]).orderBy("rank").collect()
    assert len(got) == 18 and got[0]["id"] == "f7" and got[0]["importance"] == pytest.approx(0.96)
    assert [r["id"] for r in got[1:4]] == ["f2", "f5", "f8"]
    assert sum(r["chart_id"] is not None for r in got) == 14 and all(r["chart_id"] for r in got[:14])
    none = findings.rank_findings(spark.createDataFrame(rows, FINDINGS), []).orderBy("rank").first()
    assert none["id"] == "f2"


def test_plan_check(spark):
    f = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "id string")
    c = spark.createDataFrame([(f"c{i}",) for i in range(5)], "id string")
    plan = spark.createDataFrame([
        (1, " One ", ["f1", "f9", "f1"], ["c0", "c1", "zz", "c2", "c3"]), (2, "", ["f2"], []), (3, "Two", ["f1", "f2"], ["c4"]),
        (4, "None left", ["f1"], []), (5, "x" * 200, ["f3"], [])], "position int, title string, finding_ids array<string>, chart_ids array<string>")
    got = {r["position"]: r for r in findings.plan_check(plan, f, c).collect()}
    assert set(got) == {1, 3, 5}
    assert got[1]["title"] == "One" and got[1]["finding_ids"] == ["f1", "f1"] and got[1]["chart_ids"] == ["c0", "c1", "c2"]
    assert got[3]["finding_ids"] == ["f2"] and len(got[5]["title"]) == 120


def test_defaults(spark):
    rows = [(0, "f1", "quality", "x missing", 0.5, ["a"], None), (1, "f2", "overview", "y", 0.4, [], None)]
    r = findings.rank_findings(spark.createDataFrame(rows, FINDINGS), [])
    assert findings.default_summary(r).first()[0] == "x missing y"
    assert [x["advice"] for x in findings.default_recommendations(r).collect()] == [findings.MISSING_ADVICE]
    empty = r.where("false")
    assert findings.default_summary(empty).first()[0] == "Analysis of the dataset."
    assert [x["advice"] for x in findings.default_recommendations(empty).collect()] == [findings.GENERAL_ADVICE]
    assert findings.section_plan(r).collect()[0]["title"] == "Data Overview & Quality"


def test_dimension_of_many_groups_has_no_single_task_window(spark):
    """Leaders, totals and the peak of a dimension with very many values, without sorting it whole."""
    n = 20_000
    df = spark.range(n).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("g"), (F.col("id") % 5).cast("string").alias("h"),
                               (F.col("id") * 7919 % n).cast("double").alias("m"), F.lit(2.0).alias("e"))
    facts = probes.group_facts(df, [("g",), ("g", "h")], ["m", "e"])
    top = probes.segments(facts, ["g"], "m", "avg")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dimension" in plan and "_part" in plan and plan.count("Range (") == 1
    rows = sorted(top.collect(), key=lambda r: r["rank"])
    value = lambda k: k * 7919 % n
    best = sorted(range(n), key=lambda k: (-value(k), k))
    assert [r["key"] for r in rows] == [f"g{k:06d}" for k in best[:len(rows)]] and rows[0]["groups"] == n
    assert (rows[0]["best"], rows[0]["worst"], rows[0]["worst_key"]) == (n - 1.0, 0.0, f"g{best[-1]:06d}")
    assert rows[0]["spread"] == pytest.approx((n - 1) / ((n - 1) / 2), rel=1e-9)
    across = sorted(probes.measures_across(facts, ["g"], "m", "e").collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in across] == [r["key"] for r in rows] and across[0]["ratio"] == pytest.approx((n - 1) / 2)
    pairs = probes.two_way(facts, "g", "h", "m", "avg")
    assert pairs.where("peak").select("k1").collect() == [(f"g{best[0]:06d}",)] and pairs.count() == n
    shares = probes.categories(facts, ["g"]).collect()
    assert all(r["k"] == n and r["share"] == pytest.approx(100 / n) and r["chart"] == "bar" for r in shares)
    gaps = probes.gap_by_segment(df, "g", "m", "e")
    assert gaps.count() == n and gaps.where("rank = 1").first()["key"] == f"g{best[0]:06d}"
