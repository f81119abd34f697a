import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.model import QueryError
from factloom.operators import charts


@pytest.fixture(scope="module")
def landings(spark):
    """Catches of three boats in two harbours over a few weeks, one without a weight."""
    rows = [("Ida", "north", "2031-W01", 12.5, 3), ("Ida", "south", "2031-W02", 7.25, 2), ("Kap", "north", "2031-W01", 30.0, 9),
            ("Kap", "south", "2031-W02", None, 1), ("Moe", "north", "2031-W03", 4.0, 4), ("Moe", "north", "2031-W03", 6.0, 5)]
    return spark.createDataFrame(rows, "boat string, harbour string, week string, tons double, crates long")


def test_plain_marks_share_one_encoding(landings):
    """Bars, lines, areas, pies and donuts differ in mark and container only."""
    per_boat = landings.groupBy("boat").agg(F.sum("crates").alias("crates"))
    want = {"Ida": 5, "Kap": 10, "Moe": 9}
    for kind, render, mark in (("bar", "cartesian", "bar"), ("line", "cartesian", "line"), ("area", "cartesian", "area"), ("pie", "pie", "pie"), ("donut", "pie", "pie")):
        drawn = charts.build_chart(kind, per_boat, "boat", "crates", title=f"Crates as {kind}", y_label="crates landed").to_dict()
        assert {r["boat"]: r["crates"] for r in drawn["data"]} == want and not drawn["truncated"]
        assert (drawn["type"], drawn["render"], drawn["title"], drawn["xType"]) == (kind, render, f"Crates as {kind}", "category")
        assert [(s["key"], s["name"], s["chartType"], s["stackId"]) for s in drawn["series"]] == [("crates", "crates landed", mark, None)]
    short = charts.build_chart("bar", per_boat, "boat", "crates").to_dict(max_points=2)
    assert len(short["data"]) == 2 and short["truncated"]


@pytest.mark.parametrize("values", [list(range(0, 100, 5)), [1, 1, 2, 50], [3.5] * 7, [0.0] * 3, [-4.0, -4.0, 9.25, 0.1] * 9,
                                    [1e9, 2e9, 1.5e9], list(range(1000)) + [5] * 700])
def test_histogram_equals_pandas_cut(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = charts.histogram(df, "v").orderBy("position").collect()
    s = pd.Series(values, dtype=float)
    want = pd.cut(s, bins=min(12, max(1, s.nunique()))).value_counts().sort_index()
    assert [r["count"] for r in got] == list(want)
    assert sum(r["count"] for r in got) == len(values)


def test_histogram_labels_and_text(spark):
    depth = spark.range(9).select((F.col("id") * F.col("id")).cast("double").alias("depth"))
    drawn = charts.build_chart("histogram", depth, "depth", x_label="metres").to_dict()
    counts = [r["count"] for r in drawn["data"]]
    assert len(counts) == 9 and sum(counts) == 9 and counts[0] == 3
    assert drawn["data"][0]["bin"].startswith("-0.064–") and (drawn["xLabel"], drawn["series"][0]["name"]) == ("metres", "Count")
    noted = spark.createDataFrame([("4.5",), ("shoal",), ("-2",), (None,)], "note string")
    assert sum(r["count"] for r in charts.histogram(noted, "note").collect()) == 2
    for column, kind in (("note", "string"), ("at", "timestamp")):
        words = spark.createDataFrame([("deep",)], "note string").select(F.lit("deep" if kind == "string" else None).cast(kind).alias(column))
        with pytest.raises(QueryError):
            charts.build_chart("histogram", words, column)


@pytest.mark.parametrize("kind, mark, stacked", [("grouped_bar", "bar", False), ("stacked_bar", "bar", True), ("multi_line", "line", False),
                                                 ("stacked_area", "area", True), ("radar", "radar", False)])
def test_one_series_for_each_harbour(landings, kind, mark, stacked):
    chart = charts.build_chart(kind, landings, "boat", "crates", series="harbour", aggregate="sum")
    assert {(s.key, s.chartType, s.stackId) for s in chart.series} == {(h, mark, "stack" if stacked else None) for h in ("north", "south")}
    assert {r["boat"]: (r["north"], r["south"]) for r in chart.data.collect()} == {"Ida": (3, 2), "Kap": (9, 1), "Moe": (9, None)}
    with pytest.raises(QueryError):
        charts.series_values(landings, "harbour", max_series=1)


def test_two_measures_and_points(landings):
    two = charts.build_chart("dual_axis", landings, "boat", "tons", y2="crates", aggregate="max")
    assert [(e["key"], e["mark"], e["axis"]) for e in two.encoding()] == [("tons", "bar", "left"), ("crates", "line", "right")]
    assert {r["boat"]: (r["tons"], r["crates"]) for r in two.data.collect()} == {"Ida": (12.5, 3), "Kap": (30.0, 9), "Moe": (6.0, 5)}
    points = charts.build_chart("scatter", landings, "tons", "crates", series="harbour", name_key="boat")
    assert (points.render, points.xType, points.yKey, points.seriesField, points.labelKey) == ("scatter", "number", "crates", "harbour", "boat")
    assert charts.build_chart("scatter", landings, "tons", "crates", name_key="skipper").labelKey is None and points.data.count() == 6


def test_x_type(spark):
    days = [f"2031-0{m}-1{m}T0{m}:30" for m in range(1, 10)]
    as_days = lambda values: spark.createDataFrame([(v,) for v in values], "day string")
    assert charts.x_type(as_days(days + ["not yet"]), "day") == "time"
    assert charts.x_type(as_days(days[:4] + ["2031-13-40"]), "day") == "category"
    assert charts.x_type(as_days(days + [None] * 50), "day") == "time"


def test_aggregates(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0), ("y", None)], "a string, b double")
    got = {r["a"]: r["b"] for r in charts.build_chart("bar", df, "a", "b", aggregate="avg").data.collect()}
    assert got == {"x": 2.0, None: 5.0, "y": None}
    sums = {r["a"]: r["b"] for r in charts.chart_agg(df, ["a"], ["b"], "sum").collect()}
    assert sums == {"x": 4.0, None: 5.0, "y": 0.0}


@pytest.mark.parametrize("call", [("bar", "a", "b", "bogus"), ("bogus", "a", "b", None), ("line", "a", None, None)])
def test_bad_requests(spark, call):
    kind, x, y, agg = call
    with pytest.raises(QueryError):
        charts.build_chart(kind, spark.createDataFrame([("x", 1)], "a string, b long"), x, y, aggregate=agg)


def test_chart_from_sql(landings):
    sql = "SELECT harbour, count(DISTINCT boat) AS boats FROM data GROUP BY harbour"
    drawn = charts.chart_from_sql(landings, sql, "donut", "harbour", "boats")
    assert {r["harbour"]: r["boats"] for r in drawn.to_dict()["data"]} == {"north": 3, "south": 2} and drawn.render == "pie"
    for broken, y in ((sql, "tons"), ("SELECT boat, tons FROM data WHERE crates < 0", "tons"), ("DELETE FROM data", "tons")):
        with pytest.raises(QueryError):
            charts.chart_from_sql(landings, broken, "bar", "boat", y)


def test_sample_is_stable_and_complete(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    a = {tuple(r) for r in charts.point_sample(df, ["x", "y"], ["x", "y"], 300).collect()}
    b = {tuple(r) for r in charts.point_sample(df.repartition(7), ["x", "y"], ["x", "y"], 300).collect()}
    assert a == b and len(a) == 300
    assert charts.point_sample(df.limit(10), ["x", "y"], ["x"], 300).count() == 10
    mean = sum(x for x, _ in a) / 300
    assert 2000 < mean < 3000
