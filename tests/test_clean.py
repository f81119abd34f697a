import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import clean
from factloom.session import scratch_dir


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame([("$1,000", "Male", None), ("$2,000", "male", None), ("$3,000", "Female", None),
                                  ("$3,000", "Female", None)], "` amount ` string, gender string, blank string")


def changes(df):
    return {r["code"]: (r["columns"], r["n"]) for r in df.collect()}


def test_five_fixes_at_once(spark, dirty):
    out, log = clean.clean(dirty)
    got = changes(log)
    assert {"trim_headers", "coerce_numeric", "merge_case", "drop_empty_cols", "drop_dup_rows"} <= set(got)
    assert out.columns == ["amount", "gender"] and out.count() == 3
    assert dict(out.dtypes)["amount"] == "double"
    assert {r["gender"] for r in out.collect()} == {"Female", "Male"}


def test_apply_writes_and_is_idempotent(spark, dirty):
    a, b, c = (scratch_dir(spark, "t") for _ in range(3))
    dirty.write.parquet(a)
    rows, cols, profiled, _ = clean.apply_cleaning(spark, a, b)
    assert (rows, cols) == (3, 2)
    assert {r["name"]: r["dtype"] for r in profiled.collect()}["amount"] == "float"
    assert clean.apply_cleaning(spark, b, c)[3].count() == 0
    assert clean.audit(spark.read.parquet(b)).count() == 0


def test_null_tokens_count(spark):
    df = spark.createDataFrame([("N/A", 1), ("-", 2), ("real", 3), ("real value", 4)], "note string, id long")
    out, log = clean.clean(df)
    assert changes(log)["null_tokens"] == (["note"], 2)
    assert out.where("note is null").count() == 2


@pytest.mark.parametrize("raw, want", [
    ("$1,234", 1234.0), ("45%", 45.0), ("$ 5", 5.0), ("€-3.5", -3.5), ("-5", -5.0), ("+7", 7.0), (".5", 0.5), ("5.", 5.0),
    ("1e3", 1000.0), ("1,2,3", 123.0), ("5 %", 5.0), ("-$5", None), ("(5)", None), ("12d", None), ("12f", None), ("1 000", None),
    ("abc", None), ("", None), (".", None), ("$", None), ("e5", None), ("5$", None), ("--5", None), ("1e", None), ("12abc", None)])
def test_to_number(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(text.to_number(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [
    ("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05 10:20:30", "2024-03-05 10:20:30"), ("2024-03-05T10:20:30Z", "2024-03-05 10:20:30"),
    ("3/5/2024", "2024-03-05 00:00:00"), ("03/05/2024 7:08", "2024-03-05 07:08:00"), ("2024/3/5", "2024-03-05 00:00:00"),
    ("5 Mar 2024", "2024-03-05 00:00:00"), ("Mar 5, 2024", "2024-03-05 00:00:00"), ("2024", None), ("Jan", None), ("2024-13-45", None),
    ("3/5/2024 10:20:30.25", "2024-03-05 10:20:30.25"), ("3/5/2024 1:20:30.5 PM", "2024-03-05 13:20:30.5"), ("2024/3/5 1:02:03.000001", "2024-03-05 01:02:03.000001"),
    ("3/5/24", "2024-03-05 00:00:00"), ("3-5-68 7:08", "2068-03-05 07:08:00"), ("3/5/69", "1969-03-05 00:00:00"), ("12/31/99 11:59 pm", "1999-12-31 23:59:00"),
    ("3/5/123", None), ("13/14/24", None), ("1/2/3", None), ("99/99/2024", None), ("12", None), ("hello", None)])
def test_to_timestamp(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "s string").select(text.to_timestamp(F.col("s")).cast("string")).first()[0]
    assert got == want


def test_dates_need_ninety_percent_of_all_rows(spark):
    full = spark.createDataFrame([(f"2024-01-{i + 1:02d}", i) for i in range(20)], "d string, i long")
    assert dict(clean.plan_changes(full)[0].dtypes)["d"] == "timestamp"
    gaps = full.withColumn("d", F.when(F.col("i") >= 4, F.col("d")))
    assert dict(clean.plan_changes(gaps)[0].dtypes)["d"] == "string"


def test_ninety_percent_of_numbers_is_enough(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(18)] + [("x1", 18), ("x2", 19)], "v string, i long")
    out = clean.plan_changes(df)[0]
    assert dict(out.dtypes)["v"] == "double" and out.where("v is null").count() == 2
    df = df.union(spark.createDataFrame([("y", 20), ("z", 21)], "v string, i long"))
    assert dict(clean.plan_changes(df)[0].dtypes)["v"] == "string"


def test_many_labels_are_left_alone(spark):
    rows = [(f"L{i % 61}", i) for i in range(400)] + [("l0", 999)]
    out, ch, _ = clean.plan_changes(spark.createDataFrame(rows, "label string, i long"))
    assert "merge_case" not in [c[0] for c in ch]
    rows = [(f"L{i % 59}", i) for i in range(400)] + [("l0", 999)]
    out, ch, _ = clean.plan_changes(spark.createDataFrame(rows, "label string, i long"))
    assert "merge_case" in [c[0] for c in ch] and out.where("label = 'l0'").count() == 0


def test_labels_that_merge_into_one_value_are_constant(spark):
    df = spark.createDataFrame([("Yes", 1), ("yes", 2), ("Yes", 3)], "a string, i long")
    out, ch, _ = clean.plan_changes(df)
    assert out.columns == ["i"] and "drop_constant_cols" in [c[0] for c in ch]


def test_unicode_blanks_collapse(spark):
    df = spark.createDataFrame([(" a  \tb\n",)], "s string")
    assert df.select(text.norm_text(F.col("s"))).first()[0] == "a b"


def test_header_clash_after_trimming(spark):
    df = spark.createDataFrame([(1, 2)], "a long, `a ` long")
    assert clean.trim_headers(df)[0].columns == ["a", "a.1"]


def test_two_digit_years_with_the_day_first(spark):
    df = spark.createDataFrame([(f"{d}/0{m}/24",) for d in range(10, 29) for m in (1, 2)], "d string")
    out = clean.plan_changes(df)[0]
    assert dict(out.dtypes)["d"] == "timestamp" and out.agg(F.max("d").cast("string")).first()[0] == "2024-02-28 00:00:00"


def test_only_layouts_that_occur_are_tried(spark):
    """A column is read by the layouts its cells have, with the result that all layouts give."""
    cells = ["2024-03-05T10:20:30Z", "3/5/2024", "3/5/24 10:20", "3/5/2024 1:02 pm", "5-3-2024", "3-5-2024 1:02 PM", "2024/3/5", "5.3.2024",
             "20240305", "5 Mar 2024", "5-Mar-2024", "Mar 5, 2024", "5 March 2024", "March 5, 2024", "Tue, 05 Mar 2024 10:20:30 GMT",
             "31.02.2024", "2024", "word", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    c = F.col("c")
    own = [r["y"] for r in df.select(text.time_layout(c).alias("y")).collect()]
    assert own[:15] == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13] and own[15:] == [6, None, None, None, None]
    bits = sum(1 << k for k in {k for k in own if k is not None})
    for r, k in zip(df.select(text.to_timestamp(c).alias("a"), text.to_timestamp(c, False, bits).alias("b"), *[
            text.to_timestamp(c, False, 1 << n).alias(f"t{n}") for n in range(14)]).collect(), own):
        assert r["a"] == r["b"] and (k is None or r[f"t{k}"] == r["a"])
    days = spark.range(400).selectExpr("id", "date_format(date_add(date'2024-01-01', cast(id as int)), 'dd.MM.yyyy') as day")
    fixed, _, _ = clean.plan_changes(days)
    assert "MMMM" not in str(fixed._jdf.queryExecution().analyzed()) and fixed.where("day = timestamp'2024-02-29'").count() == 1
