import pytest
from pyspark.sql import functions as F

from factloom.model import QueryError
from factloom.operators import sqlguard

UNSAFE = [
    "", "DROP TABLE data", "CREATE TABLE x AS SELECT 1", "COPY data TO '/tmp/x'", "INSTALL httpfs", "SELECT 1; SELECT 2",
    "PRAGMA show_tables", "WITH x AS (SELECT 1) INSERT INTO data SELECT * FROM x",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.lang.System', 'getenv')",
    "SELECT try_reflect('a', 'b')", "SELECT TRANSFORM(pct) USING 'cat' FROM data",
    "SELECT * FROM (MAP pct USING 'cat' FROM data)",
]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([("Aisha", 90.0, 18), ("Aisha", 100.0, 20), ("Ben", 75.0, 15)], "student string, pct double, present long")


@pytest.mark.parametrize("sql", UNSAFE)
def test_unsafe_statements_are_refused(data, sql):
    with pytest.raises(QueryError):
        sqlguard.run_sql(data, sql)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "text", "json", "binaryFile"])
def test_files_cannot_be_read_by_path(data, fmt):
    with pytest.raises(QueryError):
        sqlguard.run_sql(data, f"SELECT * FROM {fmt}.`/root/testdata/sf0.001/orders.parquet`")


def test_table_form_agrees_with_the_function(spark):
    rows = [(s,) for s in UNSAFE + ["SELECT 1", "with a as (select 1) select * from a;", "select transform(array(1), x -> x + 1)"]]
    got = [r["ok"] for r in spark.createDataFrame(rows, "s string").select(sqlguard.is_read_only(F.col("s")).alias("ok")).collect()]
    def ok(sql):
        try:
            sqlguard.validate_select(sql)
            return True
        except QueryError:
            return False
    assert got == [ok(s[0]) for s in rows] and got[-3:] == [True, True, True]


def test_aggregate_cte_and_truncation(data):
    out = sqlguard.run_sql(data, "SELECT student, AVG(pct) AS a FROM data GROUP BY student ORDER BY a DESC;")
    assert out.columns == ["student", "a"] and out.rows[0] == {"student": "Aisha", "a": 95.0} and not out.truncated
    assert sqlguard.run_sql(data, "WITH x AS (SELECT SUM(present) s FROM data WHERE student = 'Aisha') SELECT s FROM x").rows == [{"s": 38}]
    cut = sqlguard.run_sql(data, "SELECT * FROM data", max_rows=2)
    assert cut.row_count == 2 and cut.truncated


def test_join_using_is_allowed_and_views_go_away(spark, data):
    other = spark.createDataFrame([("Aisha", "W")], "student string, region string")
    got = sqlguard.query_tables({"a": data, "b": other}, "SELECT map('k', region) AS m FROM a JOIN b USING (student)")
    assert got.count() == 2
    assert not spark.catalog.tableExists("a")
    with pytest.raises(QueryError):
        sqlguard.query_tables({"a": data}, "SELECT nope FROM a")


def test_only_the_given_tables_are_seen(spark, data):
    spark.range(3).createOrReplaceTempView("elsewhere")
    for sql in ("SELECT * FROM elsewhere", "SELECT * FROM a WHERE pct IN (SELECT id FROM elsewhere)",
                "WITH x AS (SELECT * FROM elsewhere) SELECT * FROM x", "SELECT 1 FROM a UNION ALL SELECT id FROM elsewhere"):
        with pytest.raises(QueryError):
            sqlguard.query_tables({"a": data}, sql)
    spark.catalog.dropTempView("elsewhere")
    assert sqlguard.query_tables({"a": data}, "WITH x AS (SELECT * FROM a) SELECT * FROM x").count() == 3


SLY = [
    "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "SELECT b.* FROM (WITH secret AS (SELECT 1 AS one) SELECT * FROM secret) a CROSS JOIN secret b",
    "WITH x AS (WITH secret AS (SELECT 1 AS one) SELECT * FROM secret) SELECT * FROM x, secret",
    "SELECT (SELECT max(id) FROM secret) AS m FROM a", "SELECT * FROM a WHERE EXISTS (SELECT 1 FROM IDENTIFIER('secret'))",
    "SELECT * FROM a, LATERAL (SELECT id FROM secret)", "SELECT * FROM global_temp.shared", "SELECT * FROM kept_table",
    "SELECT * FROM spark_catalog.default.kept_table", "SELECT * FROM range(3)", "SELECT * FROM a JOIN range(3) r",
    "SELECT twice(present) FROM a", "SELECT * FROM `secret`", "TABLE secret", "SELECT * FROM a UNION ALL TABLE secret",
]


@pytest.fixture
def secrets(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).createOrReplaceGlobalTempView("shared")
    spark.udf.register("twice", lambda x: 2 * x, "long")
    spark.sql(f"CREATE TABLE kept_table USING parquet LOCATION '{tmp_path}/kept' AS SELECT 1 AS id")
    yield
    spark.sql("DROP TABLE kept_table")
    spark.catalog.dropTempView("secret")
    spark.catalog.dropGlobalTempView("shared")


@pytest.mark.parametrize("sql", SLY)
def test_nothing_else_can_be_read(data, secrets, sql):
    with pytest.raises(QueryError):
        sqlguard.query_tables({"a": data}, sql)


@pytest.mark.parametrize("sql, n", [
    ("SELECT * FROM IDENTIFIER('a')", 3), ("SELECT * FROM (VALUES (1), (2)) v", 2), ("SELECT 1 AS one", 1),
    ("WITH a AS (SELECT 1 AS one) SELECT * FROM a", 1), ("SELECT s FROM a LATERAL VIEW explode(array(1, 2)) x AS s", 6),
    ("SELECT * FROM a x JOIN a y ON x.student = y.student", 5), ("SELECT * FROM a WHERE pct >= (SELECT max(pct) FROM a)", 1),
    ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n FROM r", 4)])
def test_what_the_statement_itself_says_can_be_read(data, sql, n):
    assert sqlguard.query_tables({"a": data}, sql).count() == n


def test_a_view_behind_a_given_table_can_be_read(spark, data):
    data.createOrReplaceTempView("inner_view")
    given = spark.table("inner_view").where("pct > 80")
    spark.catalog.dropTempView("inner_view")
    assert sqlguard.query_tables({"a": given}, "SELECT count(*) AS n FROM a").first().n == 2


def test_options_and_results_belong_to_the_caller(spark, data):
    out = sqlguard.query_tables({"a": data}, "SELECT student, pct FROM a")
    assert out.sparkSession is spark
    assert out.join(data, "student").where(out["pct"] > 80).count() == 4
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        assert sqlguard.query_tables({"a": data}, "SELECT PCT FROM A").count() == 3
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")
    with pytest.raises(QueryError):
        sqlguard.query_tables({"a": data}, "SELECT PCT FROM a")


def test_callers_side_by_side(spark, data):
    """The same name means each caller's own table."""
    from concurrent.futures import ThreadPoolExecutor
    sizes = list(range(1, 13))
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: sqlguard.query_tables({"a": spark.range(n)}, "SELECT count(*) AS n FROM a").first().n, sizes))
    assert got == sizes and not spark.catalog.tableExists("a")


def test_words_in_literals_do_no_harm(data):
    assert sqlguard.run_sql(data, "SELECT 'copy; drop' AS `set`, 1 AS b -- create\nFROM data LIMIT 1;").rows == [{"set": "copy; drop", "b": 1}]


def test_a_view_of_the_caller_survives(spark, data):
    spark.range(3).createOrReplaceTempView("data")
    sqlguard.run_sql(data, "SELECT COUNT(*) AS n FROM data")
    assert spark.table("data").count() == 3
    spark.catalog.dropTempView("data")


def test_projection_and_duplicate_names(data):
    assert sqlguard.project_columns(data, ["pct"]).columns == ["pct"]
    with pytest.raises(QueryError):
        sqlguard.project_columns(data, ["pct", "x"])
    both = data.join(data.withColumnRenamed("pct", "other"), data["student"] == data["student"])
    assert sqlguard.drop_duplicate_names(both).columns == ["student", "pct", "present", "other"]
