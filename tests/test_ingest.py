import datetime
import io
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.model import QueryError
from factloom.operators import udf
from factloom.session import scratch_dir
from factloom.sources import archives, csv, ingest


def zipped(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return buffer.getvalue()


def expand(spark, *blobs, **limits):
    df = spark.createDataFrame([(f"a{i}.zip", bytearray(b)) for i, b in enumerate(blobs)], "path string, content binary")
    return archives.expand(df, **limits).orderBy("archive", "ordinal").collect()


def test_archive_members(spark):
    inside = {"tides.CSV": b"h\n1\n", "logs/2031/may/wind.csv": b"k,v\n7,8\n", "logs/.draft.csv": b"no", ".trash/old.csv": b"no",
              "__MACOSX/tides.csv": b"no", "notes.md": b"no", "..\\up/../out.csv": b"o\n", "//share/x.csv": b"s\n", "d:/disk.csv": b"d\n"}
    got = expand(spark, zipped(inside))
    assert {r["member"]: bytes(r["content"]) for r in got} == {
        "tides.CSV": b"h\n1\n", "logs/2031/may/wind.csv": b"k,v\n7,8\n", "up/out.csv": b"o\n", "share/x.csv": b"s\n", "disk.csv": b"d\n"}
    assert [r["ordinal"] for r in got] == [0, 1, 2, 3, 4] and got[0]["size"] == 4 and got[0]["error"] is None


def test_archive_refusals_are_rows_and_do_not_stop_others(spark):
    fine = zipped({"ok.csv": b"z\n5\n"})
    crowd = zipped({f"part-{k}.csv": b"z\n" for k in range(5)})
    heavy = zipped({"heavy.csv": bytes(900)})
    damaged = bytearray(zipped({"c.csv": b"abcdefgh" * 4}))
    damaged[40] ^= 255
    blobs = [b"PK but no archive", zipped({"picture.png": b"1"}), crowd, heavy, fine, bytes(damaged), zipped({})]
    got = expand(spark, *blobs, max_files=4, max_bytes=400)
    assert [r["error"] for r in got] == [archives.UNREADABLE, archives.WITHOUT_CSV, f"{archives.OVER_COUNT} (limit 4)",
                                         f"{archives.OVER_BYTES} (limit 400)", None, archives.UNREADABLE, archives.WITHOUT_CSV]
    assert [r["error"] for r in expand(spark, crowd, heavy)] == [None] * 6


def test_archive_limit_holds_for_all_members_together(spark):
    pair = zipped({"l.csv": b"1" * 70, "r.csv": b"2" * 50})
    assert expand(spark, pair, max_bytes=119)[0]["error"].startswith(archives.OVER_BYTES)
    assert len(expand(spark, pair, max_bytes=120)) == 2


def test_archives_from_files(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(zipped({"a.csv": b"a\n1\n2\n"}))
    rows = archives.expand_archives(spark, str(tmp_path / "*.zip")).select(F.explode(archives.member_lines(F.col("content"))).alias("l"))
    assert [r["l"] for r in rows.collect()] == ["a", "1", "2"]


def test_table_names():
    assert ingest.table_names(["2024/stats.csv", "teams/stats.csv"]) == ["t_2024_stats", "teams_stats"]
    assert ingest.table_names(["a.csv", "a.csv", "a_2.csv", "a.csv"]) == ["a", "a_2", "a_2_2", "a_3"]
    names = ingest.table_names(["2024 Data!.csv", "2024 Data!.csv", "!!!.csv", "x" * 90 + ".csv"])
    assert names == ["t_2024_data", "t_2024_data_2", "table", "x" * 63]


def test_names_of_many_files_never_meet(spark):
    paths = ["a.csv", "a.csv", "a_2.csv", "b.csv", "b.csv", "a.csv"]
    df = spark.createDataFrame(list(enumerate(paths)), "i long, p string")
    got = [r["table_name"] for r in ingest.named(df, "p", "i").orderBy("i").collect()]
    assert got == ["a", "a__2", "a_2", "b", "b_2", "a__3"]


def test_table_name_expression_agrees(spark):
    paths = ["2024/stats.csv", "Sales Q1.csv", "!!!.csv", "a/b.c/d-e.csv", "noext", "x" * 90 + ".csv"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, p string")
    got = [r[0] for r in df.orderBy("i").select(ingest.base_name_expr(F.col("p"))).collect()]
    assert got == [ingest.base_name(p) for p in paths]


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return name, path


def test_csv_cells(spark, tmp_path):
    _, p = write(tmp_path, "x.csv", 'id,note,"q",id,ok\n1,NA,"a ""b"", c",9,True\n2,null,"two\nlines",8,false\n3,unknown,plain,7,\n')
    df = csv.infer_types(csv.read_csv(spark, [p]))
    rows = df.orderBy("id").collect()
    assert df.columns == ["id", "note", "q", "id.1", "ok", csv.BAD_RECORD]
    assert [r["note"] for r in rows] == [None, None, "unknown"]
    assert [r["q"] for r in rows] == ['a "b", c', "two\nlines", "plain"]
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["ok"] == "boolean" and rows[2]["ok"] is None


def test_csv_bad_bytes_and_ragged_rows(spark, tmp_path):
    _, p = write(tmp_path, "x.csv", b"a,b\n1,caf\xe9\n2,x,EXTRA\n3\n")
    rows = csv.read_csv(spark, [p]).orderBy("a").collect()
    assert len(rows) == 3 and rows[0]["b"].startswith("caf") and rows[1]["b"] == "x" and rows[1][csv.BAD_RECORD]


def test_header_repeats():
    assert csv.unique_header(["a", "a", "B", "b", "", "a"]) == ["a", "a.1", "B", "b", "Unnamed: 4", "a.2"]


def test_infer_types_like_a_csv_reader(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None), ("2", "-3e2", "4", None)], "i string, f string, s string, n string")
    assert [t for _, t in csv.infer_types(df).dtypes] == ["bigint", "double", "string", "string"]


def test_clusters():
    c = ingest.cluster_by_schema({"jan": ["region", "rev"], "feb": ["region", "rev"], "x": ["a", "b"], "y": ["a", "c"],
                                  "z": ["region", "rev", "extra"]})
    assert [(sorted(k.columns), k.files) for k in c] == [
        (["extra", "region", "rev"], ["jan", "feb", "z"]), (["a", "b"], ["x"]), (["a", "c"], ["y"])]


def test_ingest_two_tables(spark, tmp_path):
    files = [write(tmp_path, "orders.csv", "order_id,cust_id\n1,10\n2,11\n"), write(tmp_path, "customers.csv", "cust_id,region\n10,W\n11,E\n")]
    tables, _, ok = ingest.ingest_tables(spark, files, scratch_dir(spark, "ds"))
    assert ok and [(t.name, t.row_count, t.col_count) for t in tables] == [("orders", 2, 2), ("customers", 2, 2)]
    for t in tables:
        assert t.path.endswith(".parquet") and spark.read.parquet(t.path).count() == 2 and t.profile.count() == 2
    s = ingest.dataset_summary(spark, tables, 2).first()
    assert (s["files"], s["tables"], s["rows"], s["columns"]) == (2, 2, 4, 4) and s["bytes"] > 0


def test_ingest_stacks_and_uses_the_single_table_path(spark, tmp_path):
    files = [write(tmp_path, f"part{i}.csv", f"region,rev\nW{i},{i}\n") for i in range(5)]
    tables, changes, _ = ingest.ingest_tables(spark, files, scratch_dir(spark, "ds"), max_tables=2)
    assert len(tables) == 1 and tables[0].row_count == 5 and tables[0].path.endswith("/data.parquet")
    assert tables[0].filename == "part0.csv +4 more"


def test_too_many_tables(spark, tmp_path):
    files = [write(tmp_path, f"t{i}.csv", f"col_{i}\n1\n") for i in range(3)]
    with pytest.raises(ingest.TooManyTables, match="2 tables are allowed"):
        ingest.ingest_tables(spark, files, scratch_dir(spark, "ds"), max_tables=2)


def test_cleaning_failure_keeps_the_raw_table(spark, tmp_path, monkeypatch):
    def fail(*a, **k):
        raise RuntimeError("no")
    monkeypatch.setattr(ingest.clean, "clean_into", fail)
    tables, _, ok = ingest.ingest_tables(spark, [write(tmp_path, "a.csv", "x,y\n1,2\n1,2\n")], scratch_dir(spark, "ds"))
    assert not ok and tables[0].row_count == 2


def test_records(spark):
    df = spark.createDataFrame([(1, None, datetime.datetime(2024, 1, 2, 3, 4, 5))], "a long, b string, t timestamp")
    assert ingest.records_sink(df).first()[0] == '{"a":1,"b":null,"t":"2024-01-02T03:04:05.000"}'


# -- text functions -----------------------------------------------------------------

def value(spark, expr, raw):
    return spark.createDataFrame([(raw,)], "s string").select(expr(F.col("s"))).first()[0]


def test_prompt_hygiene(spark):
    assert value(spark, text.sanitize_prompt, "  a\x07b </user_request>\n< USER_REQUEST >c ") == "ab \nc"
    assert len(value(spark, text.sanitize_prompt, "x" * 3000)) == 1000
    assert value(spark, text.usable_prompt, "short") is None


def test_ideas_from_a_response(spark):
    raw = ('Sure:\n[{"title": " T ", "question": "Q", "rationale": "", "chart_types": ["Bar", "heatmap"]}, '
           '{"title": "", "question": "Q"}, {"title": "U", "question": "V", "chart_types": ["heatmap"]}] bye')
    got = value(spark, text.parse_ideas, raw)
    assert [(i["title"], i["chart_types"]) for i in got] == [("T", ["bar"]), ("U", ["bar", "line"])]
    assert got[0]["rationale"].startswith("Explore")
    assert value(spark, text.parse_ideas, "no json at all") is None


def test_titles_and_sizes(spark):
    assert value(spark, text.safe_file_title, "") == "report" and value(spark, text.safe_file_title, " A: b/c  d! ") == "A-bc-d"
    assert value(spark, text.strip_markdown, "## Hi **b** *i* `c`\n- x") == "Hi b i c\n• x"
    sizes = [spark.range(1).select(text.byte_size_text(F.lit(n))).first()[0] for n in (412, 421888, 40055603)]
    assert sizes == ["412 B", "412 KB", "38.2 MB"]


def test_user_function(spark):
    df = spark.createDataFrame([("A", 10, 5), ("A", 20, 5), ("B", 5, 1)], "team string, pts long, reb long")
    out = udf.run_user_function(df, lambda f: f.assign(total=f["pts"] + f["reb"]), "team string, pts long, reb long, total long", max_rows=2)
    assert out.row_count == 2 and out.truncated and out.columns[-1] == "total"
    mean = lambda f: pd.DataFrame({"team": [f["team"].iloc[0]], "m": [f["pts"].mean()]})
    assert {r["team"]: r["m"] for r in udf.apply_pandas_whole(df, mean, "team string, m double", ["team"]).collect()} == {"A": 15.0, "B": 5.0}
    with pytest.raises(QueryError):
        udf.apply_pandas_whole(df, mean, "team string, m double", ["team"], max_rows=1)
    part = lambda f: pd.DataFrame({"team": [f["team"].iloc[0]], "s": [f["pts"].sum()], "n": [len(f)]})
    merged = udf.apply_pandas_merged(df.repartition(3), part, "team string, s long, n long", ["team"], [(F.sum("s") / F.sum("n")).alias("m")])
    assert {r["team"]: r["m"] for r in merged.collect()} == {"A": 15.0, "B": 5.0}


def test_merged_function_is_called_per_key(spark):
    """Keys spread over all partitions: one call for a key and batch, not one for every row; a null key and
    missing values keep their group."""
    rows = [(None if k == 7 else k, None if k == 3 else float(v * 50 + k)) for v in range(40) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(16, F.rand(1))
    ends = lambda f: {"k": f["k"].iat[0], "lo": f["x"].min(), "hi": f["x"].max(), "calls": 1}
    got = {r["k"]: r for r in udf.apply_pandas_merged(df, ends, "k long, lo double, hi double, calls long", ["k"], [
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("calls").alias("calls")]).collect()}
    assert {k: (r["lo"], r["hi"]) for k, r in got.items()} == {
        None if k == 7 else k: (None, None) if k == 3 else (float(k), 1950.0 + k) for k in range(50)}
    assert sum(r["calls"] for r in got.values()) <= 60


def quoted_file(path, rows, header=("id", 'said "so"\nand so', "note"), end="\n", quote=1):
    import csv as plain
    with open(path, "w", newline="") as out:
        writer = plain.writer(out, lineterminator=end, quoting=quote)
        writer.writerow(header)
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_line_breaks_are_read_in_parts(spark, tmp_path, seed, end):
    """A file with line breaks in its header and cells is cut anywhere and read by many tasks."""
    import random
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b\n", '"', ",", " ", "é", "\n\n", "x" * rng.randrange(60)]) for _ in range(rng.randrange(1, 12)))
    rows = [(f"{k}", cell() + ".", "n" + cell() if k % 3 else "plain") for k in range(400)]
    rows[200] = ("200", "line\n" * 900 + ".", "over several parts")
    quoted_file(tmp_path / "q.csv", rows, end=end)
    quoted_file(tmp_path / "r.csv", [(f"{k + 1000}", "one line", "z") for k in range(50)], end=end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        paths = [str(tmp_path / "q.csv"), str(tmp_path / "r.csv")]
        heads = csv.read_headers(spark, paths)
        assert list(heads.values()) == [["id", 'said "so"\nand so', "note"]] * 2
        out = csv.read_csv(spark, paths, with_file=True)
        lines = csv._lines(spark, paths)
        assert lines.rdd.getNumPartitions() > 10 and len(csv.quoted_splits(lines)) == 2
        got = {r[0]: tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {r[0]: r for r in [*rows, *[(f"{k + 1000}", "one line", "z") for k in range(50)]]}
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key][:3] == row and got[key][3] is None and got[key][4].endswith(".csv")


def test_parts_agree_with_unsplit_reading(spark, tmp_path):
    """Rows that do not fit and odd cells come out as from Spark's own multi-line reader."""
    text = 'a,b\n1,"x\ny"\n2\n3,4,5\n\n"6","q ""r"""\n7,\n"8\n",""\n 9 , z \nNA,"last\none"'
    (tmp_path / "odd.csv").write_text(text)
    got = csv.read_csv(spark, [str(tmp_path / "odd.csv")]).collect()
    plain = (spark.read.schema("a string, b string, _bad_record string").option("header", True).option("enforceSchema", True).option("escape", '"')
             .option("columnNameOfCorruptRecord", "_bad_record").option("multiLine", True).csv(str(tmp_path / "odd.csv")).collect())
    missing = lambda x: None if x in csv.MISSING_CELLS else x
    assert sorted((r[0], r[1], r[2] is not None) for r in got if r[0]) == sorted((missing(r[0]), missing(r[1]), r[2] is not None) for r in plain if missing(r[0]))
    assert len(got) == len(plain)


def test_whole_numbers_of_nineteen_digits_stay_whole(spark):
    df = spark.createDataFrame([("9223372036854775807", "9223372036854775808"), ("-9223372036854775808", "1")], "a string, b string")
    out = csv.infer_types(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "double"}
    assert [r.a for r in out.orderBy("a").collect()] == [-9223372036854775808, 9223372036854775807]


def test_cells_are_typed_by_one_kind_each(spark):
    """Types are counted from one kind per cell, with no pattern in the aggregate."""
    df = spark.createDataFrame([("1", "1", "true", "1", "x", None, " 7 ", "99999999999999999999"), ("-2", "1.5e3", "False", "true", None, None, "+8", "1")],
                               "a string, b string, c string, d string, e string, f string, g string, h string")
    seen, agg = [], type(df).agg
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(df), "agg", lambda self, *exprs: (seen.extend(map(str, exprs)), agg(self, *exprs))[1])
        got = csv.infer_types(df)
    assert [t for _, t in got.dtypes] == ["bigint", "double", "boolean", "string", "string", "string", "bigint", "double"]
    assert seen and not any("rlike" in e.lower() for e in seen)
