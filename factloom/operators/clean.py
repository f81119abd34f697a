"""Safe, explainable cleaning. A few aggregate passes decide everything; the fixes
themselves are one projection followed by one de-duplication."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import cut_lineage
from .profile import profile
from .stats import COLUMNS_PER_PASS, chunks, col, nan_to_null, union_all

# Case variants are merged only in columns with few labels.
CASE_MAX_LABELS = 60
COERCE_SHARE = 0.9
COERCE_MIN_VALUES = 3
# end of fixed values
# A sketch rules out columns with clearly too many labels; the rest are counted exactly.
_CASE_PREFILTER = 2 * CASE_MAX_LABELS

CHANGES = "code string, columns array<string>, n bigint"


def trim_headers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    seen: set[str] = set()
    names, changed = [], []
    for c in df.columns:
        bare = c.strip()
        name, k = bare, 1
        while name in seen:
            name, k = f"{bare}.{k}", k + 1
        seen.add(name)
        names.append(name)
        if name != c:
            changed.append(name)
    return (df.toDF(*names) if changed else df), changed


def normalised_text(df: DataFrame) -> DataFrame:
    """Text cells with white space collapsed and placeholders turned into null."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    even = df.withColumns({c: text.norm_text(col(c)) for c in names})
    return even.withColumns({c: text.null_tokens(col(c)) for c in names})


def _side_by_side(df: DataFrame, fields: list, aggregate) -> dict:
    """``aggregate(df, some fields)`` for a few fields at a time, so that Spark compiles it. The
    passes do not depend on each other, so the cluster runs them side by side."""
    out: dict = {}
    with ThreadPoolExecutor(4) as pool:
        for found in pool.map(lambda chunk: aggregate(df, chunk).first().asDict(), chunks(fields, COLUMNS_PER_PASS)):
            out.update(found)
    return out


def _rates(df: DataFrame, fields: list) -> DataFrame:
    """Token hits, number rates, date layouts and ranges. No date is parsed here: layouts are enough to
    rule most columns out, and tell which are to be tried in the others and whether days come first."""
    texts = {i for i, f in fields if isinstance(f.dataType, T.StringType)}
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    normal = df.select(*[(text.norm_text(col(f.name)) if i in texts else col(f.name)).alias(f"c{i}") for i, f in fields])
    cells = normal.select("*", *[text.null_tokens(F.col(f"c{i}")).alias(f"v{i}") for i in texts])
    parsed = cells.select("*", *[x for i in texts for x in (
        text.to_number(F.col(f"v{i}")).alias(f"x{i}"), text.time_layout(F.col(f"v{i}")).alias(f"y{i}"))])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in fields:
        c = F.col(f"c{i}")
        if i in texts:
            v, number = F.col(f"v{i}"), F.col(f"x{i}")
            aggs += [(F.count(c) - F.count(v)).alias(f"tok{i}"), F.count(v).alias(f"n{i}"), F.count(number).alias(f"num{i}"),
                     F.count_if(text.has_digit(v)).alias(f"dig{i}"), F.count(f"y{i}").alias(f"like{i}"),
                     F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(f"y{i}"))).alias(f"lay{i}"),
                     text.day_is_first(v).alias(f"day{i}"), (F.min(v) == F.max(v)).alias(f"one{i}"),
                     (F.min(number) == F.max(number)).alias(f"onum{i}")]
        else:
            one = F.lit(False) if isinstance(f.dataType, nested) else F.min(c) == F.max(c)
            aggs += [F.count(c).alias(f"n{i}"), one.alias(f"one{i}")]
    return parsed.agg(*aggs)


def _times(days: dict[int, bool], layouts: dict[int, int]):
    """Aggregates over the likely date columns, each read the way its own values ask for."""
    def aggregate(df: DataFrame, fields: list) -> DataFrame:
        even = df.select(*[text.norm_text(col(f.name)).alias(f"c{i}") for i, f in fields])
        cells = even.select(*[text.null_tokens(F.col(f"c{i}")).alias(f"v{i}") for i, _ in fields])
        moments = cells.select(*[text.to_timestamp(F.col(f"v{i}"), days[i], layouts[i]).alias(f"t{i}") for i, _ in fields])
        return moments.agg(*[a for i, _ in fields for a in (
            F.count(f"t{i}").alias(f"ts{i}"), (F.min(f"t{i}") == F.max(f"t{i}")).alias(f"ots{i}"))])
    return aggregate


def _findings(df: DataFrame) -> dict:
    """What the fixes are decided by. Dates are parsed only in columns whose cells look like
    dates to at least nine tenths."""
    fields = list(enumerate(df.schema))
    s = _side_by_side(df, fields, _rates)
    texts = [(i, f) for i, f in fields if isinstance(f.dataType, T.StringType)]
    likely = [(i, f) for i, f in texts if s[f"n{i}"] and min(s[f"dig{i}"], s[f"like{i}"]) >= 0.9 * s[f"n{i}"]]
    s.update({f"ts{i}": 0 for i, _ in texts})
    if likely:
        s.update(_side_by_side(df, likely, _times(
            {i: bool(s[f"day{i}"]) for i, _ in likely}, {i: s[f"lay{i}"] for i, _ in likely})))
    return s


def few_labels(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that may have at most CASE_MAX_LABELS values, by a sketch of fixed size."""
    if not columns:
        return []
    about = df.agg(*[F.approx_count_distinct(col(c), 0.05) for c in columns]).first()
    return [c for c, n in zip(columns, about) if n <= _CASE_PREFILTER]


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, lower, n) of low-cardinality text columns, in one job."""
    return union_all([
        df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(c).alias("name"), "value", F.lower("value").alias("lower"), "n") for c in columns])


def case_map(labels: DataFrame) -> DataFrame:
    """(name, value, canonical): the most frequent casing of each label; ties go to
    the smaller text."""
    best = labels.groupBy("name", "lower").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    return labels.join(best, ["name", "lower"]).select("name", "value", "canonical")


def plan_changes(df: DataFrame):
    """Decide the fixes for a table. Returns (cleaned columns, changes so far)."""
    df, renamed = trim_headers(nan_to_null(df))
    s = _findings(df)
    rows, changes = s["rows"], []
    if renamed:
        changes.append(("trim_headers", renamed, len(renamed)))
    texts = [(i, f.name) for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)]
    hits = sum(s[f"tok{i}"] for i, _ in texts)
    if hits:
        changes.append(("null_tokens", [c for i, c in texts if s[f"tok{i}"]], hits))

    numbers, moments, labels = [], [], []
    for i, c in texts:
        n = s[f"n{i}"]
        date_like = n > 0 and s[f"dig{i}"] >= 0.9 * n and s[f"ts{i}"] >= 0.9 * n
        if n >= COERCE_MIN_VALUES and not date_like and s[f"num{i}"] >= COERCE_SHARE * n:
            numbers.append(c)
            s[f"one{i}"] = s[f"onum{i}"]
        elif n >= COERCE_MIN_VALUES and date_like and s[f"ts{i}"] >= COERCE_SHARE * rows:
            moments.append(c)
            s[f"one{i}"] = s[f"ots{i}"]
        elif n:
            labels.append(c)
    if numbers:
        changes.append(("coerce_numeric", numbers, len(numbers)))
    if moments:
        changes.append(("coerce_datetime", moments, len(moments)))

    ready = normalised_text(df)
    merged: dict[str, dict[str, str]] = {}
    labels = few_labels(ready, labels)
    if labels:
        # At most about 130 labels per column reach the driver.
        found: dict[str, list] = {}
        for r in case_map(label_counts(ready, labels)).collect():
            found.setdefault(r["name"], []).append(r)
        position = {f.name: i for i, f in enumerate(df.schema)}
        for c in labels:
            rows_c = found.get(c, [])
            if len(rows_c) <= CASE_MAX_LABELS and len({r["canonical"] for r in rows_c}) < len(rows_c):
                merged[c] = {r["value"]: r["canonical"] for r in rows_c if r["value"] != r["canonical"]}
                s[f"one{position[c]}"] = len({r["canonical"] for r in rows_c}) == 1
        if merged:
            changes.append(("merge_case", list(merged), len(merged)))

    empty = [f.name for i, f in enumerate(df.schema) if s[f"n{i}"] == 0]
    constant = [f.name for i, f in enumerate(df.schema) if s[f"n{i}"] and s[f"one{i}"]]
    if empty:
        changes.append(("drop_empty_cols", empty, len(empty)))
    if constant:
        changes.append(("drop_constant_cols", constant, len(constant)))

    out = []
    for f in ready.schema:
        if f.name in empty or f.name in constant:
            continue
        c = col(f.name)
        if f.name in numbers:
            c = text.to_number(c)
        elif f.name in moments:
            i = ready.columns.index(f.name)
            c = text.to_timestamp(c, bool(s[f"day{i}"]), s[f"lay{i}"])
        elif f.name in merged:
            pairs = [F.lit(x) for kv in merged[f.name].items() for x in kv]
            c = F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
        out.append(c.alias(f.name))
    return ready.select(*out), changes, rows


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and the change log (code, columns, n). The table is written once, so
    its duplicates are found once, and counted from what was written."""
    spark = df.sparkSession
    fixed, changes, rows = plan_changes(df)
    out = cut_lineage(fixed.dropDuplicates(), "clean")
    removed = rows - out.count()
    if removed:
        changes.append(("drop_dup_rows", [], removed))
    return out, change_log(spark, changes)


def change_log(spark: SparkSession, changes: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(c, list(cols), int(n)) for c, cols, n in changes], CHANGES)


def audit(df: DataFrame) -> DataFrame:
    """What cleaning would change; no rows when the table is clean. Nothing is written."""
    fixed, changes, rows = plan_changes(df)
    kept = fixed.dropDuplicates().count()
    return change_log(df.sparkSession, changes + ([("drop_dup_rows", [], rows - kept)] if rows > kept else []))


def clean_into(df: DataFrame, target: str):
    """Clean ``df`` into the new path ``target``. Returns (row count, column count,
    profile, change log). Duplicates are counted from the written table."""
    spark = df.sparkSession
    fixed, changes, rows = plan_changes(df)
    fixed.dropDuplicates().write.parquet(target)
    done = spark.read.parquet(target)
    kept = done.count()
    if rows - kept:
        changes.append(("drop_dup_rows", [], rows - kept))
    return kept, len(done.columns), profile(done), change_log(spark, changes)


def apply_cleaning(spark: SparkSession, source: str, target: str):
    """Clean the Parquet table at ``source`` into the new path ``target``."""
    return clean_into(spark.read.parquet(source), target)
