"""Profiles and descriptive statistics of one table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..model import CATEGORICAL_RATIO, SAMPLES_PER_COLUMN, QueryError
from . import stats
from .stats import col, is_numeric

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def plain_dtype(field: T.StructField) -> str | None:
    """Semantic type that follows from the physical type alone."""
    t = field.dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, _INTEGERS):
        return "integer"
    if is_numeric(field):
        return "float"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return None


def date_rates(c: Column, i: int) -> list[Column]:
    """Aggregates that decide whether a text column holds dates; judged on every
    row, since a first-fifty sample is not defined on a cluster."""
    return [F.count_if(text.has_digit(c)).alias(f"dig{i}"),
            F.when(text.day_is_first(c), F.count(text.to_timestamp(c, True))).otherwise(F.count(text.to_timestamp(c))).alias(f"ts{i}")]


def is_date_like(n: Column, digits: Column, parsed: Column) -> Column:
    return (n > 0) & (digits >= 0.9 * n) & (parsed >= 0.9 * n)


def _smallest(df: DataFrame, c: Column, n: int = SAMPLES_PER_COLUMN) -> DataFrame:
    """The ``n`` smallest distinct values by repeated minimum: for long texts, whose
    distinct values are never shuffled as such."""
    found = [df.agg(F.min(c)).scalar()]
    for _ in range(n - 1):
        found.append(df.where(c > found[-1]).agg(F.min(c)).scalar())
    return df.sparkSession.range(1).select(F.array_compact(F.array(*found)).alias("s"))


def _values(df: DataFrame, ordered_by: str | None, width: int | None = None) -> DataFrame:
    """Distinct values, samples and counts per column: (name, distinct_count,
    sample_values). The count and the samples share one exchange per column."""
    long = stats.long_text_columns(df)
    parts = []
    for f in df.schema:
        c = col(f.name)
        value = lambda x: x["v"]
        if ordered_by:
            base = (df.select(c.alias("v"), col(ordered_by).alias("at")).where(F.col("v").isNotNull())
                    .groupBy("v").agg(F.min("at").alias("at")))
            listed = base.orderBy("at", "v").limit(SAMPLES_PER_COLUMN).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s"))
        elif f.name in long:
            base = df.select(stats.distinct_key(c, True).alias("v")).where(F.col("v").isNotNull()).distinct()
            listed, value = _smallest(df, c), lambda x: x
        else:
            base = df.select(c.alias("v")).where(F.col("v").isNotNull()).distinct()
            listed = base.orderBy("v").limit(SAMPLES_PER_COLUMN).agg(F.sort_array(F.collect_list(F.struct("v"))).alias("s"))
        count = base.agg(F.count(F.lit(1)).alias("distinct_count"))
        shown = (lambda v: v) if width is None else (lambda v: F.substring(v, 1, width))
        sample = listed.select(F.transform("s", lambda x: shown(value(x).cast("string"))).alias("sample_values"))
        parts.append(count.select(F.lit(f.name).alias("name"), "distinct_count",
                                  F.lit(None).cast("array<string>").alias("sample_values"))
                     .unionByName(sample.select(F.lit(f.name).alias("name"),
                                                F.lit(None).cast("bigint").alias("distinct_count"),
                                                "sample_values")))
    return stats.union_all(parts).groupBy("name").agg(
        F.max("distinct_count").alias("distinct_count"), F.max("sample_values").alias("sample_values"))


def _flat(df: DataFrame, fields: list, with_stats: bool) -> DataFrame:
    """Counts, ranges and date rates of a few columns from one aggregate."""
    aggs, shape = [F.count(F.lit(1)).alias("rows")], []
    texts = {i: f.name for i, f in fields if isinstance(f.dataType, T.StringType)}
    staged = df.select(*[col(f.name) for _, f in fields], *[text.to_timestamp(col(c)).alias(f"_ts{i}") for i, c in texts.items()])
    for i, f in fields:
        c, kind = col(f.name), plain_dtype(f)
        aggs.append(F.count(c).alias(f"n{i}"))
        lo = hi = F.lit(None).cast("string")
        date_like = F.lit(False)
        if kind in ("integer", "float", "datetime"):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        elif i in texts:
            parsed = F.col(f"_ts{i}")
            aggs += [F.count_if(text.has_digit(c)).alias(f"dig{i}"), F.count(parsed).alias(f"ts{i}"),
                     F.min(parsed).cast("string").alias(f"lo{i}"), F.max(parsed).cast("string").alias(f"hi{i}")]
            date_like = is_date_like(F.col(f"n{i}"), F.col(f"dig{i}"), F.col(f"ts{i}"))
            lo, hi = F.when(date_like, F.col(f"lo{i}")), F.when(date_like, F.col(f"hi{i}"))
        moments = []
        if with_stats:
            d = c.cast("double") if is_numeric(f) else None
            made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skew": stats.adjusted_skewness}
            aggs += [fn(d).alias(f"{k}{i}") for k, fn in made.items() if d is not None]
            moments = [(F.col(f"{k}{i}") if d is not None else F.lit(None).cast("double")).alias(k) for k in made]
        shape.append(F.struct(
            F.lit(f.dataType.simpleString()).alias("type"), *moments,
            F.lit(f.name).alias("name"), F.lit(i).alias("position"), F.lit(kind).alias("plain"),
            date_like.alias("date_like"), F.col(f"n{i}").alias("n"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            lo.alias("min_value"), hi.alias("max_value")))
    return staged.agg(*aggs).select(F.inline(F.array(*shape)))


def profile(df: DataFrame, ordered_by: str | None = None, with_stats: bool = False,
            samples: bool = True, width: int | None = None) -> DataFrame:
    """One row per column. Samples are the five smallest distinct values, or the
    first five by ``ordered_by``, whole unless ``width`` limits their characters. ``with_stats`` adds type, n, mean, std, min, max, skew
    and spread from the same pass; without ``samples`` that column is null."""
    df = stats.nan_to_null(df)
    flat = stats.union_all([_flat(df, chunk, with_stats)
                            for chunk in stats.chunks(list(enumerate(df.schema)), stats.COLUMNS_PER_PASS)])
    values = _values(df, ordered_by, width) if samples else stats.distinct_counts(df).withColumn(
        "sample_values", F.lit(None).cast("array<string>"))
    joined = flat.join(values, "name")
    dtype = (F.when(F.col("plain").isNotNull(), F.col("plain"))
             .when(F.col("n") == 0, "text").when(F.col("date_like"), "datetime")
             .when(F.col("distinct_count") <= CATEGORICAL_RATIO * F.col("n"), "categorical")
             .otherwise("text"))
    extra = ["type", "n", "mean", "std", "min", "max", "skew",
             (F.col("std") / (F.abs("mean") + F.lit(1e-9))).alias("spread")] if with_stats else []
    return joined.select("name", dtype.alias("dtype"), F.col("position").cast("int"), "null_count",
                         "distinct_count", "min_value", "max_value", "sample_values", *extra)


def profile_tables(tables: dict[str, DataFrame], samples: bool = True) -> DataFrame:
    """Profiles of many tables, with a leading ``table`` column."""
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda df: profile(df, samples=samples), tables.values()))
    return stats.union_all([df.select(F.lit(name).alias("table"), "*") for name, df in zip(tables, found)])


def shared_columns(profiles: DataFrame) -> DataFrame:
    """Columns found in at least two tables: candidate join keys."""
    return (profiles.groupBy("name").agg(F.sort_array(F.collect_set("table")).alias("tables"))
            .where(F.size("tables") >= 2))


def dimension_values(df: DataFrame, profiles: DataFrame, max_dims: int | None = None,
                     max_values: int = 20) -> DataFrame:
    """All values of the low-cardinality dimensions, as (name, value); of the first ``max_dims``
    if the caller wants no more."""
    picked = (profiles.where(F.col("dtype").isin("categorical", "boolean")
                             & F.col("distinct_count").between(1, max_values))
              .orderBy("position").select("name").collect())[:max_dims]
    if not picked:
        return df.sparkSession.createDataFrame([], "name string, value string")
    names = [r["name"] for r in picked]
    sets = df.groupingSets([[col(n)] for n in names], *[col(n) for n in names]).agg(
        F.grouping_id().alias("gid"))
    k = len(names)
    rows = [F.struct(F.lit(n).alias("name"), col(n).cast("string").alias("value"),
                     F.lit(((1 << k) - 1) ^ (1 << (k - 1 - i))).alias("want"))
            for i, n in enumerate(names)]
    return (sets.select("gid", F.inline(F.array(*rows)))
            .where((F.col("gid") == F.col("want")) & F.col("value").isNotNull())
            .select("name", "value"))


MOMENTS = ["mean_at", "min_at", "p25_at", "p50_at", "p75_at", "max_at"]


def _moments(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, …_at): range, mean and quartiles of time columns, by their microseconds."""
    micros = df.select(*[F.unix_micros(col(c).cast("timestamp")).cast("double").alias(c) for c in names])
    ends = micros.agg(*[a for i, c in enumerate(names) for a in (
        F.avg(col(c)).alias(f"a{i}"), F.min(col(c)).alias(f"b{i}"), F.max(col(c)).alias(f"c{i}"))]).first()
    quartiles = stats.exact_quantiles(micros, names, [0.25, 0.5, 0.75])
    rows = [(c, ends[f"a{i}"], ends[f"b{i}"], *quartiles[c], ends[f"c{i}"]) for i, c in enumerate(names)]
    known = df.sparkSession.createDataFrame(rows, "name string, " + ", ".join(f"{c} double" for c in MOMENTS))
    return known.select("name", *[F.date_format(F.timestamp_micros(F.round(c).cast("long")), "yyyy-MM-dd HH:mm:ss").alias(c) for c in MOMENTS])


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top, freq, mean, std, min, quartiles and max per column. Date and time
    columns have the last five as text in columns that end in ``_at``."""
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise QueryError(f"The table lacks {', '.join(missing)}.")
        df = df.select(*[col(c) for c in columns])
    df = stats.nan_to_null(df)
    base = stats.column_stats(df).select("name", "position", F.col("n").alias("count"),
                                         "mean", "std", "min", "max")
    numeric = stats.numeric_columns(df)
    quart = stats.exact_quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    rows = [(c, *quart[c]) for c in numeric]
    quartiles = df.sparkSession.createDataFrame(rows, "name string, p25 double, p50 double, p75 double")
    tops = []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            counts = df.where(col(f.name).isNotNull()).groupBy(col(f.name).cast("string").alias("v")).count()
            tops.append(counts.agg(
                F.lit(f.name).alias("name"), F.count(F.lit(1)).alias("unique"),
                F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("top"),
                F.max("count").alias("freq")))
    moments = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if moments:
        base = base.unionByName(_moments(df, moments), allowMissingColumns=True)
    else:
        base = base.selectExpr("*", *[f"cast(null as string) {c}" for c in MOMENTS])
    # The three parts share no column but the name: stack them and keep what is there.
    parts = base.unionByName(quartiles, allowMissingColumns=True)
    parts = (parts.unionByName(stats.union_all(tops), allowMissingColumns=True) if tops else
             parts.selectExpr("*", "cast(null as bigint) `unique`", "cast(null as string) top", "cast(null as bigint) freq"))
    shown = ["count", "unique", "top", "freq", "mean", "std", "min", "p25", "p50", "p75", "max", *MOMENTS, "position"]
    return parts.groupBy(F.col("name").alias("column")).agg(*[F.max(c).alias(c) for c in shown])


def value_counts(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Most frequent values, nulls included."""
    if column not in df.columns:
        raise QueryError(f"Unknown column: {column}")
    return (df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(limit))
