"""Chart-ready rows: aggregation, pivot, histogram, samples and encodings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CHART_TYPES
from ..model import HISTOGRAM_BINS, SCATTER_SAMPLE, QueryError
from .sqlguard import query_tables
from .stats import col, grouped_medians, is_numeric, nan_to_null

# Aggregates a chart may ask for, with their synonyms; and how each
# chart type is drawn (container, mark, stacked).
AGGREGATES = {"sum": "sum", "mean": "mean", "avg": "mean", "average": "mean", "count": "count",
              "min": "min", "max": "max", "median": "median"}
DRAWN_AS = {
    "bar": ("cartesian", "bar", False), "grouped_bar": ("cartesian", "bar", False),
    "stacked_bar": ("cartesian", "bar", True), "line": ("cartesian", "line", False),
    "multi_line": ("cartesian", "line", False), "area": ("cartesian", "area", False),
    "stacked_area": ("cartesian", "area", True), "histogram": ("cartesian", "bar", False),
    "dual_axis": ("cartesian", "bar", False), "scatter": ("scatter", "scatter", False),
    "pie": ("pie", "pie", False), "donut": ("pie", "pie", False), "radar": ("radar", "radar", False),
}
# end of fixed values


@dataclass
class Series:
    key: str
    name: str
    chartType: str
    yAxis: str = "left"
    stackId: str | None = None


@dataclass
class Chart:
    """Encoding of a chart; ``data`` stays a DataFrame until it is drawn."""

    type: str
    render: str
    title: str | None
    data: DataFrame
    xKey: str
    xType: str
    series: list[Series] = field(default_factory=list)
    seriesField: str | None = None
    yKey: str | None = None
    xLabel: str | None = None
    yLabel: str | None = None
    labelKey: str | None = None

    def to_dict(self, max_points: int | None = None) -> dict:
        """Encoding and points, in the order the data has. All points unless the caller sets
        ``max_points``; ``truncated`` tells whether some were left out."""
        out = {k: v for k, v in self.__dict__.items() if k not in ("data", "series")}
        data = self.data
        rows = (data if max_points is None else data.limit(max_points + 1)).collect()
        kept = rows if max_points is None else rows[:max_points]
        return {**out, "series": [asdict(s) for s in self.series],
                "data": [r.asDict(recursive=True) for r in kept], "truncated": len(kept) < len(rows)}

    def encoding(self) -> list[dict]:
        """How each series is drawn: key, mark, axis, stack, and the container."""
        return [{"key": s.key, "mark": s.chartType, "axis": s.yAxis, "stack": s.stackId, "render": self.render} for s in self.series]


def normal_aggregate(name: str | None) -> str | None:
    if not name:
        return None
    if name.lower() not in AGGREGATES:
        raise QueryError(f"No aggregate is called '{name}'; known are {', '.join(sorted(set(AGGREGATES.values())))}.")
    return AGGREGATES[name.lower()]


def aggregate_expr(name: str, c: Column) -> Column:
    if name == "sum":
        # An all-missing group sums to zero.
        return F.coalesce(F.sum(c), F.lit(0))
    return {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}[name](c)


def chart_agg(df: DataFrame, keys: list[str], measures: list[str], aggregate: str) -> DataFrame:
    """Measures per x (and series) value; missing keys form a group of their own."""
    name = normal_aggregate(aggregate)
    if name == "median":
        return grouped_medians(df, keys, measures)
    return df.groupBy(*[col(k) for k in keys]).agg(*[aggregate_expr(name, col(m)).alias(m) for m in measures])


def series_values(df: DataFrame, series: str, max_series: int | None = None) -> list:
    """Distinct series values, each of which becomes a column. A caller who can draw only so
    many sets ``max_series``; more are then refused, never cut."""
    distinct = df.where(col(series).isNotNull()).select(col(series)).distinct()
    found = (distinct if max_series is None else distinct.limit(max_series + 1)).collect()
    if max_series is not None and len(found) > max_series:
        raise QueryError(f"'{series}' takes more than {max_series} values.")
    return sorted(r[0] for r in found)


def pivot_series(df: DataFrame, x: str, series: str, y: str, values: list | None = None) -> DataFrame:
    """Long (x, series, y) to one column per series value. Of several rows in a cell
    the smallest stands."""
    values = values if values is not None else series_values(df, series)
    wide = df.where(col(x).isNotNull()).groupBy(col(x)).pivot(series, values).agg(F.min(col(y)))
    return wide.toDF(x, *[str(v) for v in values])


def bin_count(df: DataFrame, column: str) -> tuple[float, float, int] | None:
    """(min, max, bins) of a numeric column. Only up to twelve distinct values matter;
    a sketch decides, and an exact count settles it near the limit."""
    c = col(column).cast("double")
    lo, hi, about = df.agg(F.min(c), F.max(c), F.approx_count_distinct(c, 0.05)).first()
    if lo is None:
        return None
    if about > 4 * HISTOGRAM_BINS:
        return lo, hi, HISTOGRAM_BINS
    exact = df.agg(F.count_distinct(c)).first()[0]
    return lo, hi, max(1, min(HISTOGRAM_BINS, exact))


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width edges; the lowest is stretched so that the minimum falls inside."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        step = (hi - lo) / bins
        return [lo + step * i for i in range(bins + 1)]
    step = (hi - lo) / bins
    edges = [lo + step * i for i in range(bins + 1)]
    return [lo - 0.001 * (hi - lo), *edges[1:-1], hi]


def histogram(df: DataFrame, column: str, known: tuple[float, float, int] | None = None) -> DataFrame:
    """(position, lo, hi, bin, count) with empty bins kept; every row is counted.
    ``known`` is (min, max, bins) when the caller has them already."""
    spark, field_ = df.sparkSession, df.schema[column]
    if not is_numeric(field_):
        if not isinstance(field_.dataType, T.StringType):
            raise QueryError(f"'{column}' holds no numbers to bin.")
        df = df.select(col(column).try_cast("double").alias(column))
    df = nan_to_null(df.select(col(column)))
    found = known or bin_count(df, column)
    if found is None:
        raise QueryError(f"No value of '{column}' is a number, so there is nothing to bin.")
    edges = bin_edges(*found)
    bins = len(edges) - 1
    c = col(column).cast("double")
    # Right-closed: the position is the number of upper edges below the value.
    place = sum((F.when(c > F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts = df.where(c.isNotNull()).groupBy(place.alias("position")).agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame(
        [(i, edges[i], edges[i + 1], f"{edges[i]:.4g}–{edges[i + 1]:.4g}") for i in range(bins)],
        "position int, lo double, hi double, bin string")
    return frame.join(F.broadcast(counts), "position", "left").select(
        "position", "lo", "hi", "bin", F.coalesce("n", F.lit(0)).alias("count"))


def point_sample(df: DataFrame, columns: list[str], required: list[str], n: int = SCATTER_SAMPLE,
                 seed: int = 0) -> DataFrame:
    """At most ``n`` rows in an order given by a hash of the row: the same rows on any
    partitioning, found as a distributed top-n. The hash is an MD5 of the row's text."""
    rows = df.select(*[col(c) for c in dict.fromkeys(columns)]).dropna(subset=required)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(as_text(rows, c), F.lit("")) for c in rows.columns]))
    return rows.orderBy(order, *[col(c) for c in rows.columns]).limit(n)


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text that other engines write alike: fractions with six digits."""
    fraction = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.format_string("%.6f", col(name).cast("double")) if fraction else col(name).cast("string")


def x_type(df: DataFrame, column: str) -> str:
    """number, time or category; text counts as time when 90% of it is ISO dates."""
    field_ = df.schema[column]
    if is_numeric(field_):
        return "number" if df.where(col(column).isNotNull()).take(1) else "category"
    if isinstance(field_.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if not isinstance(field_.dataType, T.StringType):
        return "category"
    iso = iso_share(col(column))
    share = df.agg(iso.alias("s")).first()["s"]
    return "time" if share is not None and share >= 0.9 else "category"


def iso_share(c: Column) -> Column:
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
    good = c.rlike(iso) & F.substring(c, 1, 10).try_cast("date").isNotNull()
    return F.avg(F.when(c.isNotNull(), F.when(good, 1.0).otherwise(0.0)))


def build_chart(chart_type: str, df: DataFrame, x: str, y: str | None = None, y2: str | None = None,
                series: str | None = None, aggregate: str | None = None, title: str | None = None,
                x_label: str | None = None, y_label: str | None = None, name_key: str | None = None,
                x_kind: str | None = None, bins: tuple[float, float, int] | None = None) -> Chart:
    """Encoding and rows for one chart, or QueryError when the request cannot be drawn.
    ``x_kind`` and ``bins`` spare the jobs that would find them out."""
    if chart_type not in DRAWN_AS:
        raise QueryError(f"'{chart_type}' is no chart type; there are {', '.join(CHART_TYPES)}.")
    render, mark, stacked = DRAWN_AS[chart_type]
    if chart_type == "histogram":
        data = histogram(df, x, bins).orderBy("position").select("bin", "count")
        return Chart("histogram", render, title, data, "bin", "category", [Series("count", "Count", "bar")],
                     xLabel=x_label or x, yLabel="Count")
    if not y:
        raise QueryError(f"A {chart_type} chart has to be told which column is y.")
    if aggregate and normal_aggregate(aggregate) and chart_type != "scatter":
        df = chart_agg(df, [x] + ([series] if series else []), [m for m in (y, y2) if m], aggregate)
    labels = dict(xLabel=x_label or x, yLabel=y_label or y)
    if render == "scatter":
        return Chart(chart_type, render, title, df, x, x_kind or x_type(df, x), seriesField=series, yKey=y,
                     labelKey=name_key if name_key in df.columns else None, **labels)
    if render == "pie":
        return Chart(chart_type, render, title, df.select(col(x), col(y)), x, "category",
                     [Series(y, y_label or y, "pie")], yKey=y, **labels)
    stack = "stack" if stacked else None
    if series:
        values = series_values(df, series)
        data = pivot_series(df, x, series, y, values)
        drawn = [Series(str(v), str(v), mark, stackId=stack) for v in values]
    elif y2:
        data = df.select(col(x), col(y), col(y2))
        drawn = ([Series(y, y_label or y, "bar"), Series(y2, y2, "line", "right")] if chart_type == "dual_axis"
                 else [Series(m, m, mark, stackId=stack) for m in (y, y2)])
    else:
        data = df.select(col(x), col(y))
        drawn = [Series(y, y_label or y, mark, stackId=stack)]
    return Chart(chart_type, render, title, data, x, x_kind or x_type(data, x), drawn, **labels)


def chart_from_sql(df: DataFrame, sql: str, chart_type: str, x: str, y: str | None = None, **kw) -> Chart:
    """A chart of the whole result of a SELECT over ``data``. Nothing is cut before an
    aggregate; ``Chart.to_dict`` can limit the points that are drawn."""
    rows = query_tables({"data": df}, sql)
    absent = sorted({c for c in (x, y, kw.get("y2"), kw.get("series")) if c} - set(rows.columns))
    if absent:
        raise QueryError(f"The result has {', '.join(rows.columns)}, but the chart asks for {', '.join(absent)}.")
    if rows.isEmpty():
        raise QueryError("There is nothing to draw: the result is empty.")
    return build_chart(chart_type, rows, x, y, **kw)
