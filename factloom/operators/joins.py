"""Joins beyond the plain equi join, table assembly and rolling windows."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import QueryError
from ..session import cut_lineage
from .ordered import ROWS_PER_RANGE, Running, framed, running
from .sqlguard import drop_duplicate_names
from .stats import col

log = logging.getLogger(__name__)


# A span of up to 2^40 buckets has pieces on at most this many levels.
SPAN_LEVELS = 41


def dyadic_pieces(first: str, last: str) -> Column:
    """array<struct<level, piece>>: the fewest aligned blocks that cover the buckets ``first`` to
    ``last``, block ``piece`` of level l having 2^l buckets. A level has two of them at most: one at
    the lower end where that is odd there, and one at the upper end."""
    def ends(level: Column) -> Column:
        low = -F.call_function("shiftright", -F.col(first), level)
        high = F.call_function("shiftright", F.col(last) + 1, level)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        piece = lambda test, c: F.when(test & (low < high), F.struct(level.alias("level"), c.cast("bigint").alias("piece")))
        return F.array(piece(odd(low), low), piece(odd(high), high - 1))

    levels = F.sequence(F.lit(0), F.lit(SPAN_LEVELS - 1))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(levels, ends))))


def range_join(points: DataFrame, spans: DataFrame, at: str, starts: str, ends: str,
               bucket_seconds: int) -> DataFrame:
    """Rows with ``starts <= at < ends``. A span of n time buckets is listed once for each of its at
    most 2 log n aligned blocks, and a point once for each block size in use, which gives the
    join an equi key whatever the lengths are; a busy block is split by AQE. Spans without an end
    or that end before they start hold nothing."""
    size = F.lit(bucket_seconds)
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c)) / size).cast("bigint")
    named = spans.where(F.col(starts) < F.col(ends)).withColumns({"_first": bucket(starts), "_last": bucket(ends)})
    listed = named.select(*spans.columns, F.inline(dyadic_pieces("_first", "_last")).alias("_level", "_piece"))
    listed = cut_lineage(listed, "spans")
    # At most SPAN_LEVELS numbers.
    levels = [r[0] for r in listed.select("_level").distinct().collect()]
    if not levels:
        return points.join(spans.limit(0), F.lit(False))
    each = points.withColumn("_at", bucket(at)).select(*points.columns, "_at", F.explode(F.array(*[F.lit(n) for n in levels])).alias("_level"))
    each = each.withColumn("_piece", F.expr("shiftright(_at, _level)")).drop("_at")
    joined = each.join(listed, ["_level", "_piece"]).drop("_level", "_piece")
    return joined.where((F.col(at) >= F.col(starts)) & (F.col(at) < F.col(ends)))


def range_counts(points: DataFrame, spans: DataFrame, at: str, starts: str, ends: str, name: str = "n",
                 rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``spans`` with the number of points where ``starts <= at < ends``: the points before its end
    less those before its start, from one running count. No point meets a span, so neither long
    spans nor crowded moments matter."""
    # Null spans count nothing; the row number tells equal spans apart.
    numbered_spans = cut_lineage(spans.withColumn("_span", F.monotonically_increasing_id()), "spans")
    crowd = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("timestamp").alias("_at")).agg(F.count(F.lit(1)).alias("_w"))
    edges = numbered_spans.where(F.col(starts) < F.col(ends)).select("_span", F.inline(F.array(
        F.struct(F.col(starts).cast("timestamp").alias("_at"), F.lit(-1).alias("_sign")),
        F.struct(F.col(ends).cast("timestamp").alias("_at"), F.lit(1).alias("_sign")))))
    lined = crowd.select("_at", "_w", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_span"), F.lit(None).cast("int").alias("_sign")).unionByName(
        edges.select("_at", F.lit(0).cast("bigint").alias("_w"), F.lit(0).alias("_kind"), "_span", "_sign"))
    # At one moment edges come first: a point at an end is outside, one at a start inside.
    done = running(lined, [], ["_at", "_kind", "_span", "_sign"], [Running("_before", "sum", F.col("_w"))], rows_per_range)
    counted = done.where("_kind = 0").groupBy("_span").agg(F.sum(F.col("_sign") * F.col("_before")).alias(name))
    return numbered_spans.join(counted, "_span", "left").select(*spans.columns, F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each left row with the latest ``value`` of its key at or before it; of several
    at the same instant the greatest counts. No row pairs are formed: both sides are
    lined up once and the last known value is carried forward."""
    lined = left.withColumn("_right", F.lit(1)).unionByName(
        right.select(*by, on, value, F.lit(0).alias("_right")), allowMissingColumns=True)
    # At one instant right rows come first, in value order.
    tie = [c for c in left.columns if c not in (on, *by)]
    done = running(lined, by, [on, "_right", value, *tie], [Running("_seen", "last", F.col(value))],
                   rows_per_range)
    return done.where("_right = 1").select(*left.columns, F.col("_seen").alias(value))


def rolling_agg(df: DataFrame, keys: list[str], order: list[str], n: int, agg: Column,
                name: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``agg`` over the last ``n`` rows of each key."""
    return framed(df, keys, order, n - 1, 0, {name: lambda w: agg.over(w.rowsBetween(-(n - 1), 0))}, rows_per_range)


def rolling_span(df: DataFrame, keys: list[str], at: str, seconds: int, agg: Column,
                 name: str, spans_per_block: int = 16) -> DataFrame:
    """``agg`` over the rows of each key in the last ``seconds``. Time is cut into blocks
    of several spans; rows at the end of a block are also shown to the next one."""
    reach = seconds * 1_000_000
    moment, block = F.unix_micros(F.col(at)), F.lit(reach * spans_per_block)
    own, last = F.floor(moment / block), F.floor((moment + reach) / block)
    shown = df.select("*", F.posexplode(F.when(last > own, F.array(own, last)).otherwise(F.array(own)))
                      .alias("_copy", "_block"))
    w = Window.partitionBy(*keys, "_block").orderBy(moment).rangeBetween(-reach, 0)
    return shown.withColumn(name, agg.over(w)).where("_copy = 0").select(*df.columns, name)


def is_unique(df: DataFrame, keys: list[str], glance: int = 100_000) -> bool:
    """No key value occurs twice; rows without a key match nothing and do not count. A
    glance at some rows shows most repeats without a shuffle of the whole table."""
    keyed = df.select(*[col(k) for k in keys]).dropna()
    repeats = lambda rows: rows.groupBy(*[col(k) for k in keys]).count().where("count > 1").take(1)
    return not repeats(keyed.limit(glance)) and not repeats(keyed)


def join_order(tables: dict[str, DataFrame]) -> tuple[str, list[tuple[str, list[str]]]]:
    """Start table and the (table, keys) joined to it in turn. A side is joined only on
    a key that is unique there, as rows would multiply otherwise. The start is the table
    from which most others can be reached; ties go to more shared columns."""
    names = list(tables)
    cols = {n: tables[n].columns for n in names}
    checked: dict[tuple, bool] = {}

    def unique(n, keys):
        if (n, *keys) not in checked:
            checked[(n, *keys)] = is_unique(tables[n], keys)
        return checked[(n, *keys)]

    def reach(start):
        have, left, steps = list(cols[start]), [n for n in names if n != start], []
        progress = True
        while left and progress:
            progress = False
            for n in list(left):
                keys = [c for c in have if c in cols[n]]
                if keys and unique(n, keys):
                    steps.append((n, keys))
                    have += [c for c in cols[n] if c not in have]
                    left.remove(n)
                    progress = True
        return steps

    shared = {n: sum(len(set(cols[n]) & set(cols[m])) for m in names if m != n) for n in names}
    plans = {n: reach(n) for n in names}
    start = max(names, key=lambda n: (len(plans[n]), shared[n], -names.index(n)))
    return start, plans[start]


def assemble_tables(tables: dict[str, DataFrame], links: dict[str, tuple[str, str]] | None = None):
    """Row-level view over several tables by LEFT JOINs on shared columns.

    ``links`` names equal keys with different names: {"c_custkey": ("orders", "o_custkey")}
    adds a copy of orders.o_custkey called c_custkey. Returns (view, note).
    """
    tables = dict(tables)
    for target, (owner, source) in (links or {}).items():
        if target not in tables[owner].columns:
            tables[owner] = tables[owner].withColumn(target, col(source))
    start, steps = join_order(tables)
    view = tables[start]
    for n, keys in steps:
        view = view.join(tables[n], keys, "left")
    used = [start] + [n for n, _ in steps]
    left = [n for n in tables if n not in used]
    note = f"This view combines {', '.join(used)}." + (f" Left out: {', '.join(left)}." if left else "")
    return drop_duplicate_names(view), note


def largest_table(catalog: DataFrame) -> DataFrame:
    """Name of the table with most rows; the first in upload order on a tie."""
    return catalog.agg(F.max_by("name", F.struct("row_count", -F.col("position"))).alias("name"))


def assembled_or_largest(tables: dict[str, DataFrame], build) -> tuple[DataFrame, str]:
    """``build()`` written once if it works on all rows and has some, else the largest table. A
    view that breaks at run time breaks while it is written, so any failure falls back."""
    try:
        view = cut_lineage(build(), "assembled")
        if not view.isEmpty():
            return view, f"Joined from {', '.join(tables)}."
    except (QueryError, PySparkException) as failed:
        log.warning("the tables could not be joined: %s", failed)
    sizes = {n: df.count() for n, df in tables.items()}
    name = max(sizes, key=sizes.get)
    return tables[name], f"Only {name} is used, the largest of {len(tables)} tables."


def leader_split(df: DataFrame, leaders: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the leaders, all other rows). Rows without a key are 'other'."""
    return df.join(leaders, key, "left_semi"), df.join(leaders, key, "left_anti")
