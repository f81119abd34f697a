"""Running totals and last-known values over an ordering, without giving one
key's whole history to one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in a
single task, so a key that holds a third of the rows becomes the whole job. Here
the order column is cut into ranges of about equal row count. Each (key, range)
is scanned by its own task; what flows from one range into the next is a single
pre-aggregated row per (key, range).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 4096


@dataclass
class Running:
    """One running value. kind: sum | min | max | last (ignores nulls).
    ``inclusive=False`` leaves the current row out."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def numeric_key(df: DataFrame, column: str) -> Column:
    """A DOUBLE that never decreases when ``column`` increases."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(F.col(column)).cast("double")
    return F.col(column).cast("double")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where null equals null, so that rows with a null key
    meet what was computed for them. Still a hash or merge join."""
    if not keys:
        return left.crossJoin(right)  # the right side is one row
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    same = [left[f"`{k}`"].eqNullSafe(renamed[n]) for k, n in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def range_bounds(df: DataFrame, column: str, rows_per_range: int = ROWS_PER_RANGE,
                 at_most: int | None = None) -> list[float]:
    """At most MAX_RANGES-1 cut points; a value that fills several ranges is cut
    out on its own so that its neighbours do not share a task with it. A caller who
    knows a bound on the row count passes it and saves the count."""
    if at_most is not None and at_most <= rows_per_range:
        return []
    key = numeric_key(df, column)
    n = df.agg(F.count(key).alias("n")).first()["n"]
    parts = min(MAX_RANGES, -(-n // rows_per_range))
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(key, probs, max(10_000, parts * 20)).alias("q")).first()["q"]
    out: list[float] = []
    for cut in cuts:
        if out and cut <= out[-1]:
            after = math.nextafter(cut, math.inf)
            if out[-1] < after:
                out.append(after)
        else:
            out.append(cut)
    return out


def with_range(df: DataFrame, column: str, bounds: list[float], name: str = "_range") -> DataFrame:
    """Add the range number of ``column`` (binary search on the JVM side)."""
    keyed = df.withColumn("_range_key", F.coalesce(numeric_key(df, column), F.lit(float("-inf"))))
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_range_key", outputCol=name)
    return cut.transform(keyed).drop("_range_key").withColumn(name, F.col(name).cast("int"))


def text_key(c: Column) -> Column:
    """A DOUBLE that never decreases when the text increases: its first six bytes as a number."""
    return F.conv(F.hex(F.rpad(F.substring(c.cast("binary"), 1, 6), 6, F.lit(b"\x00"))), 16, 10).cast("double")


def _further_key(df: DataFrame, column: str) -> Column:
    return text_key(F.col(column)) if df.schema[column].dataType.typeName() == "string" else numeric_key(df, column)


def with_finer_ranges(ranged: DataFrame, order: list[str], bounds: list[float], rows_per_range: int) -> DataFrame:
    """Ranges that hold one value of ``order[0]`` only, cut by the following columns of the order until
    they are of the wanted size or the columns end. Ranges then are numbers of any size that
    still follow the order; what they mean is known within this frame only."""
    alone = [k + 1 for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b == math.nextafter(a, math.inf)]
    ranged = ranged.withColumn("_range", F.col("_range").cast("double"))
    if not alone:
        return ranged
    crowded = F.col("_range").isin([float(k) for k in alone])
    width = 1.0
    # 12 bits for the range and 14 for the steps within: two more columns are exact in a DOUBLE.
    for column in order[1:3]:
        if ranged.schema[column].dataType.typeName() in ("array", "map", "struct", "binary"):
            break
        key = F.coalesce(_further_key(ranged, column), F.lit(float("-inf")))
        sizes = ranged.where(crowded).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * rows_per_range)
        # At most one row for every 2 * rows_per_range rows of the table.
        wide = {r["_range"]: min(MAX_RANGES, -(-r["n"] // rows_per_range)) for r in sizes.collect()}
        if not wide:
            break
        width /= 4 * MAX_RANGES
        parts = max(wide.values())
        cuts = ranged.where(F.col("_range").isin(list(wide))).groupBy("_range").agg(F.percentile_approx(
            key, [i / parts for i in range(1, parts)], max(10_000, parts * 20)).alias("q"))
        found = {r["_range"]: sorted(set(r["q"])) for r in cuts.collect()}
        below = F.lit(0)
        for number, values in found.items():
            # A cut value gets a range of its own as well: two steps for each cut.
            steps = F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= key)) + F.size(
                F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v < key))
            below = F.when(F.col("_range") == number, steps).otherwise(below)
        # Fewer than 2 * MAX_RANGES steps: half of the way to the next range.
        ranged = cut_lineage(ranged.withColumn("_range", F.col("_range") + below * F.lit(width)), "ranges")
        crowded = F.col("_range") != F.floor("_range")
    return ranged


def crowded_keys(df: DataFrame, keys: list[str], rows_per_range: int) -> DataFrame:
    """Keys with more rows than one task should order: at most one for every ``rows_per_range`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return cut_lineage(sizes.where(F.col("_rows") > rows_per_range).drop("_rows"), "crowded")


def _local(item: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if item.inclusive else -1)
    if item.kind == "last":
        return F.last(item.value, ignorenulls=True).over(frame)
    return getattr(F, item.kind)(item.value).over(frame)


def _merge(item: Running, carried: Column, local: Column) -> Column:
    if item.kind == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if item.kind == "min":
        return F.least(carried, local)
    if item.kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def running(df: DataFrame, keys: list[str], order: list[str], items: list[Running],
            rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None,
            bounds: list[float] | None = None) -> DataFrame:
    """``df`` plus one running value per item. Null keys are a key; ``order[0]``
    is a number, date or timestamp and ``order`` as a whole is unique per key. Where many rows share
    one ``order[0]``, the next two columns of the order cut them further. Only keys with more than
    ``rows_per_range`` rows are cut; the others take one shuffle and one window. ``bounds``
    reuses the ranges of an earlier call over the same order, for all keys."""
    if bounds is None and keys and (at_most is None or at_most > rows_per_range):
        crowded = crowded_keys(df, keys, rows_per_range)
        if crowded.isEmpty():
            return running(df, keys, order, items, bounds=[])
        others, busy = (join_keys(df, F.broadcast(crowded), keys, how) for how in ("left_anti", "left_semi"))
        return running(others, keys, order, items, bounds=[]).unionByName(running(
            busy, keys, order, items, rows_per_range, bounds=range_bounds(busy, order[0], rows_per_range)))
    if bounds is None:
        bounds = range_bounds(df, order[0], rows_per_range, at_most)
    sort = [F.col(c).asc_nulls_first() for c in order]
    if not bounds:
        window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*sort)
        return df.withColumns({i.name: _local(i, window) for i in items})

    ranged = with_finer_ranges(with_range(df, order[0], bounds), order, bounds, rows_per_range)
    # Total per (key, range): combined before the shuffle, so hot keys stay small.
    totals = []
    for n, item in enumerate(items):
        if item.kind == "last":
            at = F.struct(*[F.col(c) for c in order])
            totals.append(F.max_by(item.value, F.when(item.value.isNotNull(), at)).alias(f"_t{n}"))
        else:
            totals.append(getattr(F, item.kind)(item.value).alias(f"_t{n}"))
    per_range = ranged.groupBy(*keys, "_range").agg(*totals)
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(*keys, "_range", *[
        (F.last(f"_t{n}", ignorenulls=True) if i.kind == "last" else getattr(F, i.kind)(f"_t{n}"))
        .over(before).alias(f"_c{n}") for n, i in enumerate(items)])
    joined = join_keys(ranged, carry, [*keys, "_range"], "left")
    local = Window.partitionBy(*keys, "_range").orderBy(*sort)
    done = joined.withColumns({
        i.name: _merge(i, F.col(f"_c{n}"), _local(i, local)) for n, i in enumerate(items)})
    return done.select(*df.columns, *[i.name for i in items])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
             rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None) -> DataFrame:
    """row_number() per key."""
    return running(df, keys, order, [Running(name, "sum", F.lit(1).cast("bigint"))], rows_per_range, at_most)


def value_ranks(df: DataFrame, column: str, weight: Column | None = None,
                rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None) -> DataFrame:
    """One row per distinct non-null value: ``value, n, before, dense`` where
    ``before`` counts the rows with a smaller value."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("n")))
    return running(counts, [], ["value"], [
        Running("_upto", "sum", F.col("n")), Running("dense", "sum", F.lit(1).cast("bigint")),
    ], rows_per_range, at_most).select("value", "n", (F.col("_upto") - F.col("n")).alias("before"), "dense")


def framed(df: DataFrame, keys: list[str], order: list[str], before: int, after: int,
           columns: dict[str, Callable], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead of
    each row of its key (lag, lead, ROWS frames). ``columns`` maps a name to a function
    of the window. Rows are numbered per key and cut into blocks; the rows at the edges
    of a block are also shown to its neighbours, so a busy key is spread over many tasks."""
    block = max(rows_per_range, before + after + 1)
    rn = numbered(df, keys, order, "_rn", rows_per_range).withColumn("_rn", F.col("_rn") - 1)
    own, at = F.floor(F.col("_rn") / block), F.col("_rn") % block
    shown = rn.select("*", F.posexplode(F.array_compact(F.array(
        own, F.when(at >= block - before, own + 1), F.when((at < after) & (own > 0), own - 1)))).alias("_copy", "_block"))
    w = Window.partitionBy(*keys, "_block").orderBy("_rn")
    done = shown.withColumns({name: make(w) for name, make in columns.items()})
    return done.where("_copy = 0").select(*df.columns, *columns)


def row_ranks(df: DataFrame, keys: list[str], order: list[str], tiles: int,
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds rn, tile and pr: row_number, ntile(tiles) and percent_rank of a unique order,
    all from the running count and the size of the key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rn = join_keys(numbered(df, keys, order, "rn", rows_per_range), sizes, keys)
    small, extra = F.floor(F.col("_n") / tiles), F.col("_n") % tiles
    head = extra * (small + 1)  # the first tiles hold one row more
    tile = F.when(F.col("rn") <= head, F.ceil(F.col("rn") / (small + 1))).otherwise(
        extra + F.ceil((F.col("rn") - head) / F.greatest(small, F.lit(1))))
    pr = F.when(F.col("_n") > 1, (F.col("rn") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return rn.select(*df.columns, "rn", tile.cast("bigint").alias("tile"), pr.alias("pr"))


def label_ranks(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Adds rk and drk: rank and dense_rank by a label with few values per key. Rows are
    counted per label first, so the window sees labels, not rows."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col(label).asc_nulls_last())
    smaller = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per.select(*keys, label, (smaller + 1).alias("rk"), F.row_number().over(w).cast("bigint").alias("drk"))
    return join_keys(df, ranks, [*keys, label])


def ends(df: DataFrame, keys: list[str], order: list[str], first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """Adds the first and last value of columns per key: {new name: column}."""
    at = F.struct(*[F.col(c) for c in order])
    per = df.groupBy(*keys).agg(*[F.min_by(c, at).alias(n) for n, c in first.items()],
                                *[F.max_by(c, at).alias(n) for n, c in last.items()])
    return join_keys(df, per, keys)
