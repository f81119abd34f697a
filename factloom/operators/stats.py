"""Column statistics: one shared pass, exact distinct counts, exact quantiles,
and the three correlation methods."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import QueryError
from ..session import cut_lineage
from . import ordered

SMALL_QUANTILE_ROWS = 1_000_000
# Spark compiles aggregates of up to 100 buffer fields; wider ones fall back to slow code.
COLUMNS_PER_PASS = 6
PAIRS_PER_PASS = 50
LONG_TEXT = 128
# Values with more rows than this part of a range count as common.
RARE_PART = 8


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f)]


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree: the planner walks a shallow plan."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is 'missing' everywhere in this library."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def adjusted_skewness(value: Column) -> Column:
    """Sample skewness; Spark's own is the population form."""
    n = F.count(value).cast("double")
    # A constant column has no skew: 0, as the sample form defines it.
    flat = F.min(value) == F.max(value)
    return F.when(n > 2, F.when(flat, F.lit(0.0)).otherwise(
        F.skewness(value) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0))))


def chunks(items: list, size: int) -> list[list]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column without a wide shuffle: position, type, n, nulls, mean, std,
    min, max, spread, skew. Text columns carry only counts and text min/max.

    Six columns share an aggregate, which keeps its buffers within what Spark compiles;
    on Parquet every such branch reads just its own columns."""
    parts = []
    for chunk in chunks(list(enumerate(df.schema)), COLUMNS_PER_PASS):
        aggs, structs = [F.count(F.lit(1)).alias("_rows")], []
        for i, f in chunk:
            c = col(f.name)
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"),
                     F.max(c).cast("string").alias(f"hi{i}")]
            if is_numeric(f):
                d = c.cast("double")
                aggs += [F.avg(d).alias(f"avg{i}"), F.stddev_samp(d).alias(f"std{i}"),
                         F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}"),
                         adjusted_skewness(d).alias(f"skew{i}")]
                nums = [F.col(f"{k}{i}") for k in ("avg", "std", "min", "max", "skew")]
            else:
                nums = [F.lit(None).cast("double")] * 5
            structs.append(F.struct(
                F.lit(f.name).alias("name"), F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"),
                F.col(f"n{i}").alias("n"), (F.col("_rows") - F.col(f"n{i}")).alias("nulls"),
                *[v.alias(k) for k, v in zip(("mean", "std", "min", "max", "skew"), nums)],
                F.col(f"lo{i}").alias("min_text"), F.col(f"hi{i}").alias("max_text")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    return union_all(parts).withColumn("spread", F.col("std") / (F.abs("mean") + F.lit(1e-9)))


def long_text_columns(df: DataFrame, rows: int = 200) -> set[str]:
    """Text columns whose cells look long, judged by a few rows. This picks a cheaper
    way to the same result, never the result."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return set()
    seen = df.select(*[F.length(col(c)).alias(f"l{i}") for i, c in enumerate(texts)]).limit(rows).agg(
        *[F.avg(f"l{i}") for i in range(len(texts))]).first()
    return {c for c, n in zip(texts, seen) if (n or 0) > LONG_TEXT}


def distinct_key(c: Column, long: bool) -> Column:
    """What to shuffle to tell values apart: long texts travel as their SHA-256 digest."""
    return F.sha2(c, 256) if long else c


def distinct_counts(df: DataFrame, columns: list[str] | None = None, fused: bool = False,
                    long: set[str] | None = None) -> DataFrame:
    """Exact distinct non-null count per column as (name, distinct_count).

    Default: one narrow ``distinct`` per column, united. On Parquet or a cached
    table each branch reads only its own column, so total I/O equals one scan and
    the shuffle carries bare values. ``fused`` makes it one scan with an expanded
    row per column: better when the input is an expensive plan that is not stored.
    """
    columns = columns or df.columns
    long = long_text_columns(df.select(*[col(c) for c in columns])) if long is None else long
    keys = {c: distinct_key(col(c), c in long) for c in columns}
    if fused:
        wide = df.agg(*[F.count_distinct(keys[c]).alias(f"d{i}") for i, c in enumerate(columns)])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("name"), F.col(f"d{i}").alias("distinct_count"))
            for i, c in enumerate(columns)])))
    return union_all([df.select(keys[c].alias("v")).where(F.col("v").isNotNull()).distinct()
                      .agg(F.count(F.lit(1)).alias("distinct_count"))
                      .select(F.lit(c).alias("name"), "distinct_count") for c in columns])


class _Target:
    """Search for the k-th smallest value (0-based) of one column: it lies in [lo, hi],
    which holds ``inside`` values with ``below`` smaller ones before them."""

    def __init__(self, column: str, k: int, lo: float, hi: float, n: int) -> None:
        self.column, self.k, self.lo, self.hi, self.below, self.inside = column, k, lo, hi, 0, n
        self.value: float | None = lo if lo == hi else None
        self.stuck = False

    def probes(self) -> list[float]:
        at = (self.k - self.below) / max(self.inside - 1, 1)
        return [max(0.0, at - 2e-4), min(1.0, at + 2e-4)]

    def narrow(self, a, b, under_a, upto_a, under_b, upto_b) -> None:
        before = (self.lo, self.hi)
        if under_a <= self.k < upto_a:
            self.value = a
        elif under_b <= self.k < upto_b:
            self.value = b
        elif self.k < under_a:  # the sketch missed on this side
            self.hi, self.inside = a, upto_a - self.below
        elif self.k >= upto_b:
            self.lo, self.below, self.inside = b, under_b, self.below + self.inside - under_b
        else:
            self.lo, self.hi, self.below, self.inside = a, b, under_a, upto_b - under_a
        self.stuck = self.value is None and (self.lo, self.hi) == before


def _kth_values(df: DataFrame, targets: list[_Target], small: int) -> None:
    """Settle all targets together. Per round a bounded sketch, shared by the targets of a column that
    lie in the same bracket, proposes a narrower one for each and exact counts confirm it; about 1 row in 2500 stays, so two or three rounds
    of two scans do for any size. What is left is ranked with ``value_ranks``."""
    value = lambda t: col(t.column).cast("double")
    within = lambda t: F.when((value(t) >= t.lo) & (value(t) <= t.hi), value(t))
    while True:
        todo = [t for t in targets if t.value is None and not t.stuck and t.inside > small]
        if not todo:
            break
        shared: dict[tuple, list[_Target]] = {}
        for t in todo:
            shared.setdefault((t.column, t.lo, t.hi), []).append(t)
        for chunk in chunks(list(shared.values()), 2):
            found = df.agg(*[F.percentile_approx(within(g[0]), [p for t in g for p in t.probes()], 10_000).alias(f"p{i}")
                             for i, g in enumerate(chunk)]).first()
            ends = [(t, *found[i][2 * j:2 * j + 2]) for i, g in enumerate(chunk) for j, t in enumerate(g)]
            for part in chunks(ends, 12):
                counts = df.agg(*[F.count_if(test).alias(f"c{i}_{j}") for i, (t, a, b) in enumerate(part) for j, test in enumerate(
                    [value(t) < a, value(t) <= a, value(t) < b, value(t) <= b])]).first()
                for i, (t, a, b) in enumerate(part):
                    t.narrow(a, b, *counts[4 * i:4 * i + 4])
    rest = [t for t in targets if t.value is None]
    if rest:
        # All in one table by target, ranked per target: a union of windows without a key would be one task.
        seen = [within(t) for t in rest]
        held = df.where(reduce(lambda a, b: a | b, [v.isNotNull() for v in seen])).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), v.alias("value")) for i, v in enumerate(seen)]))).where(F.col("value").isNotNull())
        counts = held.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = ordered.running(counts, ["i"], ["value"], [ordered.Running("upto", "sum", F.col("n"))], at_most=max(t.inside for t in rest))
        wanted = F.get(F.array(*[F.lit(t.k - t.below) for t in rest]), F.col("i"))
        for r in upto.where(F.col("upto") - F.col("n") <= wanted).groupBy("i").agg(F.max("value").alias("v")).collect():
            rest[r["i"]].value = r["v"]


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    small: int = SMALL_QUANTILE_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of every column, exact at any size. Spark's
    ``percentile`` keeps one value map per column, of all columns in a single task, so it is used
    only where each has at most its part of ``small`` values. NaN counts as missing."""
    small = small // max(1, len(columns))
    df = nan_to_null(df.select(*[col(c) for c in columns]))
    seen = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.count(col(c)).alias(f"n{i}"), F.min(col(c).cast("double")).alias(f"lo{i}"), F.max(col(c).cast("double")).alias(f"hi{i}"))]).first()
    sizes = {c: seen[f"n{i}"] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns if not sizes[c]}
    few = [c for c in columns if 0 < sizes[c] <= small]
    if few:
        row = df.agg(*[F.percentile(col(c).cast("double"), F.array(*[F.lit(p) for p in probs]))
                       .alias(f"p{i}") for i, c in enumerate(few)]).first()
        out.update({c: list(row[i]) for i, c in enumerate(few)})
    targets: dict[tuple[str, int], _Target] = {}
    for i, c in enumerate(columns):
        if sizes[c] > small:
            for p in probs:
                for k in _around(p, sizes[c])[:2]:
                    targets.setdefault((c, k), _Target(c, k, seen[f"lo{i}"], seen[f"hi{i}"], sizes[c]))
    _kth_values(df, list(targets.values()), small)
    for c in {c for c, _ in targets}:
        out[c] = []
        for p in probs:
            low, high, share = _around(p, sizes[c])
            a, b = targets[c, low].value, targets[c, high].value
            out[c].append(a + share * (b - a))
    return out


def grouped_medians(df: DataFrame, keys: list[str], measures: list[str], small: int = SMALL_QUANTILE_ROWS) -> DataFrame:
    """Exact median of each measure per group: the keys, then the measures. Groups of up to
    ``small`` values use Spark's ``median``, which holds a group's values in one task. For larger ones a
    sketch gives a bracket around the middle; one scan then counts what lies below it and
    the distinct values inside, about one row in 2500, and running counts over these find the
    middle. Groups whose bracket missed are counted over all their values. Null keys are a group."""
    names = [f"k{i}" for i in range(len(keys))]
    shown = F.inline(F.array(*[F.struct(F.lit(i).alias("m"), col(c).cast("double").alias("v")) for i, c in enumerate(measures)]))
    tall = nan_to_null(df.select(*[col(k).alias(n) for k, n in zip(keys, names)], shown))
    by = [*names, "m"]
    sizes = tall.groupBy(*by).agg(F.count("v").alias("n"))
    big = cut_lineage(sizes.where(F.col("n") > small), "large-groups")
    if big.isEmpty():
        per = tall.groupBy(*by).agg(F.median("v").alias("mid"))
    else:
        marked = ordered.join_keys(tall, big, by, "left")
        rest = marked.where("n is null").groupBy(*by).agg(F.median("v").alias("mid"))
        rows = marked.where("n is not null and v is not null")
        near = [0.5 - 2e-4, 0.5 + 2e-4]
        brackets = cut_lineage(rows.groupBy(*by).agg(F.first("n").alias("n"), F.percentile_approx("v", near, 10_000).alias("at")).select(
            *by, "n", F.col("at")[0].alias("lo"), F.col("at")[1].alias("hi")), "brackets")
        found = _middles(tall, brackets, by)
        missed = brackets.select(*by, "n", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        missed = cut_lineage(ordered.join_keys(missed, found.where("a is null or b is null").select(*by), by, "left_semi"), "missed")
        if not missed.isEmpty():
            found = found.where("a is not null and b is not null").unionByName(_middles(tall, missed, by))
        per = rest.unionByName(found.select(*by, (0.5 * F.col("a") + 0.5 * F.col("b")).alias("mid")))
    wide = per.groupBy(*names).agg(*[F.max(F.when(F.col("m") == i, F.col("mid"))).alias(c) for i, c in enumerate(measures)])
    return wide.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[col(c) for c in measures])


def _middles(tall: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): the two middle values of each group of ``brackets``, null where they lie outside."""
    rows = ordered.join_keys(tall.where("v is not null"), brackets, by)
    # What lies outside a bracket is one cell on either side, combined before the shuffle.
    value = F.when(F.col("v") < F.col("lo"), float("-inf")).when(F.col("v") > F.col("hi"), float("inf")).otherwise(F.col("v"))
    side = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0)
    cells = cut_lineage(rows.groupBy(*by, "n", side.alias("side"), value.alias("v")).agg(F.count(F.lit(1)).alias("w")), "middles")
    upto = ordered.running(cells, by, ["v", "side"], [ordered.Running("upto", "sum", F.col("w"))])
    def holds(k: Column) -> Column:
        return (F.col("side") == 0) & (F.col("upto") - F.col("w") <= k) & (k < F.col("upto"))

    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return upto.groupBy(*by).agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))


def _around(p: float, n: int) -> tuple[int, int, float]:
    """Ranks on both sides of quantile ``p`` and the share of the way to the upper one."""
    at = p * (n - 1)
    low = int(at)
    return low, min(low + (at > low), n - 1), at - low


# -- correlation ------------------------------------------------------------

def pearson_expr(a: Column, b: Column) -> Column:
    """Pairwise-complete r; null when either side is constant."""
    spread = (F.stddev_samp(F.when(b.isNotNull(), a)) * F.stddev_samp(F.when(a.isNotNull(), b)))
    return clipped(F.try_divide(F.covar_samp(a, b), spread))


def clipped(r: Column) -> Column:
    """Keep rounding from leaving [-1, 1]; ``least`` and ``greatest`` alone would turn a
    missing r into 1."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, a, b, r) for every pair a<b in column order.

    A first narrow pass finds means, ranges and gaps. Pairs of columns without gaps then
    need one sum each, of products of centred values; the other sums are shared by
    column. Pairs with gaps are judged on the rows where both are present.
    """
    value = [col(c).cast("double") for c in columns]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[a for i, v in enumerate(value) for a in (
        F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), (F.min(v) < F.max(v)).alias(f"v{i}"))]).first()
    rows = seen["rows"]
    full = [seen[f"n{i}"] == rows and rows > 0 for i in range(len(columns))]
    centred = [v - F.lit(seen[f"m{i}"]) if full[i] else v for i, v in enumerate(value)]
    pairs = [(n, i, j) for n, (i, j) in enumerate(combinations(range(len(columns)), 2))]
    parts = []
    for complete, size in ((True, PAIRS_PER_PASS), (False, PAIRS_PER_PASS // 10)):
        chosen = [p for p in pairs if (full[p[1]] and full[p[2]]) == complete]
        for chunk in chunks(chosen, size):
            if complete:
                used = sorted({i for _, *ij in chunk for i in ij})
                wide = df.agg(*[a for i in used for a in (F.sum(centred[i]).alias(f"s{i}"), F.sum(centred[i] * centred[i]).alias(f"q{i}"))],
                              *[F.sum(centred[i] * centred[j]).alias(f"p{n}") for n, i, j in chunk])
                var = lambda i: F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / rows
                r = {n: F.when(F.lit(bool(seen[f"v{i}"] and seen[f"v{j}"])), F.try_divide(
                    F.col(f"p{n}") - F.col(f"s{i}") * F.col(f"s{j}") / rows, F.sqrt(var(i)) * F.sqrt(var(j)))) for n, i, j in chunk}
                r = {n: clipped(e) for n, e in r.items()}
            else:
                wide = df.agg(*[pearson_expr(value[i], value[j]).alias(f"r{n}") for n, i, j in chunk])
                r = {n: F.col(f"r{n}") for n, _, _ in chunk}
            parts.append(wide.select(F.inline(F.array(*[
                F.struct(F.lit(n).alias("pair"), F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), r[n].alias("r"))
                for n, i, j in chunk]))))
    return union_all(parts)


def _contingencies(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, int]:
    """(pair, a, b, w): the distinct complete values of all pairs of columns with their counts, from
    one scan, and the number of these cells. Stored once, as ranks read them several times."""
    shown = F.array(*[F.struct(F.lit(n).alias("pair"), col(a).cast("double").alias("a"), col(b).cast("double").alias("b"))
                      for n, (a, b) in enumerate(pairs)])
    cells = cut_lineage(df.select(F.inline(shown)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
                        .groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("w")), "pairs")
    return cells, cells.count()


def _mid_ranks(cells: DataFrame, key: str, value: str, weight: Column, rows_per_range: int, at_most: int) -> DataFrame:
    """(key, value, rank, dense, n) of every distinct value of every ``key``: ``rank`` is the mean rank of its
    ``n`` rows, ``dense`` counts the values up to it. No key is ranked in one task."""
    counts = cells.groupBy(key, value).agg(F.sum(weight).cast("bigint").alias("_n"))
    return ordered.running(counts, [key], [value], [
        ordered.Running("_upto", "sum", F.col("_n")), ordered.Running("dense", "sum", F.lit(1).cast("bigint"))], rows_per_range, at_most).select(
        key, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"), "dense", F.col("_n").alias("n"))


def _with_ranks(cells: DataFrame, ranks: DataFrame, key: str, value: str, column: str, name: str, rows_per_value: int) -> DataFrame:
    """``cells`` with the ``column`` of ``ranks`` that belongs to their value. Values of more than ``rows_per_value``
    rows are few, so theirs are sent to all tasks, and their cells are dealt by all columns; only cells
    of other values are dealt by value. A column of few values thus does not end up in few tasks."""
    common = ranks.where(F.col("n") > rows_per_value).select(key, value, F.col(column).alias("_common"))
    marked = cells.join(F.broadcast(common), [key, value], "left")
    deal = F.when(F.col("_common").isNull(), F.xxhash64(key, value)).otherwise(F.xxhash64(*cells.columns))
    rare = ranks.where(F.col("n") <= rows_per_value).select(key, value, F.xxhash64(key, value).alias("_deal"), F.col(column).alias("_rare"))
    return marked.withColumn("_deal", deal).join(rare, [key, value, "_deal"], "left").select(
        *cells.columns, F.coalesce("_common", "_rare").alias(name))


def ranked_columns(df: DataFrame, columns: list[str], rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """``columns`` with each value replaced by its mean rank. All columns are ranked together, as one
    table of (column, value) cells; two shuffles of the cells do for any number of columns."""
    staged = cut_lineage(df.select(F.monotonically_increasing_id().alias("_id"), *[
        col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "columns")
    cells = staged.select("_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(len(columns))])))
    ranks = cut_lineage(_mid_ranks(cells, "c", "v", F.lit(1), rows_per_range, None), "ranks")
    placed = _with_ranks(cells, ranks, "c", "v", "rank", "rank", rows_per_range // RARE_PART).groupBy("_id").agg(*[
        F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(columns))])
    return placed.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])


def spearman_cells(df: DataFrame, pairs: list[tuple[str, str]], rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """(pair, r): rank correlations over the rows where both sides are present, all pairs at
    once. Equal pairs of values are counted first, and ranks come from distinct values."""
    cells, size = _contingencies(df, pairs)
    for side in ("a", "b"):
        ranks = cut_lineage(_mid_ranks(cells, "pair", side, F.col("w"), rows_per_range, size), "ranks")
        cells = _with_ranks(cells, ranks, "pair", side, "rank", f"r{side}", rows_per_range // RARE_PART)
    # The mean rank is known, (n+1)/2, so the moments are centred up front.
    mid = cells.groupBy("pair").agg(((F.sum("w") + 1) / 2).alias("mid"))
    x, y, w = F.col("ra") - F.col("mid"), F.col("rb") - F.col("mid"), F.col("w")
    # One row for a pair: sent to all tasks, since a shuffle by pair would put each pair's cells into one.
    return cells.join(F.broadcast(mid), "pair").groupBy("pair").agg(
        F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias("r"))


def spearman_pairs(df: DataFrame, columns: list[str], rows_per_range: int = ordered.ROWS_PER_RANGE) -> DataFrame:
    """(a, b, r) for all pairs of columns. Columns without gaps have one rank for a row, whatever
    they are paired with: those are stored once and correlated in shared passes. The
    other pairs are ranked over their own complete rows, also together."""
    seen = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in columns]).first()
    full = [c for c, n in zip(columns, seen[1:]) if n == seen[0]]
    both = lambda a, b: len(full) > 1 and a in full and b in full
    gaps = [p for p in combinations(columns, 2) if not both(*p)]
    parts = []
    if len(full) > 1:
        ranked = cut_lineage(ranked_columns(df, full, rows_per_range), "ranked")
        parts.append(pearson_pairs(ranked, full).select("a", "b", "r"))
    if gaps:
        parts.append(_named_pairs(spearman_cells(df, gaps, rows_per_range), gaps))
    return union_all(parts)


def _named_pairs(found: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, r) of (pair, r); pairs without a complete row have none."""
    names = found.sparkSession.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(found, "pair", "left").select("a", "b", "r")


def kendall_cells(df: DataFrame, pairs: list[tuple[str, str]], rows_per_range: int = ordered.ROWS_PER_RANGE,
                  digit_bits: int = 3) -> DataFrame:
    """(pair, r): Kendall's tau-b of all pairs at once, without comparing pairs of rows.

    Values of ``a`` get dense ranks, read as digits in base 8. Two values first
    differ at exactly one digit, so the concordant pairs are the sum over digit
    positions of: within rows sharing the higher digits, in ``b`` order, how much
    weight came earlier with a smaller digit. That is a running total per digit.
    """
    cells, size = _contingencies(df, pairs)
    ranks = cut_lineage(_mid_ranks(cells, "pair", "a", F.col("w"), rows_per_range, size), "ranks")
    cells = cut_lineage(_with_ranks(cells, ranks, "pair", "a", "dense", "dense", rows_per_range // RARE_PART).select(
        "pair", "b", "w", (F.col("dense") - 1).alias("code")), "codes")
    base = 1 << digit_bits
    levels = max(1, -(-(cells.agg(F.max("code")).first()[0] or 0).bit_length() // digit_bits))
    bounds = ordered.range_bounds(cells, "b", rows_per_range, size)
    parts = []
    for level in range(levels):
        shift = level * digit_bits
        group = F.shiftright("code", shift + digit_bits)
        digit = F.shiftright("code", shift).bitwiseAND(base - 1)
        # Peers in b must not count, so sum per (group, b, digit) and use totals
        # of strictly smaller b.
        per = cells.groupBy("pair", group.alias("g"), "b").agg(
            *[F.sum(F.when(digit == d, F.col("w")).otherwise(0)).alias(f"w{d}") for d in range(base)])
        run = ordered.running(per, ["pair", "g"], ["b"], [
            ordered.Running(f"s{d}", "sum", F.col(f"w{d}"), inclusive=False) for d in range(base)],
            rows_per_range, size, bounds)
        agree, differ = F.lit(0.0), F.lit(0.0)
        for d in range(base):
            less = [F.coalesce(F.col(f"s{e}"), F.lit(0)) for e in range(d)]
            more = [F.coalesce(F.col(f"s{e}"), F.lit(0)) for e in range(d + 1, base)]
            here = F.col(f"w{d}").cast("double")
            if less:
                agree = agree + here * reduce(lambda p, s: p + s, less).cast("double")
            if more:
                differ = differ + here * reduce(lambda p, s: p + s, more).cast("double")
        parts.append(run.groupBy("pair").agg(F.sum(agree - differ).alias("s")))
    score = union_all(parts).groupBy("pair").agg(F.sum("s").alias("s"))

    def ties(side):
        t = F.sum("w").cast("double")
        return cells.groupBy("pair", side).agg((t * (t - 1) / 2).alias("t")).groupBy("pair").agg(F.sum("t").alias(f"t_{side}"))

    n = F.sum("w").cast("double")
    joined = score.join(cells.groupBy("pair").agg((n * (n - 1) / 2).alias("all")), "pair").join(ties("code"), "pair").join(ties("b"), "pair")
    return joined.select("pair", F.try_divide(F.col("s"), F.sqrt(F.col("all") - F.col("t_code")) * F.sqrt(F.col("all") - F.col("t_b"))).alias("r"))


def kendall_pairs(df: DataFrame, columns: list[str], rows_per_range: int = ordered.ROWS_PER_RANGE, digit_bits: int = 3) -> DataFrame:
    """(a, b, r) for all pairs of columns."""
    pairs = list(combinations(columns, 2))
    return _named_pairs(kendall_cells(df, pairs, rows_per_range, digit_bits), pairs)


def correlate(df: DataFrame, columns: list[str] | None = None, method: str = "pearson",
              digits: int = 4) -> DataFrame:
    """Long correlation matrix (a, b, r), symmetric with a unit diagonal where the
    column varies."""
    numeric = numeric_columns(df)
    if columns:
        missing = [c for c in columns if c not in numeric]
        if missing:
            raise QueryError(f"No numeric column of the table: {', '.join(missing)}.")
        numeric = list(columns)
    if len(numeric) < 2:
        raise QueryError("A correlation takes two numeric columns.")
    df = nan_to_null(df.select(*[col(c) for c in numeric]))
    if method == "pearson":
        half = pearson_pairs(df, numeric).select("a", "b", "r")
    elif method in ("spearman", "kendall"):
        half = (spearman_pairs if method == "spearman" else kendall_pairs)(df, numeric)
    else:
        raise QueryError(f"'{method}' is no way to correlate.")
    diagonal = df.agg(*[F.when(F.min(col(c)) < F.max(col(c)), F.lit(1.0)).alias(f"d{i}")
                        for i, c in enumerate(numeric)]).select(F.inline(F.array(*[
                            F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"d{i}").alias("r"))
                            for i, c in enumerate(numeric)])))
    both = half.select(F.inline(F.array(F.struct("a", "b", "r"),
                                        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))))
    return both.unionByName(diagonal).select("a", "b", F.round("r", digits).alias("r"))
