"""The caller's own pandas function over a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SQL_MAX_ROWS, QueryError
from .sqlguard import SqlResult, limited
from .stats import col

MAX_GROUP_ROWS = 1_000_000

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}

PandasFunction = Callable[[pd.DataFrame], pd.DataFrame]


def apply_pandas(df: DataFrame, fn: PandasFunction, schema: str) -> DataFrame:
    """``fn`` on Arrow batches of rows, for work that looks at one row at a time."""
    def batches(frames):
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)


def apply_pandas_merged(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | dict], schema: str, by: list[str],
                        merge: list[Column]) -> DataFrame:
    """Grouped work on groups of any size: ``fn`` sums up the rows that a key has in one
    Arrow batch, as a frame or as one row in a dict, and ``merge`` combines those partial rows. Rows
    of a key are brought together first, so that ``fn`` is called for a key and not for
    almost every row; Spark splits partitions that large keys would make too big."""
    def batches(frames):
        for frame in frames:
            parts = [fn(rows) for _, rows in frame.groupby(by, sort=False, dropna=False)]
            rows = [p for p in parts if isinstance(p, dict)]
            whole = [p for p in parts if not isinstance(p, dict)]
            if rows:
                yield pd.DataFrame.from_records(rows)
            if whole:
                yield pd.concat(whole)

    together = df.hint("rebalance", *[col(c) for c in by]).sortWithinPartitions(*[col(c) for c in by])
    return together.mapInPandas(batches, schema).groupBy(*by).agg(*merge)


def apply_pandas_whole(df: DataFrame, fn: PandasFunction, schema: str, by: list[str],
                       max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``fn`` on each whole group. A group must fit one task, so the sizes are checked
    first; larger groups need ``apply_pandas_merged``."""
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > max_rows:
        raise QueryError(f"A group has {largest:,} rows; the limit is {max_rows:,}. Use apply_pandas_merged.")
    return df.groupBy(*by).applyInPandas(fn, schema)


def run_user_function(df: DataFrame, fn: PandasFunction, schema: str, max_rows: int = SQL_MAX_ROWS) -> SqlResult:
    """As ``apply_pandas``, with the first ``max_rows`` records brought back."""
    return limited(apply_pandas(df, fn, schema), max_rows)


@dataclass
class UserValues:
    """What a function said: kind is "series" (labels to values) or "value" (one number, or None)."""

    kind: str
    value: dict[str, float] | float | None
    truncated: bool = False


def merged_series(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], merge: str = "sum") -> DataFrame:
    """(label, value): ``fn`` turns a batch of rows into a series, and the values that batches have
    under one label are merged. Labels are text; a null label is kept, a null value says nothing."""
    def batches(frames):
        for frame in frames:
            part = fn(frame)
            labels = [None if pd.isna(k) else str(k) for k in part.index]
            yield pd.DataFrame({"label": labels, "value": pd.to_numeric(part).astype("float64").to_numpy()})

    if merge not in MERGES:
        raise QueryError(f"Partial results are merged by {', '.join(MERGES)}, not by '{merge}'.")
    parts = df.mapInPandas(batches, "label string, value double")
    return parts.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("label").agg(MERGES[merge]("value").alias("value"))


def run_user_series(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], merge: str = "sum", max_rows: int = SQL_MAX_ROWS) -> UserValues:
    """A series as labels to values: the first ``max_rows`` labels in their order, and whether there were more."""
    rows = merged_series(df, fn, merge).orderBy(F.asc_nulls_last("label")).limit(max_rows + 1).collect()
    return UserValues("series", {r.label: r.value for r in rows[:max_rows]}, len(rows) > max_rows)


def run_user_value(df: DataFrame, fn: Callable[[pd.DataFrame], float | None], merge: str = "sum") -> UserValues:
    """One number: ``fn`` gives it for a batch of rows, and Spark merges those of all batches. None where
    no batch had one."""
    whole = merged_series(df, lambda frame: pd.Series([fn(frame)], index=["all"], dtype="float64"), merge)
    found = whole.first()
    return UserValues("value", found.value if found else None)
