"""Files to tables: names, clustering by schema, stacking, cleaning, profiling."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import STACK_OVERLAP
from ..operators import clean, ordered, profile
from ..operators.stats import col
from . import csv

log = logging.getLogger(__name__)
NAME_LENGTH = 63


class TooManyTables(ValueError):
    """The files form more distinct tables than a dataset may have."""


# -- names -----------------------------------------------------------------------

def base_name(path: str) -> str:
    """Folder and file name folded into one SQL-safe name."""
    stem = re.sub(r"\.[^./]*$", "", path.replace("\\", "/"))
    name = re.sub(r"[^a-z0-9]+", "_", stem.lower()).strip("_")[:NAME_LENGTH] or "table"
    return f"t_{name}" if name[0].isdigit() else name


def table_names(paths: Iterable[str]) -> list[str]:
    """Unique names in path order; a clash gets _2, _3, …, skipping names in use."""
    taken: set[str] = set()
    out = []
    for path in paths:
        base = name = base_name(path)
        k = 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        out.append(name)
    return out


def base_name_expr(path: Column) -> Column:
    stem = F.lower(F.regexp_replace(path, r"\.[^./]*$", ""))
    name = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    name = F.substring(name, 1, NAME_LENGTH)
    name = F.when(F.length(name) > 0, name).otherwise(F.lit("table"))
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("t_"), name)).otherwise(name)


def named(files: DataFrame, path: str, order: str) -> DataFrame:
    """Adds ``table_name`` to a list of files: the k-th file of a base name gets _k. Where that
    is the base name of another file, numbers of that base name come after a second "_",
    so no two files share a name."""
    based = files.withColumn("_base", base_name_expr(col(path)))
    counted = ordered.numbered(based, ["_base"], [order], "_k")
    number = F.when(F.col("_k") > 1, F.col("_k").cast("string"))
    plain = F.concat_ws("_", "_base", number)
    bases = based.select(F.col("_base").alias("_taken")).distinct()
    met = counted.withColumn("_plain", plain).join(bases, (F.col("_plain") == F.col("_taken")) & (F.col("_k") > 1), "left")
    clash = met.groupBy("_base").agg(F.count("_taken").alias("_clashes"))
    safe = F.when((F.col("_clashes") > 0) & (F.col("_k") > 1), F.concat(F.col("_base"), F.lit("__"), number)).otherwise(F.col("_plain"))
    return ordered.join_keys(met, clash, ["_base"]).withColumn("table_name", safe).drop("_base", "_k", "_plain", "_taken", "_clashes")


# -- clustering --------------------------------------------------------------------

@dataclass
class Cluster:
    columns: set[str]
    files: list[str] = field(default_factory=list)


def cluster_by_schema(headers: dict[str, list[str]], overlap: float = STACK_OVERLAP) -> list[Cluster]:
    """Files in order; each joins the first cluster whose columns overlap enough. Works
    on header names only."""
    out: list[Cluster] = []
    for path, header in headers.items():
        cols = set(header)
        home = next((c for c in out if cols | c.columns
                     and len(cols & c.columns) / len(cols | c.columns) >= overlap), None)
        if home is None:
            home = Cluster(set())
            out.append(home)
        home.columns |= cols
        home.files.append(path)
    return out


def stack_tables(spark: SparkSession, cluster: Cluster, headers: dict[str, list[str]]) -> DataFrame:
    """One table from the files of a cluster: union of columns, missing ones null."""
    return csv.read_csv(spark, cluster.files, {p: headers[p] for p in cluster.files})


# -- the whole batch -----------------------------------------------------------------

@dataclass
class Table:
    name: str
    filename: str
    path: str
    row_count: int
    col_count: int
    profile: DataFrame


def ingest_tables(spark: SparkSession, files: list[tuple[str, str]], target: str,
                  max_tables: int | None = None) -> tuple[list[Table], DataFrame, bool]:
    """(display name, path) pairs to cleaned Parquet tables under ``target``. Returns
    the tables, the change log and whether every table could be cleaned."""
    display = {path: name for name, path in files}
    headers = csv.read_headers(spark, [p for _, p in files])
    clusters = cluster_by_schema(headers)
    if max_tables is not None and len(clusters) > max_tables:
        raise TooManyTables(f"The files have {len(clusters)} different sets of columns, and {max_tables} tables are allowed.")
    names = table_names(display[c.files[0]] for c in clusters)

    def build(i: int, cluster: Cluster, name: str):
        folder = "data" if len(clusters) == 1 else f"table__{i}__{name}"
        staged, final = f"{target}/_staged/{folder}.parquet", f"{target}/{folder}.parquet"
        # The text is parsed once; typing, rates and cleaning then read Parquet columns.
        stack_tables(spark, cluster, headers).write.parquet(staged)
        cells = spark.read.parquet(staged)
        bad = cells.where(F.col(csv.BAD_RECORD).isNotNull()).count()
        typed = csv.infer_types(cells.drop(csv.BAD_RECORD))
        log_rows, ok = ([(name, "bad_records", [], bad)] if bad else []), True
        try:
            rows, cols, profiled, changes = clean.clean_into(typed, final)
            log_rows += [(name, r["code"], r["columns"], r["n"]) for r in changes.collect()]
        except Exception:  # cleaning is best effort: the raw table stays usable
            log.warning("cleaning of %s failed; the raw table is kept", name, exc_info=True)
            ok, final = False, f"{target}/{folder}_raw.parquet"
            typed.write.parquet(final)
            kept = spark.read.parquet(final)
            rows, cols, profiled = kept.count(), len(kept.columns), profile.profile(kept)
        first = display[cluster.files[0]]
        filename = first if len(cluster.files) == 1 else f"{first} +{len(cluster.files) - 1} more"
        return Table(name, filename, final, rows, cols, profiled), log_rows, ok

    # Tables do not depend on each other; small ones fill the gaps large ones leave.
    with ThreadPoolExecutor(4) as pool:
        built = list(pool.map(build, range(len(clusters)), clusters, names))
    changes = spark.createDataFrame([r for _, rows, _ in built for r in rows],
                                    "table string, code string, columns array<string>, n bigint")
    return [t for t, _, _ in built], changes, all(ok for _, _, ok in built)


def dataset_summary(spark: SparkSession, tables: list[Table], files: int) -> DataFrame:
    """Files in, tables out, rows, columns and Parquet bytes of one dataset."""
    rows = sum(t.row_count for t in tables)
    cols = sum(t.col_count for t in tables)
    sizes = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", True).load([t.path for t in tables]).select("length"))
    return sizes.agg(F.lit(files).cast("bigint").alias("files"), F.lit(len(tables)).cast("bigint").alias("tables"),
                     F.lit(rows).cast("bigint").alias("rows"), F.lit(cols).cast("bigint").alias("columns"),
                     F.sum("length").alias("bytes"))


def records_sink(df: DataFrame) -> DataFrame:
    """One JSON record per row: missing values as null, ISO times."""
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns]), {
        "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS", "dateFormat": "yyyy-MM-dd"}).alias("record"))
