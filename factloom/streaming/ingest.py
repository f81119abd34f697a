"""Landed CSV files to a clean Parquet table, with a profile that follows along."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.clean import normalised_text
from ..operators.stats import col, is_numeric, nan_to_null
from ..session import cut_lineage
from ..sources import csv
from ..sources.csv import MISSING_CELLS
from .batches import run_available


def typed_cells(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Clean text cells and give columns their declared type: number, timestamp or text.
    A cell that does not parse becomes null."""
    clean = normalised_text(df.select(*[F.when(~col(c).isin(MISSING_CELLS), col(c)).alias(c) for c in df.columns]))
    to = {"number": text.to_number, "timestamp": text.to_timestamp, "text": lambda c: c}
    return clean.select(*[to[types.get(c, "text")](col(c)).alias(c) for c in df.columns])


FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, landing: str, target: str, checkpoint: str, types: dict[str, str],
                  files_per_batch: int = 100) -> DataFrame:
    """Take in every CSV under ``landing`` that has not been taken yet. Columns are found by the
    name in each file's header, in any order; a declared column that a file lacks is null,
    others are left out. Rows that do not fit their header are kept and counted. Returns
    one row per batch: rows read, rows that did not fit, and filled cells per column."""
    listed = (spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
              .option("maxFilesPerTrigger", files_per_batch).load(landing).select("path"))

    def save(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # at most files_per_batch
        if not paths:
            return
        cells = csv.read_csv(spark, paths)
        bad = F.col(csv.BAD_RECORD).isNotNull() if csv.BAD_RECORD in cells.columns else F.lit(False)
        # The text is parsed once: Spark does not count misfits alone.
        found = cut_lineage(cells.select(*[(col(c) if c in cells.columns else F.lit(None).cast("string")).alias(c) for c in types], bad.alias("_bad")), "cells")
        typed = typed_cells(found.drop("_bad"), types)
        typed.write.mode("overwrite").parquet(f"{target}/data/batch_id={batch_id}")
        done = spark.read.parquet(f"{target}/data/batch_id={batch_id}")
        misfits = found.where("_bad").count()
        done.agg(F.count(F.lit(1)).alias("rows"), F.lit(misfits).cast("long").alias("bad_records"), *[F.count(col(c)).alias(c) for c in types]).write.mode(
            "overwrite").parquet(f"{target}/metrics/batch_id={batch_id}")
        column_state(done).write.mode("overwrite").parquet(f"{target}/profile/batch_id={batch_id}")

    run_available(listed, target, checkpoint, write=save)
    return spark.read.parquet(f"{target}/metrics")


def column_state(df: DataFrame) -> DataFrame:
    """Mergeable state per column: counts, range, sums and a distinct-count sketch of
    fixed size."""
    df = nan_to_null(df)
    structs, aggs = [], [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema):
        c = col(f.name)
        number = c.cast("double") if is_numeric(f) else F.lit(None).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"),
                 F.min(number).alias(f"min{i}"), F.max(number).alias(f"max{i}"), F.avg(number).alias(f"a{i}"),
                 (F.var_pop(number) * F.count(number)).alias(f"m{i}"), F.hll_sketch_agg(c.cast("string")).alias(f"hll{i}")]
        structs.append(F.struct(
            F.lit(f.name).alias("name"), F.lit(i).alias("position"), F.col("rows"), F.col(f"n{i}").alias("n"),
            F.col(f"lo{i}").alias("min_text"), F.col(f"hi{i}").alias("max_text"), F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"), F.col(f"a{i}").alias("mean"), F.col(f"m{i}").alias("m2"), F.col(f"hll{i}").alias("sketch")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def merged_profile(states: DataFrame) -> DataFrame:
    """Profile of everything seen so far from the states of all batches."""
    # Squared distances are taken from the common mean, so large values lose no digits.
    per = Window.partitionBy("name", "position")
    n, mean = F.col("n"), F.try_divide(F.sum(F.col("mean") * F.col("n")).over(per), F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))).over(per))
    moved = states.withColumn("all", mean).withColumn("spread", F.col("m2") + n * (F.col("mean") - F.col("all")) * (F.col("mean") - F.col("all")))
    numeric = F.max("min").isNotNull()
    m = moved.groupBy("name", "position").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.when(numeric, F.min_by("min_text", "min")).otherwise(F.min("min_text")).alias("min_text"),
        F.when(numeric, F.max_by("max_text", "max")).otherwise(F.max("max_text")).alias("max_text"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("all").alias("mean"), F.sum("spread").alias("m2"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_about"))
    return m.select("name", "position", "rows", n, (F.col("rows") - n).alias("nulls"), "min_text", "max_text", "min", "max", "mean",
                    F.sqrt(F.when(n > 1, F.col("m2") / (n - 1))).alias("std"), "distinct_about")


def profile_stream(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Keep a profile of a stream up to date: each batch adds one row of state per column."""
    run_available(stream, target, checkpoint, write=lambda batch, i: column_state(batch).write.mode(
        "overwrite").parquet(f"{target}/batch_id={i}"))
    return merged_profile(stream.sparkSession.read.parquet(target))
