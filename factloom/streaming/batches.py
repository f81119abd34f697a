"""Running a stream to files, one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, scratch_dir


#: Progress of so many batches is kept by a query, so that late rows can be added up at its end.
PROGRESS_KEPT = 10_000
PROGRESS_OPTION = "spark.sql.streaming.numRecentProgressUpdates"


@dataclass
class Outcome:
    """What a run over everything that had arrived gave: the rows of its output, how many input rows it
    read, and how many were dropped because they came later than the watermark allows."""

    rows: DataFrame
    read: int
    late: int


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append",
                  write: Callable[[DataFrame, int], None] | None = None):
    """Process everything that has arrived and stop. A batch writes its own folder, so a
    batch repeated after a failure replaces itself: exactly once."""
    def save(batch: DataFrame, batch_id: int) -> None:
        if write:
            write(batch, batch_id)
        else:
            batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    stream.sparkSession.conf.set(PROGRESS_OPTION, PROGRESS_KEPT)
    query = (stream.writeStream.foreachBatch(save).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each row of an update-mode result."""
    values = [c for c in results.columns if c not in (*keys, "batch_id")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


def table_stream(spark: SparkSession, sf_dir: str, name: str, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """A given table as a file stream; zone-less times become TIMESTAMP, as watermarks
    need them. ``bytes_per_batch`` bounds a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option(
        "maxBytesPerTrigger", bytes_per_batch).parquet(sf_dir)
    typed = read_table(spark, sf_dir, name).schema
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in typed])


def collected(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over what is there and read its output back."""
    root = scratch_dir(spark, label)
    run_available(stream, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.parquet(f"{root}/out")


def tallied(query) -> tuple[int, int]:
    """(rows read, rows dropped as late) of a query that has ended. Raises when more batches ran than
    their progress was kept for, as the sums would then be wrong."""
    progress = query.recentProgress
    if len(progress) >= PROGRESS_KEPT:
        raise RuntimeError(f"progress of {PROGRESS_KEPT} batches at most is kept; run the backlog in several goes")
    return (sum(p["numInputRows"] for p in progress),
            sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]))


def accounted(spark: SparkSession, goes: list[Callable[[], DataFrame]], label: str, mode: str = "append") -> Outcome:
    """Run a stream again and again over one checkpoint, as its input grows: each of ``goes`` puts its
    share into the source and returns the stream. Late rows are added up over all goes; for a stateful
    operator that sees single rows, read = kept + repeated + late."""
    root = scratch_dir(spark, label)
    read = late = 0
    for stream in goes:
        query = run_available(stream(), f"{root}/out", f"{root}/checkpoint", mode)
        more = tallied(query)
        read, late = read + more[0], late + more[1]
    return Outcome(spark.read.parquet(f"{root}/out"), read, late)
