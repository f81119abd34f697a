"""Time-bucket averages and de-duplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend_stream(events: DataFrame, at: str, value: str, size: str = "1 day", slide: str | None = None,
                 late: str = "2 days", keys: list[str] = ()) -> DataFrame:
    """Mean per window; rows later than ``late`` are dropped and show up in the
    progress of the query. Each row updates partial sums, so a hot window is combined
    before it is shuffled."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return (events.withWatermark(at, late).groupBy(window.alias("w"), *keys)
            .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "n"))


def session_stream(events: DataFrame, at: str, value: str, keys: list[str], gap: str = "1 hour",
                   late: str = "2 days") -> DataFrame:
    """Mean per session of each key; a pause longer than ``gap`` ends a session."""
    return (events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
            .agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "n"))


def dedupe_events(events: DataFrame, at: str, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark's reach."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def idempotent_grants(grants: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """A second grant with the same key is dropped, however late it or the first one comes; a
    grant without a key is always kept. Keys are remembered for good, spread over the
    state store by key, as a credit must never be given twice."""
    return grants.where(F.col(key).isNotNull()).dropDuplicates([key]).union(grants.where(F.col(key).isNull()))
