"""Sharding by sampled splitters: ranges of (text key, doc_id) from a size-weighted sample,
exact sizes per range, and shards of near equal bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


@dataclass(frozen=True)
class Ranges:
    """Each range should hold about ``rows`` rows; there are ``least`` ranges at least. Ranges with
    ``overfull`` times the mean bytes or rows are subdivided, in ``rounds`` rounds at most
    (only repeats of one row can stay together). ``sample`` keys are drawn for a splitter. Groups of equal texts up
    to 1 / ``snap`` of a shard stay in one shard."""

    rows: int = 500_000
    least: int = 192
    sample: int = 16
    overfull: float = 3.0
    rounds: int = 4
    snap: int = 50


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, size, text_crc32). The key is 60 bits of the text's MD5; null has key -1."""
    t = F.col(f"`{text}`")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1)).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))


def draw(rows: DataFrame, count: int, total: int) -> pd.DataFrame:
    """``count`` keys drawn without replacement, in proportion to size: the smallest of
    -ln(u) / size with u from a hash of the row. The count bounds what reaches the driver. ``total``
    bytes have about twice ``count`` rows under a time of 2 count / total, so only those are put in
    order; all of them where that was too few."""
    u = (F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(11)), 11).cast("double") + 1) / float(1 << 53)
    timed = rows.select("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), (-F.log(u) / F.col("size")).alias("race"))
    first = lambda some: some.orderBy("race").limit(count).select("key", "doc_id").toPandas()
    found = first(timed.where(F.col("race") <= 2 * count / max(total, 1)))
    if len(found) < count:
        found = first(timed)
    return found.sort_values(["key", "doc_id"], ignore_index=True)


def placed(rows: DataFrame, keys: np.ndarray, ids: np.ndarray) -> DataFrame:
    """``rows`` with ``range``: the number of splitters (key, id) at or before (key, doc_id)."""
    @F.pandas_udf("int")
    def locate(key: pd.Series, doc_id: pd.Series) -> pd.Series:
        k, d = key.to_numpy(), doc_id.to_numpy()
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        # Splitters with the row's own key are told apart by doc_id.
        for at in np.unique(low[high > low]):
            mine = (low == at) & (high > low)
            end = high[mine][0]
            low[mine] = at + np.searchsorted(ids[at:end], d[mine], "right")
        return pd.Series(low.astype(np.int32))

    return rows.withColumn("range", locate("key", F.coalesce("doc_id", F.lit(-(1 << 63)))))


def splitters(drawn: pd.DataFrame, count: int) -> pd.DataFrame:
    """``count`` quantiles of the drawn keys."""
    if not len(drawn) or count < 1:
        return drawn.iloc[:0]
    return drawn.iloc[np.unique(np.linspace(0, len(drawn) - 1, count + 2)[1:-1].astype(int))]


def without_cuts(cuts: pd.DataFrame, rows: DataFrame, limit: float) -> pd.DataFrame:
    """Splitters inside a group of equal keys stay only where the group is over ``limit`` bytes;
    others move to the start of the group. Only keys of splitters are looked up."""
    asked = rows.sparkSession.createDataFrame(pd.DataFrame({"key": cuts["key"].unique()}).astype("int64"), "key long")
    sizes = {r[0]: r[1] for r in rows.join(F.broadcast(asked), "key").groupBy("key").agg(F.sum("size")).collect()}
    low = np.where(cuts["key"].map(lambda k: sizes.get(k, 0) > limit), cuts["doc_id"], -(1 << 63))
    return cuts.assign(doc_id=low.astype(np.int64)).drop_duplicates().sort_values(["key", "doc_id"], ignore_index=True)


def ranged(rows: DataFrame, total: int, count: int, shards: int, p: Ranges) -> tuple[DataFrame, list[int]]:
    """``rows`` with ``range``, numbered in the order of (key, doc_id), and the keys of the groups
    that were cut. A cut group is over 1 / (shards * snap) of all bytes, so there are few."""
    n = max(p.least, -(-count // p.rows))
    limit = total / shards / p.snap
    cuts = without_cuts(splitters(draw(rows, n * p.sample, total), n - 1), rows, limit)
    for _ in range(p.rounds):
        out = placed(rows, cuts["key"].to_numpy(), cuts["doc_id"].to_numpy())
        full = out.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(
            (F.col("bytes") > p.overfull * total / n) | (F.col("n") > p.overfull * max(p.rows, count / n)))
        full = {r[0]: r[1] for r in full.select("range", "bytes").collect()}
        if not full:
            break
        more = draw(out.where(F.col("range").isin(list(full))), len(full) * p.sample * p.sample, sum(full.values()))
        finer = pd.concat([cuts, splitters(more, len(full) * p.sample)]).drop_duplicates()
        finer = without_cuts(finer, rows, limit)
        if len(finer) == len(cuts):
            break
        cuts = finer
    spread = cuts["key"][cuts["doc_id"] > -(1 << 63)].unique().tolist()
    return placed(rows, cuts["key"].to_numpy(), cuts["doc_id"].to_numpy()), spread


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", params: Ranges = Ranges()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Rows are put in the order of (text key, doc_id). A row goes to the shard in which the
    middle of its bytes falls when the total is cut in ``shards`` equal parts, so shards differ
    by about one document. Equal texts are neighbours: a group of up to 1 / 50 of a shard is placed
    as a whole by its own middle, a larger one is spread. Slots number a shard's rows from 0.

    Only sampled keys and one row per range reach the driver; ranges are tasks of bounded size.
    Null text has 8 bytes and the smallest key, as a group; a null doc_id sorts first. Equal repeated rows
    get slots in any order among themselves. Other columns are ignored. An empty table gives an empty result.
    """
    p = params
    rows = cut_lineage(keyed(docs, doc_id, text), "keyed")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out, spread = ranged(rows, total, count, shards, p)
    out = cut_lineage(out.withColumn("spread", F.col("key").isin(spread)), "ranged")
    # One row per range.
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rows_before"))
    order = Window.partitionBy("range").orderBy("key", "doc_id")
    group = Window.partitionBy("range", "key")
    measured = out.select(
        "*", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(order).alias("nth"),
        F.sum("size").over(group).alias("group_bytes")).withColumn("group_end", F.max("upto").over(group))
    measured = measured.join(offsets, "range")
    # Twice the middle, in bytes from the start of all rows.
    own = 2 * F.col("upto") - F.col("size")
    whole = 2 * F.col("group_end") - F.col("group_bytes")
    middle = 2 * F.col("bytes_before") + F.when(~F.col("spread") & (F.col("group_bytes") * shards * p.snap <= total), whole).otherwise(own)
    shard = F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(20,0)"))
    done = cut_lineage(measured.select(
        "doc_id", "size", "text_crc32", F.least(shard.cast("int"), F.lit(shards - 1)).alias("shard"),
        (F.col("rows_before") + F.col("nth")).alias("rank")), "shards")
    first = done.groupBy("shard").agg(F.min("rank").alias("first"))
    # At most ``shards`` rows.
    return done.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placement: DataFrame, path: str, doc_id: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` in folders ``shard=k``, with each row's slot. A shard is dealt to several
    tasks by slot, so no task holds a whole shard. doc_id must name a row."""
    slots = placement.select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.join(slots, F.col(f"`{doc_id}`") == F.col("_id")).drop("_id")
    part = F.floor(F.col("slot") / rows_per_file)
    rows.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
