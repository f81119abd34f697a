"""Benchmark decontamination by greedy string tiling: shared seeds give candidates, tiles of
running Karp-Rabin matches give the share of a benchmark item that a document holds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHashes, in_batches, list_column, pick, signed, slices, small_side, window_hashes, with_key

TOKEN = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Leaks:
    """A match has ``least`` tokens or more; a document is contaminated when its tiles cover
    ``coverage`` of an item. Up to ``seeds`` distinct seeds the seed list is sent to the
    executors (8 bytes each) and documents emit only what is in it; beyond that they emit
    all their seeds for a shuffle join. The results are the same."""

    least: int = 5
    coverage: float = 0.5
    seeds: int = 2_000_000
    broadcast_rows: int = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits: punctuation and spacing do not matter."""
    return [w.encode() for w in TOKEN.findall(text.lower())] if text else []


class Rolled:
    """Karp-Rabin hashes of all windows of a token sequence, for any window size."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.tokens, self.free = hashes, np.ones(n, bool)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
        # prefix[k] = sum of tokens[i] * BASE**i for i < k
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers[:n], dtype=np.uint64)])

    def windows(self, size: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of windows of ``size`` free tokens. ``upto`` aligns the powers."""
        if len(self.tokens) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(taken[size:] == taken[:-size])
        lift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(upto, BASE)]), dtype=np.uint64)
        return starts, (self.prefix[starts + size] - self.prefix[starts]) * lift[upto - starts]


def matches(item: Rolled, doc: Rolled, size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of ``size`` free tokens or more, the longest first."""
    upto = max(len(item.tokens), len(doc.tokens))
    at_item, item_hash = item.windows(size, upto)
    at_doc, doc_hash = doc.windows(size, upto)
    order = np.argsort(item_hash, kind="stable")
    low = np.searchsorted(item_hash[order], doc_hash, "left")
    times = np.searchsorted(item_hash[order], doc_hash, "right") - low
    hits = np.flatnonzero(times)
    if not len(hits):
        return []
    n = times[hits]
    j = np.repeat(at_doc[hits], n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i = at_item[order[np.repeat(low[hits], n) + within]]
    # Pairs that follow each other on a diagonal are one longer match.
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(i))) + size - 1
    return sorted(zip(i[first].tolist(), j[first].tolist(), lengths.tolist()), key=lambda m: (-m[2], m[0], m[1]))


def tiles(item_tokens: np.ndarray, doc_tokens: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (item start, document start, length), marked from the longest match
    down. Equal lengths go by item start, then document start."""
    item, doc = Rolled(item_tokens), Rolled(doc_tokens)
    size, out = len(item_tokens), []
    while size >= least:
        marked = False
        for i, j, n in matches(item, doc, size):
            a, b = slice(i, i + n), slice(j, j + n)
            if item.free[a].all() and doc.free[b].all() and np.array_equal(item_tokens[a], doc_tokens[b]):
                item.free[a] = doc.free[b] = False
                out.append((i, j, n))
                marked = True
            elif marked:
                # What overlaps a tile is cut; the next scan finds what is left of it in order.
                break
        if not marked:
            if size == least:
                break
            size = max(least, size // 2)
    return sorted(out)


def seed_table(items: DataFrame, p: Leaks) -> DataFrame:
    """(item_id, seed, needed) of (item_id, text). A text that covers the item enough shares
    ``needed`` distinct seeds with it: m covered tokens in tiles of ``least`` or more start
    m / least seeds or more, and a seed may stand in the item several times."""
    def run(batches):
        cache = WordHashes()
        for batch in slices(batches, "text"):
            seeds, needed = [], []
            for text in batch.column("text").to_pylist():
                words = cache.array(tokens(text))
                windows = window_hashes(words, p.least) if len(words) >= p.least else words[:0]
                found, times = np.unique(windows, return_counts=True)
                seeds.append(signed(found))
                needed.append(ceil(p.coverage * len(words) / p.least / max(times, default=1) - 1e-9))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), list_column(seeds), pa.array(needed, pa.int64())],
                names=["item_id", "seeds", "needed"])

    return in_batches(items, run, "item_id long, seeds array<long>, needed long").select(
        "item_id", F.explode("seeds").alias("seed"), "needed")


def document_seeds(docs: DataFrame, least: int, wanted) -> DataFrame:
    """(doc_id, k1, k2, seeds) of (doc_id, k1, k2, text): its distinct seeds that are in the
    broadcast array ``wanted``, or all of them if that is None."""
    def run(batches):
        cache = WordHashes()
        known = wanted.value if wanted is not None else None
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                words = cache.array(tokens(text))
                seeds = signed(window_hashes(words, least)) if len(words) >= least else np.zeros(0, np.int64)
                if known is not None and len(seeds):
                    at = np.minimum(np.searchsorted(known, seeds), len(known) - 1) if len(known) else np.zeros(0, int)
                    seeds = seeds[known[at] == seeds] if len(known) else seeds[:0]
                out.append(np.unique(seeds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), list_column(out)],
                names=["doc_id", "k1", "k2", "seeds"])

    return in_batches(docs, run, "doc_id long, k1 long, k2 long, seeds array<long>")


def tiled(pairs: DataFrame, least: int) -> DataFrame:
    """(k1, k2, item_id, covered, n_tokens, tiles) of (k1, k2, item_id, text, item_text)."""
    def run(batches):
        cache = WordHashes()
        for batch in slices(batches, "text"):
            covered, sizes, spans = [], [], []
            last, doc = None, None
            for text, item_text in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist()):
                if text != last or doc is None:
                    last, doc = text, cache.array(tokens(text))
                item = cache.array(tokens(item_text))
                found = tiles(item, doc, least)
                covered.append(sum(n for _, _, n in found))
                sizes.append(len(item))
                spans.append([{"item_start": i, "doc_start": j, "length": n} for i, j, n in found])
            kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("item_id"), pa.array(covered, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(spans, kind)],
                names=["k1", "k2", "item_id", "covered", "n_tokens", "tiles"])

    return in_batches(pairs, run, "k1 long, k2 long, item_id long, covered long, n_tokens long, "
                                 "tiles array<struct<item_start:int,doc_start:int,length:int>>")


def leaked_items(docs: DataFrame, items: DataFrame, p: Leaks) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``docs`` with their text keys, (k1, k2, item_id, covered, n_tokens, tiles)
    of the items that a text covers enough)."""
    spark = docs.sparkSession
    seeds = cut_lineage(seed_table(items, p), "seeds")
    distinct = seeds.select("seed").distinct()
    wanted = None
    if distinct.limit(p.seeds + 1).count() <= p.seeds:
        # At most p.seeds longs: a bounded list.
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in distinct.collect()], np.int64)))
    made = cut_lineage(document_seeds(docs, p.least, wanted), "doc-seeds")
    texts = made.where(F.size("seeds") > 0).groupBy("k1", "k2").agg(F.first("seeds").alias("seeds"))
    hits = texts.select("k1", "k2", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy(
        "k1", "k2", "item_id", "needed").agg(F.count("*").alias("shared"))
    asked = cut_lineage(hits.where("shared >= needed").select("k1", "k2", "item_id").distinct(), "asked")
    wanted_texts = docs.join(small_side(asked.select("k1", "k2").distinct(), p.broadcast_rows), ["k1", "k2"]).select(
        "k1", "k2", "text").dropDuplicates(["k1", "k2"])
    item_texts = items.select("item_id", F.col("text").alias("item_text"))
    pairs = asked.join(wanted_texts, ["k1", "k2"]).join(small_side(item_texts, p.broadcast_rows // 100), "item_id")
    found = tiled(pairs, p.least).where(F.col("covered") >= p.coverage * F.col("n_tokens"))
    return made.drop("seeds"), cut_lineage(found, "leaks")


def leaked_texts(docs: DataFrame, benchmark: DataFrame, params: Leaks = Leaks()) -> DataFrame:
    """(k1, k2) of the texts that ``decontaminate`` finds contaminated."""
    _, found = leaked_items(with_key(pick(docs, doc_id="doc_id", text="text")), pick(benchmark, item_id="item_id", text="text"), params)
    return found.select("k1", "k2").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", params: Leaks = Leaks()) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_id, coverage, tiles.

    Greedy string tiling marks the longest common token runs of a document and a benchmark
    item, without overlap and in any order, down to ``least`` tokens. coverage is the
    marked share of the item. n_items counts the items covered enough; item_id, coverage
    and tiles (token offsets) tell of the one covered most, the smaller item_id on a tie.

    Null and empty texts and texts shorter than a seed are clean. Items with fewer tokens
    than a seed match nothing; a null item_id is kept as it is. Equal texts are tiled once
    and repeated rows are treated alike. Other columns are ignored. An empty table gives an
    empty result, an empty benchmark leaves every document clean.
    """
    rows, found = leaked_items(with_key(pick(docs, doc_id=doc_id, text=text)), pick(benchmark, item_id=item_id, text=item_text), params)
    share = F.col("covered") / F.col("n_tokens")
    best = found.groupBy("k1", "k2").agg(
        F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("n_items"),
        F.min(F.struct((-share).alias("minus"), "item_id", "tiles")).alias("best"))
    return rows.join(best, ["k1", "k2"], "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("best.item_id").alias("item_id"), F.coalesce(-F.col("best.minus"), F.lit(0.0)).alias("coverage"),
        F.col("best.tiles").alias("tiles"))
