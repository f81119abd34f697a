"""Ranked lexical search: an index of compressed posting lists in document shards, and the best
documents of each query by Block-Max MaxScore."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import in_batches, pick, slices

#: ASCII letters are lowered; ASCII characters that are no letter or digit part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LAST = np.iinfo(np.int64).max
POSTINGS = ("shard long, term string, block int, size int, last int, top_tf array<int>, top_n array<int>, data binary, "
            "doc_ids array<long>, lengths array<int>")


@dataclass(frozen=True)
class Search:
    """The ``top`` best documents of each query. A shard of the index has up to ``shard_postings``
    postings (one document may exceed it), in blocks of ``block``; it is searched in windows of
    ``window`` documents. Queries are sent to the executors in blocks of up to ``query_terms`` (query, term)
    pairs. Shard heaps are merged in ``merges`` groups first."""

    top: int = 10
    block: int = 128
    window: int = 2048
    shard_postings: int = 2_000_000
    query_terms: int = 1_000_000
    merges: int = 64


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight earns, in 64-bit integers."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factor(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * lengths.astype(np.int64) * n_docs) // n_terms


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their number for each value): seven bits a byte, the lowest first, the top bit on
    all but the last."""
    sizes = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        out[starts[has] + k] = (values[has] >> (7 * k) & 0x7F) | np.where(sizes[has] > k + 1, 0x80, 0)
    return out, sizes


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), starts)


class Shard:
    """Documents of one shard while it is built."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.lengths, self.term, self.tf, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        counts = Counter(found)
        numbers = self.numbers
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.term.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.size += len(counts)

    def rows(self, number: int, block: int) -> Iterator[pa.RecordBatch]:
        """One row with the documents, then one per block of a posting list. A block holds the gaps
        between its documents and their tf, and the (tf, length) pairs that no other pair of
        the block beats in both: whatever the corpus averages turn out to be, one of them has its
        highest impact."""
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("size", pa.int32()), ("last", pa.int32()),
                            ("top_tf", pa.list_(pa.int32())), ("top_n", pa.list_(pa.int32())), ("data", pa.binary()),
                            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_pylist([{"shard": number, "doc_ids": self.ids, "lengths": self.lengths}], schema)
        if not self.size:
            return
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.term])
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        length = np.array(self.lengths, np.int32)[doc]
        place = np.arange(len(term))
        first_of_term = np.searchsorted(term, np.arange(len(self.numbers)))
        within = place - first_of_term[term]
        starts = np.flatnonzero(within % block == 0)
        ends = np.append(starts[1:], len(term))
        gaps = doc.astype(np.int64)
        gaps[1:] -= np.where(within[1:] % block == 0, 0, doc[:-1])
        pairs = np.empty(2 * len(term), np.int64)
        pairs[0::2], pairs[1::2] = gaps, tf
        data, sizes = packed(pairs)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[2 * np.append(starts, len(term))]
        # The shortest documents first; a pair stays when its tf exceeds those of all shorter ones.
        of_block = np.repeat(np.arange(len(starts)), ends - starts)
        by = np.lexsort((-tf, length, of_block))
        key = of_block[by].astype(np.int64) << 32 | tf[by]
        best = np.maximum.accumulate(key)
        stays = np.ones(len(by), bool)
        stays[1:] = key[1:] > best[:-1]
        chosen = by[stays]
        tops = np.searchsorted(of_block[chosen], np.arange(len(starts) + 1)).astype(np.int32)
        names = list(self.numbers)
        for at in range(0, len(starts), 50_000):
            to = min(at + 50_000, len(starts))
            offsets = pa.array(tops[at:to + 1] - tops[at])
            part = chosen[tops[at]:tops[to]]
            count = to - at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, number, np.int64)),
                 pa.array([names[k].decode("utf-8", "replace") for k in term[starts[at:to]]], pa.string()),
                 pa.array((within[starts[at:to]] // block).astype(np.int32)), pa.array((ends - starts)[at:to].astype(np.int32)),
                 pa.array(doc[ends[at:to] - 1]), pa.ListArray.from_arrays(offsets, pa.array(tf[part])),
                 pa.ListArray.from_arrays(offsets, pa.array(length[part])),
                 pa.array([data[a:b].tobytes() for a, b in zip(cuts[at:to], cuts[at + 1:to + 1])], pa.binary()),
                 pa.nulls(count, schema.field("doc_ids").type), pa.nulls(count, schema.field("lengths").type)], schema=schema)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Search = Search()) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder. Rows with ``doc_ids`` describe
    the documents of a shard, all others are blocks of posting lists. A shard never leaves its task,
    so nothing is shuffled, and memory is bounded by the size of a shard."""
    p = params

    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 24
        shard = Shard()
        for batch in slices(batches, "text", 1 << 20):
            for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                shard.add(key, terms(raw))
                if shard.size >= p.shard_postings:
                    yield from shard.rows(number, p.block)
                    number, shard = number + 1, Shard()
        if shard.ids:
            yield from shard.rows(number, p.block)

    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cut_lineage(in_batches(rows, run, POSTINGS), "index")


class Postings:
    """One term's list within a shard. Blocks are unpacked when first needed, and kept."""

    def __init__(self, rows: list[dict], factors: np.ndarray, n_docs: int, n_terms: int) -> None:
        rows.sort(key=lambda r: r["block"])
        self.last = np.array([r["last"] for r in rows])
        self.bounds = np.array([int(impact(np.array(r["top_tf"]), length_factor(np.array(r["top_n"]), n_docs, n_terms)).max()) for r in rows], np.int64)
        self.bound = int(self.bounds.max())
        self._data, self._factors, self._open = [r["data"] for r in rows], factors, {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            values = unpacked(self._data[k])
            docs = np.cumsum(values[0::2])
            self._open[k] = docs, impact(values[1::2], self._factors[docs])
        return self._open[k]

    def between(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, impacts) from ``low`` to before ``high``, block by block."""
        k = int(np.searchsorted(self.last, low))
        while k < len(self.last) and (k == 0 or self.last[k - 1] < high - 1):
            docs, gain = self.block(k)
            a, b = np.searchsorted(docs, [low, high])
            if a < b:
                yield docs[a:b], gain[a:b]
            k += 1


def best_of_shard(lists: list[tuple[int, Postings]], ids: np.ndarray, p: Search) -> tuple[np.ndarray, np.ndarray]:
    """(scores, documents) of the ``top`` best of a shard, from its weighted lists.

    Lists are in order of their highest scores. Those whose highest scores together stay under
    the worst of the best so far are non-essential: a document that is in no other list cannot
    get in. Candidates come from the essential lists. Each non-essential list, the strongest
    first, is looked up only for candidates that the highest score of the block they
    fall into, and those of the weaker lists, could still bring in.
    """
    lists = sorted(lists, key=lambda x: x[0] * x[1].bound)
    upto = np.cumsum([w * q.bound for w, q in lists])
    best, docs, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, len(ids), p.window):
        high = min(low + p.window, len(ids))
        # upto < least: nothing of these lists alone gets in, not even with an equal score.
        first = int(np.searchsorted(upto, least, "left"))
        if first == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for weight, postings in lists[first:]:
            for found, gain in postings.between(low, high):
                sums[found - low] += weight * gain
        asked = np.flatnonzero(sums)
        for k in range(first - 1, -1, -1):
            weight, postings = lists[k]
            asked = asked[sums[asked] + upto[k] >= least]
            block = np.searchsorted(postings.last, asked + low)
            inside = block < len(postings.last)
            rest = int(upto[k - 1]) if k else 0
            most = np.where(inside, weight * postings.bounds[np.minimum(block, len(postings.last) - 1)], 0) + rest
            could = sums[asked] + most >= least
            asked, block, inside = asked[could], block[could], inside[could]
            for number in np.unique(block[inside]).tolist():
                own = asked[inside & (block == number)]
                found, gain = postings.block(number)
                at = np.minimum(np.searchsorted(found, own + low), len(found) - 1)
                hit = found[at] == own + low
                sums[own[hit]] += weight * gain[at[hit]]
        asked = asked[sums[asked] >= least]
        best, docs = np.concatenate([best, sums[asked]]), np.concatenate([docs, asked + low])
        order = np.lexsort((ids[docs], -best))[:p.top]
        best, docs = best[order], docs[order]
        if len(best) == p.top:
            least = max(int(best[-1]), 1)
    return best, docs


def shard_heaps(index: DataFrame, known: DataFrame, queries: dict[int | None, list[tuple[str, int]]], n_docs: int, n_terms: int,
                p: Search) -> DataFrame:
    """(item_id, shard, doc_id, score) of each shard's best documents for the weighted terms of each
    query. ``known`` has the terms of all queries."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list[dict]] = {}
        for row in left.to_pylist():
            rows.setdefault(row["term"], []).append(row)
        items, found, scores = [], [], []
        for about in right.to_pylist() if rows else []:
            ids = np.array([LAST if x is None else x for x in about["doc_ids"]], np.int64)
            factors = length_factor(np.array(about["lengths"]), n_docs, n_terms)
            opened = {t: Postings(r, factors, n_docs, n_terms) for t, r in rows.items()}
            for item, wanted in sent.value.items():
                lists = [(w, opened[t]) for t, w in wanted if t in opened]
                best, docs = best_of_shard(lists, ids, p) if lists else ([], [])
                items += [item] * len(docs)
                found += [about["doc_ids"][d] for d in docs]
                scores += list(best)
        return pa.table({"item_id": pa.array(items, pa.int64()), "shard": pa.array([key[0].as_py()] * len(items), pa.int64()),
                         "doc_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    blocks = index.where("term is not null").join(known, "term", "left_semi").select("shard", "term", "block", "last", "top_tf", "top_n", "data")
    about = index.where("term is null").select(F.col("shard").alias("of"), "doc_ids", "lengths")
    return blocks.groupBy("shard").cogroup(about.groupBy("of")).applyInArrow(run, "item_id long, shard long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of (item_id, text); rows of one item_id are one query."""
    def run(batches):
        for batch in batches:
            found = [Counter(terms(raw)) for raw in batch.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at)), pa.array([t.decode() for c in found for t in c], pa.string()),
                 pa.array([n for c in found for n in c.values()], pa.int64())], names=["item_id", "term", "times"])

    return in_batches(items, run, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def query_blocks(weighted: DataFrame, most: int) -> Iterator[dict[int | None, list[tuple[str, int]]]]:
    """The queries with their (term, weight) lists, in as few blocks of at most ``most`` pairs as hashing makes;
    a block with more has one query."""
    parts, number = 1, F.xxhash64("item_id")
    while True:
        sized = weighted.groupBy(F.pmod(number, F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.count_distinct(number).alias("items"))
        if sized.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            break
        parts *= 2
    for part in range(parts):
        block: dict[int | None, list[tuple[str, int]]] = {}
        for row in weighted.where(F.pmod(number, F.lit(parts)) == part).collect():
            block.setdefault(row.item_id, []).append((row.term, row.weight))
        if block:
            yield block


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", params: Search = Search()) -> DataFrame:
    """The ``top`` best rows of ``docs`` for each item: item_id, rank, doc_id, score.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document earns for each
    occurrence of the term in the item its weight times (10^9 tf) div (1000 tf + 8 m),
    m = 25 + (75 n N) div L. N counts documents with a term, L all terms, n those of the
    document. Only scores above 0 count; equal scores go by ascending doc_id, a null one last.

    Null and empty texts have no terms: such documents are never found, such items have no
    rows. Rows of one item_id (or without one) are one item. Each row of ``docs`` is a document of its own, so
    repeated rows take a rank each. Other columns are ignored. Empty tables give an empty result.
    """
    p = params
    index = build_index(docs, doc_id, text, p)
    totals = index.where("term is null").select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("docs"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("terms")).agg(
        F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    rows = pick(items, item_id=item_id, text=item_text)
    asked = cut_lineage(item_terms(rows.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))), "asked")
    known = index.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * totals.docs + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighted = cut_lineage(asked.join(known, "term").select("item_id", "term", weight.cast("long").alias("weight")), "weighted")
    heaps = None
    for block in query_blocks(weighted, p.query_terms):
        found = shard_heaps(index, weighted.select("term").distinct(), block, totals.docs, totals.terms, p)
        heaps = found if heaps is None else heaps.union(found)
    if heaps is None:
        heaps = weighted.select("item_id", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("doc_id"), F.col("weight").alias("score")).limit(0)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = Window.partitionBy("item_id", F.pmod(F.xxhash64("shard"), F.lit(p.merges))).orderBy(*order)
    every = Window.partitionBy("item_id").orderBy(*order)
    merged = heaps.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= p.top)
    return merged.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= p.top).select("item_id", "rank", "doc_id", "score")
