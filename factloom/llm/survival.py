"""Filter interaction audit: each document becomes a 32-bit word that tells which subsets of
five filters it survives; positional popcounts of the words answer for every order."""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import in_batches, pick, slices, with_key

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: A task adds up at most so many parts before it passes their counts on.
PARTS = 4096
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
#: WORDS[f] has bit s set when a document that fails the filters in ``f`` survives the filters in ``s``.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)


def text_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, k1, k2, failed) of (doc_id, part, text, k1, k2, raw, chars): a bit for each
    of the filters A to D that the text fails."""
    def run(batches):
        for batch in slices(batches, "raw"):
            failed = np.zeros(batch.num_rows, np.int32)
            for k, (raw, chars) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("chars").to_pylist())):
                words = raw.split()
                capitals = len(raw) - len(raw.translate(None, CAPITALS))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                failed[k] = ((len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
                             | (100 * capitals > 10 * chars) << 2 | (symbols > 0) << 3)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "part", "k1", "k2")], pa.array(failed)],
                names=["doc_id", "part", "k1", "k2", "failed"])

    rows = docs.select("doc_id", "part", "k1", "k2", F.col("text").cast("binary").alias("raw"), F.char_length("text").alias("chars"))
    return in_batches(rows, run, "doc_id long, part string, k1 long, k2 long, failed int")


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set. Carry-save adders turn three words of
    one weight into one of that weight and one of twice the weight, for all 32 positions at once."""
    counts, weight, level = np.zeros(32, np.int64), 0, words
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n:]])
        for word in level.tolist():
            counts += np.array([word >> k & 1 for k in range(32)], np.int64) << weight
        level = np.concatenate(carries) if carries else level[:0]
        weight += 1
    return counts


def counted_words(rows: DataFrame) -> DataFrame:
    """(part, subset, survivors, good, toxic) of (part, failed, good, toxic), one or more rows for each
    part and subset of filters that add up to its survivors."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def passed():
            names = list(sums)
            table = np.stack([sums[n] for n in names])  # part, label, subset
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n in names for _ in range(SUBSETS)], pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(names))),
                 *[pa.array(table[:, k].reshape(-1)) for k in range(3)]],
                names=["part", "subset", "survivors", "good", "toxic"])
            sums.clear()

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code, names = np.asarray(parts.indices), parts.dictionary.to_pylist()
            words = WORDS[np.asarray(batch.column("failed"))]
            marks = [np.ones(len(words), bool), *[np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in ("good", "toxic")]]
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                own = order[edges[k]:edges[k + 1]]
                found = np.stack([positional_popcount(words[own[mark[own]]]) for mark in marks])
                sums[name] = sums[name] + found if name in sums else found
                if len(sums) >= PARTS:
                    yield from passed()
        if sums:
            yield from passed()

    return in_batches(rows.select("part", "failed", "good", "toxic"), run, "part string, subset int, survivors long, good long, toxic long")


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): a repeated doc_id has a label when one of its rows has it."""
    rows = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                      F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, failed, good, toxic), one row per row of ``docs``: the failed filters as bits, A lowest."""
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    made = cut_lineage(text_failures(with_key(base)), "failures")
    # A text's first row has its smallest doc_id: joined by doc_id, so copies of one text spread.
    firsts = made.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeat = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return made.join(firsts, ["doc_id", "k1", "k2"], "left").join(labelled(labels), "doc_id", "left").select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.when(repeat, 1 << 4).otherwise(0)).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def subset_survivors(rows: DataFrame) -> DataFrame:
    """(part, survivors, good, toxic) of ``failures``: per part, arrays of 32 counts by subset of filters."""
    sums = counted_words(rows).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("survivors", "good", "toxic")])
    listed = F.array_sort(F.collect_list(F.struct("subset", "survivors", "good", "toxic")))
    return sums.groupBy("part").agg(listed.alias("x")).select("part", *[F.col(f"x.{c}").alias(c) for c in ("survivors", "good", "toxic")])


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document fails A with under 100 words, B when under 80% of its words are distinct, C when
    over 10% of its characters are A-Z, D with one of ``#$%&*|``, and E when a smaller doc_id has
    the same text. kept counts the documents left after the step, removed those that the step
    takes, redundant those that fail its filter and are gone already, unique_fails those that
    fail this filter alone, good_lost and toxic_lost the removed ones with that label.
    shapley adds up what the filter removes over all orders.

    A null text is empty and a null part the empty string. A row with a null doc_id never fails E, makes no
    other row fail it and has no label. Repeated rows count each; rows with one doc_id and one text do
    not fail E for each other. Other columns are ignored. An empty table has no parts and gives an empty result;
    empty labels lose nothing.
    """
    found = cut_lineage(subset_survivors(failures(docs, labels, doc_id, part, text)), "survivors")
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = found.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def subset(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))

    def left(counts: str, at: Column) -> Column:
        return F.get(F.col(counts), at)

    own, before = subset(F.expr("substring(filter_order, step, 1)")), subset(F.expr("substring(filter_order, 1, step - 1)"))
    after, every, size = before + own, SUBSETS - 1, len(FILTERS)
    # Orders in which exactly the filters of s come before: |s|! (4 - |s|)!
    times = F.array(*[F.lit(factorial(bin(s).count("1")) * factorial(max(size - 1 - bin(s).count("1"), 0))).cast("long") for s in range(SUBSETS)])
    gains = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.when(
        s.bitwiseAND(F.col("own")) == 0, F.get(times, s) * (left("survivors", s) - left("survivors", s + F.col("own")))).otherwise(0))
    removed = left("survivors", F.col("before")) - left("survivors", F.col("after"))
    fails = left("survivors", F.lit(0)) - left("survivors", F.col("own"))
    return steps.withColumns({"own": own, "before": before, "after": after}).select(
        "part", "filter_order", "step", left("survivors", F.col("after")).alias("kept"), removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (left("survivors", F.lit(every) - F.col("own")) - left("survivors", F.lit(every))).alias("unique_fails"),
        (left("good", F.col("before")) - left("good", F.col("after"))).alias("good_lost"),
        (left("toxic", F.col("before")) - left("toxic", F.col("after"))).alias("toxic_lost"),
        F.aggregate(gains, F.lit(0).cast("long"), lambda s, x: s + x).alias("shapley"))
