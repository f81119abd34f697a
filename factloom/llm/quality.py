"""Quality rules: base counts per document, and line frequency across the documents of a host."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..session import cut_lineage
from .common import WordHashes, in_batches, list_column, signed, slices, small_side, window_hashes, with_key

BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """A line is above the limit of its host when more than ``share`` of the host's distinct
    documents, and more than ``min_docs`` of them, hold it, or, where ``many`` is set, more than
    ``many`` of them, however large the host is. A document is depleted when
    less than ``keep_share`` of its words are outside such lines. ``broadcast_rows``: a list of at
    most so many texts to change is sent to all executors, a longer one is shuffled."""

    share: float = 0.01
    min_docs: int = 20
    keep_share: float = 0.2
    many: int | None = None
    broadcast_rows: int = 500_000


def repeat_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words covered by windows of ``size`` words that occur more than once."""
    if len(hashes) <= size:
        return 0
    windows = window_hashes(hashes, size)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(line.lower().split()))


def base_counts(docs: DataFrame) -> DataFrame:
    """Counts of (doc_id, host, text, k1, k2), with the hashes and word counts of its distinct
    normalised lines."""
    def run(batches):
        cache = WordHashes()
        for batch in slices(batches, "text"):
            counts, hashes, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                seen, lines, repeats = set(), {}, 0
                for line in raw.split(b"\n"):
                    n = len(line.split())
                    if not n:
                        continue
                    repeats += line in seen
                    seen.add(line)
                    key = line_hash(line)
                    lines[key] = lines.get(key, 0) + n
                blank = len(raw) - len(raw.translate(None, BLANKS))
                counts.append((len(words), len(text or "") - blank, len(raw) - len(raw.translate(None, SYMBOLS)), repeats,
                               repeat_words(cache.array(words))))
                hashes.append(signed(np.fromiter(lines.keys(), np.uint64, len(lines))))
                sizes.append(np.fromiter(lines.values(), np.int64, len(lines)))
            table = np.array(counts, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *[pa.array(table[:, k]) for k in range(5)],
                 batch.column("k1"), batch.column("k2"), list_column(hashes), list_column(sizes)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "k1", "k2",
                       "lines", "line_words"])

    return in_batches(docs, run, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, k1 long, k2 long, lines array<long>, line_words array<long>")


def frequent_lines(lines: DataFrame, sizes: DataFrame, rules: LineRules) -> DataFrame:
    """(host, line, holder): lines above the limit of (host, line, k1, k2, doc_id). Equal texts
    count once. ``holder`` is the smallest doc_id that has the line."""
    once = lines.groupBy("host", "line", "k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    freq = once.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("holder"))
    above = F.col("docs") > rules.share * F.col("host_docs")
    if rules.many is not None:
        above |= F.col("docs") > rules.many
    # min_docs holds for either limit.
    return freq.where(F.col("docs") > rules.min_docs).join(sizes, "host").where(above).select("host", "line", "holder")


def host_name(host: str):
    return F.coalesce(F.concat(F.lit("h:"), F.col(f"`{host}`").cast("string")), F.lit("-")).alias("host")


def found_lines(docs: DataFrame, doc_id: str, host: str, text: str, rules: LineRules) -> tuple[DataFrame, DataFrame]:
    """``base_counts`` of the rows, and (host, k1, k2, line, words) of the frequent lines of
    each text that does not keep them."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), host_name(host))
    made = cut_lineage(base_counts(with_key(base)), "counts")
    lines = made.select("host", "k1", "k2", "doc_id", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(
        "host", "k1", "k2", "doc_id", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    sizes = made.groupBy("host", "k1", "k2").agg(F.count("*").alias("rows")).groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = cut_lineage(frequent_lines(lines, sizes, rules), "frequent")
    texts = lines.groupBy("host", "k1", "k2", "line", "words").agg(F.min("doc_id").alias("doc_id"))
    return made, texts.join(frequent, ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("holder"))).select(
        "host", "k1", "k2", "line", "words")


def verdict(rules: LineRules):
    """(base_failed, boilerplate_words, kept) of n_words, n_repeat_words and lost."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0).cast("long"))
    kept = ~failed & (F.col("n_words") - lost_words >= rules.keep_share * F.col("n_words"))
    return failed.alias("base_failed"), lost_words.alias("boilerplate_words"), kept.alias("kept")


def line_quality(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
                 rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, boilerplate_words, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: fewer than 10 words, or over a fifth of the
    words in repeated five-word windows. boilerplate_words counts the words in lines (lower
    case, white space joined) that too many distinct texts of the host hold; the smallest
    doc_id that has such a line keeps it, and so do its equal texts. A document is kept if
    the base rules hold and ``keep_share`` of its words are outside such lines.

    Null text counts as empty and fails. Rows with a null host share one host of their own.
    Rows with a null doc_id count, but never keep a frequent line. Repeated rows count once.
    Other columns are ignored. An empty table gives an empty result.
    """
    made, hit = found_lines(docs, doc_id, host, text, rules)
    lost = hit.groupBy("host", "k1", "k2").agg(F.sum("words").alias("lost"))
    return made.drop("lines", "line_words").join(lost, ["host", "k1", "k2"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *verdict(rules))


def cut_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, text, removed, rest) of (doc_id, text, gone, rest): the text without the lines
    whose hashes are in ``gone``, and the numbers of these lines."""
    def run(batches):
        for batch in slices(batches, "text"):
            texts, removed = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                if gone:
                    gone = {h & 0xFFFFFFFFFFFFFFFF for h in gone}
                    lines = text.split("\n")
                    out = [k for k, line in enumerate(lines) if line_hash(line.encode()) in gone]
                    drop = set(out)
                    text = "\n".join(line for k, line in enumerate(lines) if k not in drop)
                else:
                    out = []
                texts.append(text)
                removed.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32())), batch.column("rest")],
                names=["doc_id", "text", "removed", "rest"])

    kinds = rows.schema
    return in_batches(rows.select("doc_id", "text", "gone", "rest"), run, StructType(
        [kinds["doc_id"], kinds["text"], StructField("removed", ArrayType(IntegerType())), kinds["rest"]]))


def clean_documents(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
                    rules: LineRules = LineRules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` that ``line_quality`` keeps, each judged by its own host and text,
    also where a doc_id is null or repeated: doc_id, text, removed and the columns named in
    ``keep``. ``text`` is without the lines above the limit of the host, except where the text
    is one that keeps them; ``removed`` has the numbers of the lines taken out, from 0."""
    made, hit = found_lines(docs, doc_id, host, text, rules)
    lost = hit.groupBy("host", "k1", "k2").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))
    counts = made.select("host", "k1", "k2", "n_words", "n_repeat_words").distinct()
    judged = counts.join(lost, ["host", "k1", "k2"], "left").select("host", "k1", "k2", "gone", verdict(rules)[2])
    changed = cut_lineage(judged.where("not kept or gone is not null"), "changed")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), host_name(host),
                       F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("rest"))
    stay = with_key(rows).join(small_side(changed, rules.broadcast_rows), ["host", "k1", "k2"], "left").where(
        F.coalesce("kept", F.lit(True)))
    return cut_lines(stay).select("doc_id", "text", "removed", *[F.col("rest")[c].alias(c) for c in keep])
