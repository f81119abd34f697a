"""Line de-duplication over a corpus: equal lines, and lines one word edit apart found by
their deletion neighbourhoods. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import pick

#: What one space stands for: several spaces, or one that is no blank. Line breaks are left alone.
SPACES = "[\\x20\\x09\\x0B-\\x0D]{2,}|[\\x09\\x0B-\\x0D]"
#: A text without any of these has no match of ``SPACES``.
UNEVEN = ("  ", "\t", "\x0b", "\x0c", "\r")


@dataclass(frozen=True)
class LineDedup:
    """Lines of ``min_words`` words or more are compared; shorter ones always stay. Lines of
    ``near_words`` or more also match lines one word insertion, deletion or substitution
    away. ``broadcast_rows``: a list of at most so many lines is sent to all executors,
    a longer one is joined by shuffle, with the same result."""

    min_words: int = 4
    near_words: int = 10
    broadcast_rows: int = 200_000


def spaced(text: Column) -> Column:
    """Lower-case text with one space between the words of a line; a trimmed line of it is its words
    joined by spaces. The pattern is run on the texts that need it only, and no lists of words are made."""
    uneven = reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in UNEVEN])
    return F.when(uneven, F.regexp_replace(F.lower(text), SPACES, " ")).otherwise(F.lower(text))


def _word_count(line: Column) -> Column:
    """Words of a trimmed line of ``spaced`` text."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _place(doc: Column, line: Column) -> Column:
    """One number that sorts like (doc_id, line number) and names the place."""
    return doc.cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(11,0)") + line.cast("decimal(11,0)")


def _halves(line: Column, n: Column) -> Column:
    """Keys of the first and second half, for its own length and for one word less, which is
    three different keys: half the words, rounded down, from either end, and one word more at the
    end of an odd line, one less at the start of an even one. Two lines one edit apart share one,
    as the edit spares a half. The lowest bit of a key is 1 for a first half."""
    half = F.floor(n / 2).cast("int")
    odd = n % 2 == 1

    def key(count: Column, first: Column) -> Column:
        """The first words, or the last ones for a count below 0."""
        words = F.xxhash64(F.call_function("substring_index", line, F.lit(" "), count))
        return words.bitwiseAND(F.lit(-2)).bitwiseOR(first.cast("long"))

    return F.array(key(half, F.lit(1)), key(-half, F.lit(0)),
                   key(F.when(odd, -half - 1).otherwise(half - 1), F.when(odd, 0).otherwise(1)))


def occurrences(docs: DataFrame, p: LineDedup) -> DataFrame:
    """(doc_id, line_no, h1, h2, n, halves) of every line that takes part."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))
    worded = lines.withColumn("line", F.trim("line")).withColumn("n", _word_count(F.col("line")))
    return worded.where(F.col("n") >= p.min_words).select(
        "doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n",
        F.when(F.col("n") >= p.near_words, _halves(F.col("line"), F.col("n"))).alias("halves"))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """(place, n, i, short, whole) of (place, n, low, high, words): for each word i from low up to
    high, and for the first one, the key of the line without it, and the key of the whole line. A key
    is the exclusive or of the hashes of (word, position), so all variants of a line come from
    running totals in one pass."""
    by = Window.partitionBy("place")
    upto = by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = lines.select("place", "n", "low", "high", F.posexplode("words").alias("i", "word")).select(
        "place", "n", "low", "high", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    sums = words.select("place", "n", "low", "high", "i", "here", F.bit_xor("here").over(upto).alias("before"),
                        F.bit_xor("moved").over(upto).alias("moved_upto"),
                        F.bit_xor("moved").over(by).alias("moved_all"), F.bit_xor("here").over(by).alias("whole"))
    after = F.col("moved_all").bitwiseXOR(F.col("moved_upto"))
    sums = sums.where("i = 0 or (i >= low and i < high)")
    return sums.select("place", "n", "i", F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(after).alias("short"), "whole")


def near_lines(lines: DataFrame) -> DataFrame:
    """(place, earlier): for each line of (place, n, low, high, words) that has one, an earlier line
    within one word edit, if the edits lie from low up to high. Lines that share a key are never
    paired with each other: a key holds its smallest place, and every line meets that one only."""
    variants = cut_lineage(neighbourhood(lines), "variants")
    # Substitution: same length, same word left out. All lines of a key are one edit apart.
    same = variants.groupBy("n", "i", "short").agg(F.min("place").alias("earlier"), F.count("*").alias("m")).where("m > 1")
    pairs = variants.join(same.hint("shuffle_hash"), ["n", "i", "short"]).where("earlier < place").select("place", "earlier")
    # Insertion or deletion: the variant of the longer line is the whole shorter line.
    whole = variants.where("i = 0").select("whole", "n", F.col("place").alias("shorter"))
    longer = variants.select(F.col("short").alias("whole"), (F.col("n") - 1).alias("n"), "place")
    first = longer.groupBy("whole", "n").agg(F.min("place").alias("earlier"))
    pairs = pairs.union(longer.join(whole.hint("shuffle_hash"), ["whole", "n"]).where("shorter < place").select("place", F.col("shorter").alias("earlier")))
    pairs = pairs.union(whole.join(first, ["whole", "n"]).where("earlier < shorter").select(F.col("shorter").alias("place"), "earlier"))
    return pairs.distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """Word edit distance of two arrays is at most 1."""
    def agree(x: Column, y: Column) -> Column:
        """Leading words in common."""
        flags = F.zip_with(x, y, lambda s, t: F.coalesce(s == t, F.lit(False)))
        miss = F.array_position(flags, F.lit(False))
        return F.when(miss == 0, F.size(flags)).otherwise(miss - 1)

    lead = agree(a, b)
    trail = agree(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (lead + trail >= F.greatest(F.size(a), F.size(b)) - 1)


def repeated_lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    """(doc_id, line_no, near): lines to remove from (doc_id, text)."""
    occ = cut_lineage(occurrences(docs, p), "lines")
    place = _place(F.col("doc_id"), F.col("line_no"))
    # Lines that share a half with another line are the only ones that can have a neighbour, and
    # the edit is not in the half that they share.
    halves = occ.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("half")
    likely = halves.join(shared.hint("shuffle_hash"), "half").groupBy("h1").agg(
        F.max(F.expr("half & 1")).alias("head"), F.min(F.expr("half & 1")).alias("no_tail"))
    firsts = occ.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.max("n").alias("n"), F.count("*").alias("times"))
    firsts = cut_lineage(firsts, "firsts")
    asked = firsts.where(F.col("n") >= p.near_words).join(likely, "h1").select(
        "place", "n", F.expr("if(no_tail = 0, 0, (n - 1) div 2)").cast("int").alias("low"),
        F.expr("if(head = 1, n, (n + 1) div 2)").cast("int").alias("high"))
    asked = cut_lineage(asked.withColumn("doc_id", F.floor(F.col("place") / 4294967296).cast("long"))
                        .withColumn("line_no", (F.col("place") % 4294967296).cast("int")), "asked")
    # A text is cut once for all its asked lines. Repeated rows of a document hold the same lines, so one of them serves.
    few = asked.limit(p.broadcast_rows + 1).count() <= p.broadcast_rows
    per_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "low", "high", "line_no")).alias("asked"))
    cut = docs.join(F.broadcast(per_doc) if few else per_doc, "doc_id").select(F.split(spaced(F.col("text")), "\n").alias("lines"), "asked")
    texts = cut.select("lines", F.explode("asked").alias("at")).select(
        "at.place", "at.n", "at.low", "at.high", F.trim(F.get("lines", F.col("at.line_no"))).alias("line"))
    texts = texts.where(_word_count(F.col("line")) == F.col("n")).dropDuplicates(["place"])
    texts = cut_lineage(texts.select("place", "n", "low", "high", F.split("line", " ").alias("words")), "texts")
    pairs = near_lines(texts)
    a = texts.select("place", F.col("words").alias("a"))
    b = texts.select(F.col("place").alias("earlier"), F.col("words").alias("b"))
    near = pairs.join(a, "place").join(b, "earlier").where(within_one_edit(F.col("a"), F.col("b"))).select("place").distinct()
    marked = firsts.join(near.withColumn("near", F.lit(True)), "place", "left").where("times > 1 or near")
    found = occ.select("doc_id", "line_no", "h1", "h2").join(
        marked.select("h1", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), ["h1", "h2"])
    return found.where((place != F.col("first")) | F.col("near")).select(
        "doc_id", "line_no", (place == F.col("first")).alias("near"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: LineDedup = LineDedup(),
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_exact, n_near, text, and the columns
    named in ``keep``.

    Lines are cut at \\n and compared as lower-case words. A line goes (n_exact) if an equal
    line stands earlier in the corpus, in the order of doc_id and line number, and it goes
    (n_near) if an earlier line differs by one word insertion, deletion or substitution,
    whether or not that earlier line stays itself. ``text`` holds the lines that stay.

    The edit unit is the word: one deletion variant per word keeps the neighbourhood of a
    line linear in its length. Null text gives null text and no lines; an empty text is one
    line without words, which stays. Rows with a null doc_id have no place in the order: they stay as they are and
    remove nothing. Rows that repeat a doc_id count as one document and are treated alike.
    Other columns are ignored. An empty table gives an empty result.
    """
    base = pick(docs, doc_id=doc_id, text=text)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("rest"))
    gone = repeated_lines(base, params).groupBy("doc_id", "line_no").agg(F.max("near").alias("near"))
    per_doc = gone.groupBy("doc_id").agg(
        F.collect_list("line_no").alias("gone"), F.count_if("near").alias("n_near"), F.count("*").alias("n_gone"))
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return rows.join(per_doc, "doc_id", "left").withColumn("lines", lines).select(
        "doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_gone") - F.col("n_near"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("text"),
        *[F.col("rest")[c].alias(c) for c in keep])
