"""Licence statements by ordered signature rules. DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .license_rules import LEVELS, PHRASES, RULES, Rule, worded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASE_SCORE = 0.5
_GROUPS = "array<struct<keyword:string,rules:array<struct<number:int,pattern:string>>>>"


def word_text(text: Column) -> Column:
    """The words with one blank on each side of every word; no words, the empty string."""
    bare = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, "  "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _words_in(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def _grouped(rules: Sequence[Rule]) -> Column:
    """The rules by keyword as one literal; the phrases have the numbers -1, -2, … of their own."""
    groups: dict[str, list] = {}
    for rule in rules:
        groups.setdefault(rule.keyword, []).append({"number": rule.number, "pattern": f" (?:{rule.pattern}) "})
    for k, phrase in enumerate(PHRASES):
        groups.setdefault(worded(phrase), []).append({"number": -1 - k, "pattern": f" {worded(phrase)} "})
    return F.from_json(F.lit(json.dumps([{"keyword": k, "rules": r} for k, r in groups.items()])), _GROUPS)


def rule_hits(text: Column, rules: Sequence[Rule]) -> Column:
    """array<struct<number, gaps, sizes>>: each rule that matches, with the number of words before
    each of its matches (since the one before) and in it. Only rules whose keyword stands in
    the text are tried."""
    likely = F.flatten(F.transform(F.filter(_grouped(rules), lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    matching = F.filter(likely, lambda r: F.rlike(text, r["pattern"]))
    return F.transform(matching, lambda r: F.struct(
        r["number"].alias("number"),
        F.transform(F.split(text, r["pattern"], -1), _words_in).alias("gaps"),
        F.transform(F.regexp_extract_all(text, r["pattern"], F.lit(0)), _words_in).alias("sizes")))


def scanned(docs: DataFrame, doc_id: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """(row, doc_id, n_words, hits) for each row of ``docs``."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), word_text(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("words"))
    return cut_lineage(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", _words_in(F.col("words")).cast("long").alias("n_words"),
                                   rule_hits(F.col("words"), rules).alias("hits")), "licence-hits")


def resolved(made: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, doc_id, rule, label, level, start, end, kept) of ``scanned``: matches by words,
    end exclusive. A match inside another of its own or a higher level is not kept; of equal
    ranges the higher level, then the earlier rule stays. Phrases have level 0 and all stay."""
    hits = made.where(F.size("hits") > 0).select("row", "doc_id", F.explode("hits").alias("h")).select(
        "row", "doc_id", F.col("h.number").alias("rule"), F.posexplode(F.arrays_zip("h.gaps", "h.sizes")).alias("place", "x"))
    # All matches of a row are in one task from here on: no more than the row has words.
    hits = hits.where(F.col("x.sizes").isNotNull()).repartition("row")
    of_rule = Window.partitionBy("row", "rule").orderBy("place")
    upto = F.sum(F.col("x.gaps") + F.col("x.sizes")).over(of_rule).cast("int")
    names = F.create_map(*[F.lit(v) for r in rules for v in (r.number, f"{r.level} {r.label}")],
                         *[F.lit(v) for k, label in enumerate(PHRASES.values()) for v in (-1 - k, f"0 {label}")])
    name = F.get(F.split(names[F.col("rule")], " "), F.lit(1))
    level = F.get(F.split(names[F.col("rule")], " "), F.lit(0)).cast("int")
    placed = hits.select("row", "doc_id", "rule", name.alias("label"), level.alias("level"), (upto - F.col("x.sizes")).alias("start"), upto.alias("end"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("level"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    held = [(F.col("level") == k) & F.coalesce(F.max(F.when(F.col("level") >= k, F.col("end"))).over(before) >= F.col("end"), F.lit(False)) for k in LEVELS]
    inside = held[0]
    for one in held[1:]:
        inside = inside | one
    return placed.withColumn("kept", ~inside)


def licence_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every match of ``docs``: doc_id, rule, label, level, start, end, kept (see ``resolved``). Rows
    without a match, null and empty texts have none; repeated rows have theirs each."""
    return resolved(scanned(docs, doc_id, text, rules), rules).drop("row")


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, rules.

    Words are A-Z lowered runs of letters, digits and non-ASCII characters. n_base counts the
    places of the four given phrases, first_word and last_word are the smallest and largest of
    their first words; base_labels are their labels. labels adds those of the kept matches of
    the rules, and ``rules`` lists these rules' numbers. score is the confidence of the highest level kept.

    Null and empty texts have no words, no labels and score 0. Null or repeated doc_ids do no
    harm, as rows are numbered on their own; repeated rows are scanned each. Other columns are
    ignored. An empty table gives an empty result.
    """
    made = scanned(docs, doc_id, text, rules)
    found = resolved(made, rules)
    phrase = F.col("level") == 0
    confidence = F.create_map(*[F.lit(v) for k, c in {**LEVELS, 0: PHRASE_SCORE}.items() for v in (k, c)])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    per_row = found.where(F.col("kept")).groupBy("row").agg(
        F.count(F.when(phrase, 1)).alias("n_base"), F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        joined(F.collect_set(F.when(phrase, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"),
        F.max(confidence[F.col("level")]).alias("score"), F.array_sort(F.collect_set(F.when(~phrase, F.col("rule")))).alias("rules"))
    return made.drop("hits").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join(F.col("rules").cast("array<string>"), ","), F.lit("")).alias("rules"))
