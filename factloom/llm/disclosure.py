"""Personal data by patterns, and terms that give protected entities away by their
co-occurrence in the corpus. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_side

KINDS = ["email", "ip", "card", "phone"]
# The given patterns. Quantifiers are possessive where nothing could be given back, and a run
# is entered at its start or where the last match ended: the same matches in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
TERM = r"\p{L}{4,}"


@dataclass(frozen=True)
class Disclosure:
    """Terms within ``reach`` characters of an entity are weighed. A term discloses an entity
    when at least ``contexts`` different surroundings show them together and the term tells
    ``generalise`` of the entity's information content; from ``remove`` on it is removed.
    Up to ``broadcast_terms`` terms under suspicion are sent to all executors, more are shuffled."""

    reach: int = 60
    contexts: int = 3
    generalise: float = 0.8
    remove: float = 0.95
    broadcast_terms: int = 200_000


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches, in code points."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.filter(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    marks = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(marks, F.lit(0), lambda s, x: s + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.char_length(digits)
    if kind == "card":
        return F.when((size >= 16) & (size <= 19), _luhn(digits)).otherwise(False)
    return (size >= 8) & (size <= 15)


def _named(text: Column, number: int, kind: str) -> Column:
    spans = F.filter(_placed(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    return F.transform(spans, lambda s: F.struct(
        F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of emails, IP addresses, card and phone numbers,
    by kind, then start."""
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")),
              "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(F.when(likely[kind], _named(text, k, kind)).otherwise(none))
    return F.concat(*parts)


def near_terms(text: Column, spans: Column, reach: int) -> Column:
    """array<struct<entity, context, term, start, end>>: words of four letters or more around
    each span. Words cut by the edge of the surroundings or inside a span are left out."""
    size = F.char_length(text)

    def around(s: Column) -> Column:
        entity = F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))
        first = F.greatest(s["start"] - reach, F.lit(0))
        last = F.least(s["end"] + reach, size)
        before, after = F.substring(text, first + 1, s["start"] - first), F.substring(text, s["end"] + 1, last - s["end"])
        context = F.xxhash64(before, after)

        def terms(part: Column, at: Column) -> Column:
            return F.transform(_placed(part, TERM), lambda t: F.struct(
                entity.alias("entity"), context.alias("context"), F.lower(t["value"]).alias("term"),
                (at + t["start"]).alias("start"), (at + t["end"]).alias("end")))

        both = F.concat(terms(before, first), terms(after, s["end"]))
        return F.filter(both, lambda t: ((t["start"] > first) | (first == 0)) & ((t["end"] < last) | (last == size)) & ~F.exists(
            spans, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))

    return F.array_distinct(F.flatten(F.transform(spans, around)))


def disclosing(pairs: DataFrame, texts: DataFrame, total: int, p: Disclosure) -> DataFrame:
    """(entity, term, share, action) of (row, entity, term, context). share is the pointwise
    mutual information of term and entity over the entity's information content: 1 when the
    term occurs with the entity only, 0 when they are independent."""
    counted = pairs.groupBy("entity", "term", "row").agg(F.min("context").alias("low"), F.max("context").alias("high"))
    together = counted.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    shown = pairs.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("shown")).where(
        F.col("shown") >= p.contexts)
    suspects = cut_lineage(together.join(shown, ["entity", "term"]), "suspects")
    names = suspects.select("term").distinct()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # Counted before the join: a task passes on each of its words once.
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(small_side(names, p.broadcast_terms), "term")
    n_entity = pairs.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    content = -F.log2(F.col("n_entity") / total)
    share = 1 + F.log2(F.col("n_both") / F.col("n_term")) / content
    return suspects.join(n_term, "term").join(n_entity, "entity").where(F.col("n_entity") < total).select(
        "entity", "term", share.alias("share")).where(F.col("share") >= p.generalise).withColumn(
        "action", F.when(F.col("share") >= p.remove, "remove").otherwise("generalise"))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans, an array<struct<kind, start, end, action>> of
    code point ranges. Base spans (email, ip, card, phone; action "mask") come by kind, then
    start; then the term spans by start, whose action is "remove" or "generalise".

    Terms are judged over all rows: n rows hold the entity, the term, or the term within
    reach of the entity. Repeated rows and equal texts count as often as they occur, but
    their surroundings count once. Null and empty texts have no spans. Null or repeated
    doc_ids do no harm, as rows are numbered on their own. Other columns are ignored. An
    empty table gives an empty result.
    """
    p = params
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    made = base.withColumn("spans", base_spans(F.col("text"))).withColumn("terms", F.when(
        F.size("spans") > 0, near_terms(F.col("text"), F.col("spans"), p.reach)))
    made = cut_lineage(made.select("doc_id", "spans", "terms", F.monotonically_increasing_id().alias("row")), "spans")
    seen = made.select("row", F.explode("terms").alias("t")).select("row", "t.*")
    bad = cut_lineage(disclosing(seen.select("row", "entity", "term", "context"), base, made.count(), p), "disclosing")
    marked = seen.join(bad, ["entity", "term"]).groupBy("row", "start", "end").agg(F.max("action").alias("action"))
    per_row = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        F.lit("term").alias("kind"), "start", "end", "action"))).alias("more"))
    names = F.array(*[F.lit(k) for k in KINDS])
    first = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    return made.join(per_row, "row", "left").select(
        "doc_id", F.when(F.col("more").isNull(), first).otherwise(F.concat(first, "more")).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with its spans replaced: base spans by their kind in brackets, terms by [term]
    or by nothing. A span that begins inside an earlier one adds nothing of its own."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
        s["action"] == "remove", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))).alias("mark"))))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], s["mark"]).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], kept, mark).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of ``personal_data``."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
