"""Column expressions for text: cleaning, parsing, naming, prompt hygiene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholder texts that mean "missing", compared in lower case.
NULL_TOKENS = [
    "", "na", "n/a", "n\\a", "null", "none", "nan", "#n/a", "-", "--", "?", ".",
    "unknown", "n.a.", "missing",
]
CURRENCY = "$€£₹¥"
# Chart types a report may use.
CHART_TYPES = [
    "bar", "grouped_bar", "stacked_bar", "line", "multi_line", "area", "stacked_area",
    "scatter", "pie", "donut", "histogram", "dual_axis", "radar",
]
# end of fixed values

_DIGITS = r"(?:,*\d[\d,]*(?:\.[\d,]*)?|,*\.,*\d[\d,]*)(?:[eE][+-]?\d+)?"
_MONEY = rf"^\s*[{CURRENCY}]*\s*[+-]?{_DIGITS}\s*%*\s*$"
# Shape that every date layout below shares; one test rules out ordinary text.
_MAYBE_TIME = r"^\d{1,4}[-/. ]|^\d{8}$|^[A-Za-z]{3,9},? \d"
_LONGEST_TIME = 40
_ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"
_CLOCK = r"( \d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
_HALF_DAY = r" \d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)? ?[AaPp][Mm]$"
# pattern of the text -> Spark datetime pattern
_OTHER_TIMES = [
    (r"^\d{4}/\d{1,2}/\d{1,2}" + _CLOCK, "yyyy/M/d[ H:mm[:ss[.SSSSSS]]]"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}" + _CLOCK, "d.M.yyyy[ H:mm[:ss[.SSSSSS]]]"),
    (r"^(19|20)\d{6}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}" + _CLOCK, "d MMM yyyy[ H:mm[:ss[.SSSSSS]]]"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}" + _CLOCK, "d-MMM-yyyy[ H:mm[:ss[.SSSSSS]]]"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}" + _CLOCK, "MMM d, yyyy[ H:mm[:ss[.SSSSSS]]]"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}" + _CLOCK, "d MMMM yyyy[ H:mm[:ss[.SSSSSS]]]"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}" + _CLOCK, "MMMM d, yyyy[ H:mm[:ss[.SSSSSS]]]"),
]
_RFC_TIME = r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC|Z)$"
# Numbers only, whose order of day and month the text does not tell.
_OPEN_TIMES = [(sep, rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}(?:\d{{2}})?\d{{2}}") for sep in "/-"]
# A year of two digits: 69 to 99 are of the last century.
_SHORT_YEAR = r"^(\d{1,2}[-/]\d{1,2}[-/])"
# All layouts; their places here are the numbers that ``time_layout`` gives.
_TIME_SHAPES = [_ISO_TIME, *[shape + tail for _, shape in _OPEN_TIMES for tail in (_CLOCK, _HALF_DAY)],
                *[shape for shape, _ in _OTHER_TIMES], _RFC_TIME]
# A first or second number that no month can be.
_ABOVE_12 = r"(?:1[3-9]|[2-9]\d)"
_YEAR = r"(?:\d{2})?\d{2}\b"
_DAY_LEADS, _DAY_FOLLOWS = rf"^{_ABOVE_12}[-/]\d{{1,2}}[-/]{_YEAR}", rf"^\d{{1,2}}[-/]{_ABOVE_12}[-/]{_YEAR}"
# White space as Unicode has it, and the four separators below it.
_BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# What a text has that norm_text changes: any other white space than single blanks between words.
_UNEVEN = r"^ | $|  |[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def norm_text(c: Column) -> Column:
    """Runs of any white space (Unicode too) become one blank; ends are trimmed."""
    return F.when(c.rlike(_UNEVEN), F.trim(F.regexp_replace(c, _BLANKS, " "))).otherwise(c)


def is_null_token(c: Column) -> Column:
    return F.lower(c).isin(NULL_TOKENS)


def null_tokens(c: Column) -> Column:
    return F.when(~is_null_token(c), c)


def to_number(c: Column) -> Column:
    """'$1,234' -> 1234.0, '45%' -> 45.0; anything else that is not a number -> null.
    One pattern checks the shape, then signs and separators are dropped."""
    return F.when(c.rlike(_MONEY), F.translate(c, f"{CURRENCY}%, \t", "").try_cast("double"))


def day_is_first(c: Column) -> Column:
    """Aggregate: some value of the column can only be read with the day first, and none
    only with the month first. The whole column is then read that way."""
    return (F.count_if(c.rlike(_DAY_LEADS)) > 0) & (F.count_if(c.rlike(_DAY_FOLLOWS)) == 0)


def _maybe_time(c: Column) -> Column:
    return (F.length(c) <= _LONGEST_TIME) & c.rlike(_MAYBE_TIME)


def time_layout(c: Column) -> Column:
    """Number of the layout the cell has, of those ``to_timestamp`` reads; null without one. The numbers in it
    may still be no date; a cell without a layout never is one."""
    out = F
    for k, shape in enumerate(_TIME_SHAPES):
        out = out.when(c.rlike(shape), k)
    return F.when(_maybe_time(c), out)


def to_timestamp(c: Column, day_first: bool | Column = False, layouts: int | None = None) -> Column:
    """Dates in a fixed set of layouts; a bare year is not a date. ``day_first`` tells how to
    read 1/2/2024 and 1-2-2024. A caller who knows which layouts occur passes their numbers
    as bits, so that the others are not tried on every cell."""
    def year(text):
        full = F.regexp_replace(F.regexp_replace(text, _SHORT_YEAR + r"(69|[7-9]\d)(?!\d)", "$119$2"), _SHORT_YEAR + r"(\d{2})(?!\d)", "$120$2")
        return F.when(text.rlike(_SHORT_YEAR + r"\d{2}(?!\d)"), full).otherwise(text)

    def open_time(sep, clock, text):
        month, day = (F.try_to_timestamp(text, F.lit(p + f"{sep}yyyy{clock}")) for p in (f"M{sep}d", f"d{sep}M"))
        return (day if day_first else month) if isinstance(day_first, bool) else F.when(day_first, day).otherwise(month)

    reads = [lambda: c.try_cast("timestamp")]
    for sep, _ in _OPEN_TIMES:
        reads.append(lambda sep=sep: open_time(sep, "[ H:mm[:ss[.SSSSSS]]]", year(c)))
        reads.append(lambda sep=sep: open_time(sep, " h:mm[:ss[.SSSSSS]] a", F.upper(F.regexp_replace(year(c), r"(?i)(\d)([ap]m)$", "$1 $2"))))
    reads += [lambda pattern=pattern: F.try_to_timestamp(c, F.lit(pattern)) for _, pattern in _OTHER_TIMES]
    reads.append(lambda: F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, | (GMT|UTC|Z)$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    out = F
    for k, (shape, read) in enumerate(zip(_TIME_SHAPES, reads, strict=True)):
        if layouts is None or layouts >> k & 1:
            out = out.when(c.rlike(shape), read())
    return F.lit(None).cast("timestamp") if out is F else F.when(_maybe_time(c), out)


def has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def name_tokens(c: Column) -> Column:
    """Words of at least three characters inside a column name."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def tokens_in_goal(name: Column, goal: Column) -> Column:
    """How many words of ``name`` stand as whole words in ``goal``. A word there is
    a run of letters, digits or underscores."""
    words = F.split(F.lower(goal), r"(?U)\W+")
    return F.size(F.filter(name_tokens(name), lambda t: F.array_contains(words, t)))


def in_focus(name: Column, goal: Column) -> Column:
    return (F.length(goal) > 0) & (
        F.contains(F.lower(goal), F.lower(name)) | (tokens_in_goal(name, goal) > 0))


def sanitize_prompt(c: Column, limit: int = 1000) -> Column:
    bare = F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")
    bare = F.regexp_replace(bare, r"(?i)</?\s*user_request\s*>", "")
    return F.substring(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), 1, limit)


def usable_prompt(c: Column, shortest: int = 10) -> Column:
    """Null when the cleaned question is too short to act on."""
    clean = sanitize_prompt(c)
    return F.when(F.length(clean) >= shortest, clean)


def strip_markdown(c: Column) -> Column:
    for pattern, to in [(r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"`(.*?)`", "$1"),
                        (r"(?m)^#+\s*", ""), (r"(?m)^\s*[-*]\s+", "• ")]:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def safe_file_title(c: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\w\s-]", ""))
    short = F.substring(F.regexp_replace(bare, r"\s+", "-"), 1, 80)
    return F.when(F.length(short) > 0, short).otherwise(F.lit("report"))


def goal_text(question: Column, rationale: Column, chart_types: Column) -> Column:
    hint = F.when(F.size(chart_types) > 0, F.concat(
        F.lit(" Where they help, use varied charts such as: "),
        F.array_join(chart_types, ", "), F.lit("."))).otherwise(F.lit(""))
    return F.trim(F.concat(question, F.lit(" "), rationale, hint))


def byte_size_text(c: Column) -> Column:
    kib, mib = 1024, 1024 * 1024
    return (F.when(c < kib, F.concat(c.cast("string"), F.lit(" B")))
            .when(c < mib, F.concat(F.floor(c / kib + 0.5).cast("string"), F.lit(" KB")))
            .otherwise(F.concat(F.format_string("%.1f", c / mib), F.lit(" MB"))))


IDEA = T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("chart_types", T.ArrayType(T.StringType()))]))


def json_block(c: Column, bracket: str = "{") -> Column:
    """Widest {...} or [...] block inside free text."""
    pattern = r"(?s)\{.*\}" if bracket == "{" else r"(?s)\[.*\]"
    return F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))


def parse_ideas(c: Column) -> Column:
    """Ideas in a model response: items without a title or question are dropped,
    chart types are limited to four known ones, blanks get defaults."""
    def keep(item):
        return (F.length(F.trim(item["title"])) > 0) & (F.length(F.trim(item["question"])) > 0)

    def shape(item):
        charts = F.filter(F.transform(F.coalesce(item["chart_types"], F.array().cast("array<string>")),
                                      lambda x: F.lower(F.trim(x))), lambda x: x.isin(CHART_TYPES))
        why = F.trim(F.coalesce(item["rationale"], F.lit("")))
        return F.struct(
            F.substring(F.trim(item["title"]), 1, 255).alias("title"),
            F.trim(item["question"]).alias("question"),
            F.when(F.length(why) > 0, why)
            .otherwise(F.lit("Explore this question across the dataset.")).alias("rationale"),
            F.when(F.size(charts) > 0, F.slice(charts, 1, 4))
            .otherwise(F.array(F.lit("bar"), F.lit("line"))).alias("chart_types"))

    return F.transform(F.filter(F.from_json(json_block(c, "["), IDEA), keep), shape)
