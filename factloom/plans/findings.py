"""Ranking findings and laying them out as a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_CHARTS, MAX_FINDINGS

FOCUS_BONUS = 0.45

# Report sections in order, with the finding kinds each one holds.
SECTIONS = [
    ("Top Performers", ["entity"]),
    ("Performance vs Expectation", ["performance"]),
    ("Key Relationships & Drivers", ["correlation"]),
    ("Segment Comparisons", ["segment"]),
    ("Cohort Profiles & Cross-Tabs", ["cohort", "crosstab"]),
    ("Composition & Distributions", ["category", "distribution"]),
    ("Trends Over Time", ["trend"]),
    ("Data Overview & Quality", ["overview", "quality"]),
]
SECTION_LIMIT = 4
PLAN_SECTION_LIMIT = 6
PLAN_CHART_LIMIT = 3
PLAN_TITLE_LENGTH = 120
MISSING_ADVICE = "Address the missing-value gaps before relying on affected columns."
DRIVER_ADVICE = "Investigate the strongest correlations for causal drivers."
GENERAL_ADVICE = "Review the highlighted findings with domain stakeholders."
# end of fixed values


def rank_findings(findings: DataFrame, focus: list[str], max_findings: int = MAX_FINDINGS,
                  max_charts: int = MAX_CHARTS) -> DataFrame:
    """Most important first. ``findings`` has seq, importance, columns and chart_id;
    findings about focus columns get a bonus, and only the first ``max_charts``
    charts keep their link. A distributed top-n leaves at most ``max_findings`` rows
    for the windows."""
    wanted = F.array(*[F.lit(c) for c in focus]).cast("array<string>")
    lifted = findings.withColumn("importance", F.col("importance") + F.when(
        F.arrays_overlap("columns", wanted), FOCUS_BONUS).otherwise(0.0))
    top = lifted.orderBy(F.desc("importance"), "seq").limit(max_findings)
    one = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "seq")
    ranked = top.withColumn("rank", F.row_number().over(one))
    first = F.when(F.col("chart_id").isNotNull(), F.min("rank").over(Window.partitionBy("chart_id")))
    ranked = ranked.withColumn("_first", first)
    place = F.dense_rank().over(Window.partitionBy(F.col("_first").isNull()).orderBy("_first"))
    keep = F.col("_first").isNotNull() & (place <= max_charts)
    return ranked.withColumn("chart_id", F.when(keep, F.col("chart_id"))).drop("_first")


def section_plan(ranked: DataFrame, limit: int = SECTION_LIMIT) -> DataFrame:
    """(position, title, finding_ids, chart_ids): findings grouped under fixed titles."""
    number = F.create_map(*[F.lit(x) for i, (_, kinds) in enumerate(SECTIONS) for k in kinds for x in (k, i)])
    title = F.array(*[F.lit(t) for t, _ in SECTIONS])
    listed = F.sort_array(F.collect_list(F.struct("rank", "id", "chart_id")))
    sections = (ranked.withColumn("section", F.try_element_at(number, F.col("kind"))).where("section is not null")
                .groupBy("section").agg(listed.alias("found")).orderBy("section").limit(limit))
    w = Window.partitionBy(F.lit(0)).orderBy("section")
    return sections.select(
        F.row_number().over(w).alias("position"), F.element_at(title, F.col("section") + 1).alias("title"),
        F.transform("found", lambda f: f["id"]).alias("finding_ids"),
        F.array_compact(F.transform("found", lambda f: f["chart_id"])).alias("chart_ids"))


def plan_check(plan: DataFrame, findings: DataFrame, charts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Proposed sections (key…, position, title, finding_ids, chart_ids) with unknown ids
    removed and every finding used once per plan. Six titled sections count; of those
    the ones without findings go, and each shows three charts at most."""
    key = key or []
    titled = (plan.withColumn("title", F.substring(F.trim("title"), 1, PLAN_TITLE_LENGTH)).where(F.length("title") > 0))
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("position")
    titled = titled.withColumn("_n", F.row_number().over(w))
    ids = titled.select(*key, "position", "title", "_n", F.posexplode("finding_ids").alias("at", "id"))
    ids = ids.join(findings.select("id").distinct(), "id", "left_semi")
    # First section wins; within it a repeated id stays.
    owner = ids.groupBy(*key, "id").agg(F.min("_n").alias("_n"))
    kept = (ids.join(owner, [*key, "id", "_n"], "left_semi").where(F.col("_n") <= PLAN_SECTION_LIMIT)
            .groupBy(*key, "_n").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("f")))
    shown = titled.select(*key, "_n", F.posexplode("chart_ids").alias("at", "id"))
    shown = (shown.join(charts.select("id").distinct(), "id", "left_semi")
             .groupBy(*key, "_n").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("c")))
    joined = titled.select(*key, "_n", "position", "title").join(kept, [*key, "_n"]).join(shown, [*key, "_n"], "left")
    names = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["id"])
    return joined.select(
        *key, "position", "title", F.transform("f", lambda x: x["id"]).alias("finding_ids"),
        F.coalesce(F.slice(F.transform("c", lambda x: x["id"]), 1, PLAN_CHART_LIMIT),
                   F.array().cast("array<string>")).alias("chart_ids"))


def finding_lookup(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """(request columns…, position, finding columns…) for each id asked for, in order."""
    asked = requests.select(*[c for c in requests.columns if c != "ids"], F.posexplode("ids").alias("position", "id"))
    return asked.join(findings, "id")


def top_chart(ranked: DataFrame) -> DataFrame:
    return ranked.where("chart_id is not null").agg(F.min_by("chart_id", "rank").alias("chart_id"))


def default_summary(ranked: DataFrame) -> DataFrame:
    """Text of the two leading findings."""
    two = ranked.orderBy("rank").limit(2).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: x["text"]), " ")
    return two.select(F.when(F.size("f") > 0, text).otherwise("Analysis of the dataset.").alias("summary"))


def default_recommendations(ranked: DataFrame) -> DataFrame:
    """(position, advice), by the kinds of findings present."""
    has = ranked.agg(
        F.coalesce(F.bool_or((F.col("kind") == "quality") & F.contains("text", F.lit("missing"))), F.lit(False)).alias("missing"),
        F.coalesce(F.bool_or(F.col("kind") == "correlation"), F.lit(False)).alias("related"))
    advice = F.array_compact(F.array(F.when(F.col("missing"), MISSING_ADVICE), F.when(F.col("related"), DRIVER_ADVICE)))
    return has.select(F.posexplode(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(GENERAL_ADVICE))))
                      .alias("position", "advice"))
