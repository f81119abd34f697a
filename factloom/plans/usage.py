"""Analytics over report history, suggestions, users and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordered import ROWS_PER_RANGE, Running, join_keys, numbered, running

RECENT_TURNS = 12
SAME_REPORT = ["user_id", "dataset_id", "goal"]


def owned(df: DataFrame, user_id, archived: bool = False) -> DataFrame:
    """One owner's rows, newest first."""
    return (df.where((F.col("user_id") == user_id) & (F.col("archived") == archived))
            .orderBy(F.desc("created_at"), F.desc("id")))


def cached_report(reports: DataFrame) -> DataFrame:
    """(id, cached_id): for each report the newest other finished one with the same user,
    dataset and goal. The two newest per group are enough to answer for every report, so
    rows are never paired with each other."""
    done = reports.where(F.col("status") == "completed")
    w = Window.partitionBy(*SAME_REPORT).orderBy(F.desc("created_at"), F.desc("id"))
    two = done.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    newest = two.groupBy(*SAME_REPORT).agg(F.max(F.when(F.col("_rn") == 1, F.col("id"))).alias("_first"),
                                           F.max(F.when(F.col("_rn") == 2, F.col("id"))).alias("_second"))
    joined = reports.join(newest, SAME_REPORT, "left")
    return joined.select("id", F.when(F.col("_first") != F.col("id"), F.col("_first")).otherwise(F.col("_second")).alias("cached_id"))


def report_versions(reports: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Live reports with version number, group size and the newest of the group."""
    live = reports.where(~F.col("archived"))
    groups = live.groupBy(*SAME_REPORT).agg(F.count(F.lit(1)).alias("versions"),
                                            F.max_by("id", F.struct("created_at", "id")).alias("newest_id"))
    return join_keys(numbered(live, SAME_REPORT, ["created_at", "id"], "version", rows_per_range), groups, SAME_REPORT)


def content_stats(reports: DataFrame, content: str = "content") -> DataFrame:
    """Adds sections, charts and chart types in first-seen order."""
    kinds = F.filter(F.flatten(F.transform(F.col(content), lambda s: F.transform(
        F.coalesce(s["charts"], F.array()), lambda c: c["type"]))), lambda k: F.length(k) > 0)
    return reports.withColumns({
        "section_count": F.coalesce(F.when(F.col(content).isNotNull(), F.size(content)), F.lit(0)),
        "chart_count": F.coalesce(F.size(kinds), F.lit(0)), "chart_types": F.array_distinct(kinds)})


def chart_mix(reports: DataFrame, content: str = "content") -> DataFrame:
    charts = reports.select(F.explode(content).alias("s")).select(F.explode("s.charts").alias("c"))
    return charts.groupBy(F.col("c.type").alias("type")).agg(F.count(F.lit(1)).alias("count"))


def dashboard_kpis(reports: DataFrame, content: str = "content") -> DataFrame:
    """Credits used, finished reports, rows analysed and the richest report (most charts,
    then most sections, then the newer id)."""
    done = F.col("status") == "completed"
    s = content_stats(reports, content)
    return s.agg(F.coalesce(F.sum(F.when(done, F.col("credit_cost"))), F.lit(0)).alias("credits_used"),
                 F.count_if(done).alias("reports_made"),
                 F.coalesce(F.sum(F.when(done, F.col("row_count"))), F.lit(0)).alias("rows_analysed"),
                 F.max_by("id", F.when(done, F.struct("chart_count", "section_count", "id"))).alias("featured_id"))


def assemble_sections(log: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Event log (report_id, seq, event, data) to sections (report_id, section, title,
    narrative, charts). Text and charts outside a section are ignored."""
    edge = F.when(F.col("event").isin("section_start", "section_end"), F.col("event"))
    opened = running(log, ["report_id"], ["seq"], [
        Running("section", "sum", F.when(F.col("event") == "section_start", 1).otherwise(0).cast("bigint")),
        Running("_edge", "last", edge)], rows_per_range)
    inside = opened.where(F.col("_edge") == "section_start")
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(
        F.when(F.col("event") == kind, F.struct("seq", "data")))), lambda x: x["data"])
    return inside.groupBy("report_id", "section").agg(
        F.max(F.when(F.col("event") == "section_start", F.col("data"))).alias("title"),
        F.array_join(listed("token"), "").alias("narrative"), listed("chart").alias("charts"))


def recent_turns(messages: DataFrame, keep: int = RECENT_TURNS) -> DataFrame:
    """Last user and assistant messages with text per session, oldest first. The rank
    filter also runs before the shuffle, so a long session sends few rows."""
    spoken = messages.where(F.col("role").isin("user", "assistant") & (F.length("text") > 0))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return spoken.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn").orderBy("conv_id", "turn")


def suggestion_funnel(suggestions: DataFrame) -> DataFrame:
    kinds = ["suggested", "generated", "dismissed"]
    return (suggestions.groupBy("dataset_id").pivot("status", kinds).agg(F.count(F.lit(1)))
            .na.fill(0, kinds))


def signup_segments(users: DataFrame) -> DataFrame:
    return users.groupBy("referral_source", "use_purpose", "verified").agg(F.count(F.lit(1)).alias("users"))


def file_titles(reports: DataFrame, title: str, order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """File-safe title per report; repeats get -v2, -v3, …"""
    based = reports.withColumn("_base", text.safe_file_title(F.col(title)))
    n = numbered(based, ["_base"], [order], "_k", rows_per_range)
    name = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("-v"), F.col("_k").cast("string")))
    return n.withColumn("file_title", name).drop("_base", "_k")
