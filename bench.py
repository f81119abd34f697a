"""Time the headline queries. Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from factloom import catalog  # noqa: E402
from factloom.session import local_session  # noqa: E402

HEADLINE = [
    "column_stats", "distinct_counts", "profile", "describe", "exact_quantiles", "correlate", "correlate_spearman",
    "correlate_kendall", "value_counts", "clean", "apply_cleaning", "drop_dup_rows", "assemble_tables", "segments",
    "two_way_segments", "categories", "crosstabs", "cohorts", "entities", "leader_contrast", "trends", "outliers",
    "histogram", "correlations", "signal_digest", "analyze", "rank_findings", "sql_group_order", "sql_rank_windows",
    "sql_cube", "sql_range_join", "asof_join", "rolling_agg", "read_csv", "ingest_tables", "expand_archives",
    "running_balance", "hold_lifecycle", "clamped_removal", "cached_report_lookup", "report_versions",
    "assemble_sections", "recent_turns", "balance_batch", "balance_stream", "dedupe_events", "trend_stream",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "16g", "bench")
    # One small query starts the JVM, the code cache and the Python workers.
    catalog.QUERIES["sql_group_order"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
