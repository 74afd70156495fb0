"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs three times after a warm-up; the median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = ("policy_by_agent", "policy_decisions", "policy_streak", "policy_independent", "policy_grid", "policy_grid_full", "policy_evaluation", "select_drop_capped", "fold_aggregate", "rank_stability", "signal_lift", "token_rows", "token_savings", "split_leave_one_model", "split_leakage", "prefix_audit", "value_counts", "parse_logs", "prefix_features", "selected_decisions", "sweep_results", "full_prefix_tokens", "policy_grid_streaks", "parse_layouts", "token_cache_edited")
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from haltlens.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        each = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        times[name] = round(statistics.median(each[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
