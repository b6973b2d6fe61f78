"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "hs3_prior_totals_wide", "hs5_last_n_means", "hs8_leakage_audit", "hs10_carried_state", "lb5_exclusion_reasons", "jn2_left_integration",
    "dq1_coverage_by_year", "dq3_dimension_missingness", "wn5_confidence_top3", "wn9_cumulative_roi", "mt2_roc_auc", "mt10_contest_spearman", "mt12_segment_metrics",
    "mt22_same_sample_comparison", "bt1_bet_summary", "bt2_max_drawdown", "bt4_grouped_roi", "bt6_stress_pair", "bt18_segment_cube", "rg1_threshold_grid", "rg2_rule_grid",
    "rg2_best_rules", "rg3_odds_ev_surface", "bs1_roi_bootstrap", "bs3_paired_bootstrap", "ts2_logistic_baseline", "ts8_walk_forward_calibration", "fl5_reports",
]


def main() -> None:
    from pitpanel import plans
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("pitpanel-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = plans.queries()
    warm = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    for name in ("hs3_prior_totals_wide", "bt2_max_drawdown"):  # class loading only, on the smallest tables
        registered[name](spark, warm if os.path.isdir(warm) else SF_DIR).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
