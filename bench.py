"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fillcast.catalog import REGISTRY  # noqa: E402

HEADLINE = [
    "f00_clean_readings", "t01_detect_collections", "t03_threshold_sensitivity", "t04_resample", "t10_event_rolling",
    "t13_expanding_history", "t16_grid_rolling", "t19_time_to_threshold", "h03_holiday_features", "w05_asof_join", "w08_forward_fill",
    "w21b_all_weather_time", "e01_fit_encoder", "p04_holdout_folds", "m05b_metrics_per_container", "m06_bootstrap_intervals",
    "m07_wilcoxon_statistic", "m08_pair_correlations", "m12_top_share_hits", "b06_ar_forecasts", "b09_naive_comparison",
    "v01_survival_data", "v02_kaplan_meier", "v03_hazard_baseline", "l01_train_and_evaluate", "x01b_event_table",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fillcast-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start-up is not a query
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        runs = []
        for _ in range(1 if name.startswith(("l", "x")) else REPEATS):
            started = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "repeats": REPEATS}))


if __name__ == "__main__":
    main()
