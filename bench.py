"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once before, on the smallest tables where they are at hand, so that compiling is not timed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from flowlake.queries import QUERIES

HEADLINE = (
    "flagship_hits_per_source", "w1_flow_split", "a1_flow_aggregate", "r9_collect_matches", "r11_hybrid_verdict", "w10_suspicious_count",
    "x3_source_escalation", "w11_vertical_port_scan", "a15_binary_metrics", "m1_roc_auc", "m5_threshold_sweep", "m14_tune_alpha",
    "l15_population_build", "a10_conflict_summary", "l4_split_stratified", "l13_leak_report", "d2_d3_ks_wasserstein", "y4_policy_state_machine",
    "y11_run_metrics", "y13_policy_matrix", "l6_split_temporal", "t3_page", "m8_bootstrap_ci",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '*')}]").appName("bench")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run = lambda name, d: QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        run(name, small if os.path.isdir(small) else sf_dir)
        began = time.perf_counter()
        run(name, sf_dir)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
