"""Time the headline queries and print one JSON line.

Each query runs once to warm up and is then timed writing to a no-op sink, which computes
every output column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dq_report", "ingest_csv_rows", "impute_ffill_bfill_median", "preprocess", "kpi_true_efficiency",
    "kpi_incremental", "kpi_summary", "hashrate_roll_mean_12h", "mode_peer_te_dev_pct", "feature_set",
    "serving_snapshot", "future_failure_label", "correlation_matrix", "correlation_api", "tradeoff_summary",
    "anomaly_multi_signal", "anomaly_zscore", "hourly_rollup", "fleet_status", "fleet_summary",
    "risk_heuristic", "pr_curve", "threshold_sweep", "flagged_miners", "policy_optimized", "policy_backtest",
    "alert_generate", "insert_if_absent", "upsert_predictions", "json_payload_to_rows", "stream_hourly_rollup",
]


def main() -> None:
    from rigsense.queries import load
    from rigsense.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("rigsense-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in chosen:
        for timed in (False, True):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
