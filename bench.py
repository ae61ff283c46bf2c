"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from deployrisk.plans import registry  # noqa: E402
from deployrisk.session import build_session  # noqa: E402

HEADLINE = [
    "score_fleet", "agg_kpi", "agg_feature_stats", "agg_latency_hist", "agg_counters",
    "ci_failure_rate", "ci_time_delta", "deployer_exp", "jit_rolling_rate",
    "imp_serving", "imp_training", "join_followup", "join_label",
    "win_newest_n", "win_tail_split", "top_reasons",
    "met_evaluate", "met_auc_roc", "ml_gate", "drift_verdict",
    "hw_evaluate", "lbl_resolve", "lbl_status",
    "src_github_runs", "src_junit_counts", "src_numstat", "sx_complexity", "sx_ratios",
    "st_health_window", "st_access_metrics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    # start the JVM's compiler and the file listing before timing
    queries["agg_kpi"](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
