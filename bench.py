"""Headline timings: ``BENCH_SF_DIR`` (data folder), ``BENCH_CPUS`` (local cores).

Prints one JSON line.  ``BENCH_KEYS`` (comma-separated prefixes) narrows or widens the set;
``BENCH_KEYS=all`` times every registered plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

from oddsmith.plans import all_queries
from oddsmith.session import local_session

HEADLINE = [
    "e03_calibration_summary", "e04_ece", "e05_reliability_bins", "d01_label_join", "h09_score_batch", "c16_decision_gates",
    "i03_recommended_action", "h14_event_injection", "h02_binary_gate", "f04_apply_snapshot", "g02_fan_in_percentile", "g03_file_rollup",
    "g07_transitive_reach", "g24_cycle_files", "d09_interval_owners", "j01_ranked_recall", "f15_hash_chain", "e21_arm_metrics",
    "h03_continuous_gate", "d16_revision_attempts", "k01_stream_measurement",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_KEYS", "")
    every = all_queries()
    if wanted == "all":
        keys = list(every)
    elif wanted:
        keys = [k for k in every if any(k.startswith(p) for p in wanted.split(","))]
    else:
        keys = HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times: dict[str, float] = {}
    for key in keys:
        start = time.perf_counter()
        every[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
