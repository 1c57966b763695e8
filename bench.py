"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from telerisk.catalog import QUERIES
from telerisk.session import local_session

HEADLINE = (
    "p1_canonical_events", "j1_coverage", "j4_anchor_event_counts", "j5_label_index", "j7_future_outcomes", "a1_code_counts",
    "a2_event_day_totals", "a3_trajectory_day", "a4_motion_windows", "a5_motion_day", "j3_dense_entity_days", "a13_landmark_summary",
    "a14_window_features", "a18_role_measures", "a20_directed_followup", "w1_episode_starts", "w2_previous_fix", "w5_code_prefix_sums",
    "a22_iqr_scaler_fit", "a23_std_scaler_fit", "j14_bag_tensor", "w12_midrank_percentile", "w17_stratified_split", "a33_ranking_metrics",
    "a34_auc_interval", "o2_top_fraction", "m7_scorecard_a", "m8_scorecard_b")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    spark = local_session(cpus, "telerisk-bench", spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='telerisk-bench-')}")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
