"""Wall time per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is run to its end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from check import session
from seqlytics.plans.registry import all_queries

HEADLINE = (
    "scan_parquet canonical_outcome year_ffill distinct_rows group_means action_diversity action_entropy below_median_share "
    "mean_diff smoothed_rate_pair features_joined_inner features_joined_left feature_stage impute_median label_encode standardize "
    "target_encode mutual_info padded_sequences state_columns transitions value_iteration greedy_policy recommend_distribution "
    "propagate_steps matchup_table prepare_matchups stratified_split classification_metrics mcc_kappa score_candidates "
    "prediction_report cumulative_success rollup_sequences rate_by_category top_n_categories per_game_counts_union hist2d box_stats"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    queries["rows_per_group"][0](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
