"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactlane.plans import QUERIES  # noqa: E402
from pactlane.session import local_session  # noqa: E402

HEADLINE = [
    "strict_metrics",
    "failure_slices",
    "layered_metrics",
    "micro_f1",
    "safety_confusion",
    "residual_families",
    "residual_clusters",
    "training_rows",
    "preference_pairs",
    "family_coverage",
    "leak_scan",
    "contamination",
    "holdout_row_failures",
    "stratified_split",
    "paired_tradeoff",
    "family_deltas",
    "bootstrap_ci",
    "projection_metrics",
    "span_statistics",
    "slot_movements",
    "sidecars",
    "hook_outcomes",
    "latency_summary",
    "redacted_texts",
    "ordered_line_hash",
    "metric_deltas",
    "span_verify",
    "near_dup_pairs",
    "greedy_dedupe",
    "jaccard_overlaps",
    "slot_mechanisms",
    "first_differences",
    "train_analogues",
    "case_design",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    warm: dict[str, float] = {}

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        took[name] = timed(name)
        print(name, took[name], file=sys.stderr, flush=True)
    for name in HEADLINE:  # shared frames are written and code is compiled by now
        warm[name] = timed(name)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "warm": warm, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
