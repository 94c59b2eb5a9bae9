"""Bench: run headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line with per-query wall-clock seconds."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from somnolyt.plans.all_queries import QUERIES  # noqa: E402
from somnolyt.session import local_session  # noqa: E402

HEADLINE = [
    "preprocess_cohort", "preprocess_cohort_knn", "describe_numeric", "correlation_matrix",
    "outlier_summary", "histogram", "top_categories", "model_matrix", "stratified_split",
    "knn_join", "smote_tomek", "adasyn", "roc_auc", "classification_report", "cv_summary",
    "train_rf_binary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus)
    QUERIES["severity_distribution"](spark, sf_dir).collect()  # warm-up, not timed
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
