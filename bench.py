"""Benchmark: run the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query is executed fully with the no-op sink (nothing is collected),
after one untimed warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera import catalog  # noqa: E402
from tessera.session import build_session, checkpoint_dir  # noqa: E402

HEADLINE = [
    "profile_columns_orders",
    "profile_numeric_events",
    "duplicate_rows",
    "class_distribution_priority",
    "split_stratified",
    "split_holdout",
    "kfold_assign",
    "fold_snapshots",
    "standardize_events",
    "onehot_long",
    "fold_local_stats",
    "metrics_classification",
    "dummy_cv_metrics",
    "dataset_digest",
    "ridge_one_feature",
    "logistic_regression_run",
    "ridge_regression_run",
    "forest_classifier_run",
    "forest_regressor_run",
    "final_fit_score",
    "benchmark_holdout",
    "cross_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "16g"})
    checkpoint_dir(spark)
    # Untimed warm-up (JVM/codegen): the flagship query on the smallest tables.
    catalog.REGISTRY["profile_columns_orders"][0](spark, "/root/testdata/sf0.001").collect()
    times = {}
    for name in names:
        fn = catalog.REGISTRY[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
