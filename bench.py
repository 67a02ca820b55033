"""Run the headline queries at $BENCH_SF_DIR and print one JSON line: seconds for each, median of three after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from hyperweave.plans import catalog

HEADLINES = [
    "arity_histogram", "degree_sequence", "primal_degree", "ego_network", "xi_shells", "components", "wl_partition_sizes",
    "identity_classes", "false_merge_census", "one_fact_apart", "pair_fact_symdiff", "pair_degree_l1", "knn_topk", "spearman_pairs",
    "medoid_per_label", "silhouette", "davies_bouldin", "auroc", "adjusted_rand", "encode_fact_word", "isomorphism_classes",
    "profile_jsd", "window_delta", "window_runs",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINES:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
