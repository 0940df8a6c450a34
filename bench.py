"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kmer_counts_k34", "kmer_vocab_min20", "kmer_vocab_forced", "kmer_vocab_index", "kmer_align_test",
    "kmer_feature_drift", "kmer_freq_norm", "kmer_top_variance", "clone_presence", "clone_counts", "clone_fisher",
    "clone_selected", "clone_selected_customers", "clone_matrix", "pool_mean_std", "pool_tokens_mean",
    "dataset_type_cv", "stratified_folds", "roc_auc", "importance_distinct", "importance_baseline", "top_sequences",
    "feature_store_roundtrip", "union_submission", "tsv_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from bagscope.plans.registry import QUERIES
    from bagscope.session import local_session, release

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bagscope-bench")
    QUERIES["class_weights"](spark, sf_dir).collect()  # start-up of the session is not a query's time
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
