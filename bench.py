"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veriloom.plans import QUERIES
from veriloom.session import local_session

HEADLINE = [
    "Q12_table_profiles",
    "Q14_iqr_outliers",
    "C10_cleaning_audit",
    "C7_duplicate_pair_flag",
    "P4_group_split_events",
    "P5_group_holdout",
    "R4_bm25_search",
    "R1_tfidf_search",
    "R7_dense_search",
    "T11_pair_features",
    "R13_fused_top_100",
    "E11_retrieval_metrics",
    "E13_paired_bootstrap",
    "E6_ranking_areas",
    "E10_group_ranking_metrics",
    "E4_threshold_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
