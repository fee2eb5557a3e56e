"""Headline queries on one folder; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cluster_bcubed", "aligned_triple_f1", "error_funnel", "retrieval_recall_at_k", "oie_miss_buckets", "type_consistency",
    "topk_type_penalty", "sc_embed_threshold_fold", "sc_frozen", "ic_canon_map", "kg_rewrite", "connectivity",
    "entity_link_cascade", "pool_guards", "seed_mean_std",
)


def main():
    from graphloom.plans.catalog import QUERIES
    from graphloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
