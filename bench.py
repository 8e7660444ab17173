"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each run twice in one session; prints one JSON line whose
figures are those of the first run, as in round 1, with the second, warm one beside them."""

from __future__ import annotations

import json
import os
import sys
import time

from skein import registry
from skein.session import build_session

HEADLINE = (
    "symbols_by_kind", "index_stats", "bm25_topk", "knn_topk", "knn_graph", "similarity_join", "hybrid_search", "tfidf_keywords", "fan_in_out", "pagerank", "bfs_levels", "wcc",
    "co_change_pairs", "hotspots", "diff_classes", "debounce_batch", "usage_stats", "pii_scan", "layer_violations", "budget_select",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "skein-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["symbols_by_kind"](spark, sf).count()  # the session's own start is not a query's time
    runs = ([], [])
    for name in HEADLINE:
        for kept in runs:  # the first run also loads and compiles what the query needs
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            kept.append(round(time.perf_counter() - began, 3))
        print(name, runs[0][-1], runs[1][-1], file=sys.stderr)
    took, warm = (dict(zip(HEADLINE, x, strict=True)) for x in runs)
    out = {"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "warm": warm, "warm_total": round(sum(warm.values()), 3)}
    print(json.dumps(out | {"sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
