"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (names, comma separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

from gatelane.catalog import all_queries
from gatelane.session import build_session

HEADLINE = [
    "route_documents", "routing_outcomes", "request_roundtrip", "pii_types_per_doc", "policy_check", "screen_conversations",
    "softmax_head", "nearest_centroid", "best_match_all", "cache_lookup", "cache_lookup_ttl", "cache_fill", "cache_lookup_capped",
    "best_model_per_request", "tokens_by_model", "latency_histogram", "latency_p95", "token_rate_5m", "inflight_load",
    "request_response_pairs", "gateway_counter_snapshot", "graded_replies", "eval_summary", "accuracy_matrix", "ranked_scores",
    "sample_per_category", "stratified_split", "prepare_corpus", "word_pii_labels", "token_match", "labelled_corpus",
    "classification_report", "streaming_counters", "streaming_cache", "cache_replay", "streaming_token_rate", "streaming_load",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(f"local[{cpus}]", "gatelane-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    for name in names:
        runs = []
        for _ in range(2):  # the first run pays for code generation
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
