"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillmere.plans import catalogue
from quillmere.session import local_session

HEADLINES = [
    "q_tokenize", "q_vocab_df", "q_bm25_weights", "q_bm25_topk", "q_dense_topk", "q_hash_cosine_topk", "q_rrf", "q_rerank", "q_gold_contains", "q_metrics_grouping_sets",
    "q_abstention_best", "q_adjacent_dedupe", "q_quality_report", "q_html_blocks", "q_html_title", "q_chunks_documents", "q_parents", "q_context_budget", "q_sentence_windows", "q_event_sessions",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()
    took = {}
    for name in HEADLINES:
        spark.catalog.clearCache()
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
