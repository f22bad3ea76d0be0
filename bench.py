"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the
local cores. `BENCH_QUERIES=all` or a comma list selects other queries.
"""

from __future__ import annotations

import json
import os
import re
import time

from workloads.registry import registry
from workloads.session import local_session

HEADLINE = (
    "segment_sentences", "clean_text", "cascade_keyword", "cascade_auto", "document_summary",
    "analyze_report", "category_shares", "merge_corpora", "dedup_first", "conflicts_majority",
    "balance_cap", "stratified_split", "mine_negatives_qa", "build_corpus_wide",
    "classification_report", "ece", "tfidf_vocab", "tfidf", "stream_score",
)


def run(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")
    run(queries["document_summary"](spark, sf_dir))  # start-up and first compilation
    times = {}
    for name in names:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
