"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is run once to warm up and once timed, its rows going to the no-op sink; ``cold`` names those for
which ``$BENCH_SECONDS`` left no second run.
``build_index`` is the one-off derivation of the stored tables that the search queries read.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "parse_sections", "build_chunks", "clean_markdown", "build_postings", "tokenize_overlap", "document_metrics", "database_summary",
    "fulltext_match", "fulltext_search", "hybrid_search", "vector_search", "vector_search_approx", "split_claims", "match_rules", "build_retrieval_queries", "detect_changes",
    "latest_review_status", "review_history", "scope_by_permission", "eval_claim_results", "suggest_alignments",
)


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    budget = float(os.environ.get("BENCH_SECONDS", "300"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from verification.inputs import inputs
    from verification.queries import QUERIES

    begin = time.time()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    cold: list[str] = []

    def timed(name: str, run) -> None:
        start = time.time()
        try:
            run()
            seconds[name] = round(time.time() - start, 3)
            print(name, seconds[name], file=sys.stderr, flush=True)
        except Exception as exc:  # a failing query is reported, not hidden
            failed[name] = str(exc).splitlines()[0][:200]

    timed("build_index", lambda: inputs(spark, sf_dir).corpus.build())
    for name in HEADLINE:
        run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed(name, run)
        if name in seconds and time.time() - begin < budget:
            timed(name, run)
        else:
            cold.append(name)
    total = round(sum(seconds.values()), 3)
    out = {"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if cold:
        out["cold"] = cold
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
