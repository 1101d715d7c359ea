"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docreview.session import build_session  # noqa: E402

HEADLINE = (
    "r02_vector_topk", "r04_bm25_terms", "r05_bm25_topk", "r09_hybrid_search", "r10_retrieve_for_clauses",
    "t05_classify_documents", "t10_chunk_documents", "t13_categorize_clauses", "f07_review_documents", "k04_quality_gate",
    "k08_rewrite_clauses", "b04_merge_table_chains", "b07_regions_from_words", "e05_aggregate_metrics", "m04_verify_summary",
    "a05_assemble_reports", "a14_latest_feedback", "s04_html_to_text", "w02_replay_from_cursor", "w04a_request_rate",
    "w04b_admit_requests", "w06_ttl_store",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    import docreview.plans  # noqa: F401
    from docreview.plans.registry import PLANS
    from docreview.sources.tables import Tables

    partitions = int(cpus) if cpus.isdigit() else 8  # the tables are single files of one row group

    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("max(o_orderkey)").collect()  # start the JVM's readers
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        PLANS[name].build(Tables(spark, sf_dir, partitions)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
