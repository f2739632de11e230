"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to completion with its whole result (all columns, all rows) sent to a
``noop`` sink. ``index_build`` is the time to cut, tokenize and embed the corpus into the stored
index tables that the search queries read; it counts in the total.
"""

from __future__ import annotations

import json
import os
import time

from doclattice.plans import load_all
from doclattice.plans.registry import QUERIES, Tables
from doclattice.session import local_session

HEADLINE = (
    "page_06_best_extraction", "page_08_table_text", "cln_07_all_rules", "chk_02_fixed_size_chunks",
    "chk_05_sentence_packing", "chk_10_semantic_chunks", "vec_01_chunk_embeddings",
    "vec_03_exact_top_k", "vec_03_passage_top_k", "vec_04_approximate_top_k", "sch_01_postings",
    "sch_03_bm25_top_k", "sch_06_hybrid_search", "sch_09_rerank", "sch_10_neighbour_expansion",
    "sch_11_table_search", "sch_12_compression", "rag_02_context", "rag_07_answer_cache",
    "doc_04_text_within_budget", "doc_10_compare_fields", "cls_01_confidence_routing",
    "fld_01_regex_fields", "fld_07_corrections", "fld_09_spans_until_break",
    "prp_04_deduplicate", "prp_05_document_split", "prp_17_receipt_fields", "evl_04_retrieval_means",
    "evl_09_em_and_f1", "evl_10_rouge_1_2", "ana_03_usage_stats", "ana_07_cost_report",
    "ana_09_sliding_limit", "ana_10_alarm_backend_latency", "wrk_01_invoice_anomalies",
    "wrk_03_extractive_summaries",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = [n for n in QUERIES if n.startswith(tuple(wanted.split(",")))] if wanted else HEADLINE

    def timed(job) -> float:
        start = time.perf_counter()
        job()
        return round(time.perf_counter() - start, 3)

    def build_index() -> None:
        from doclattice.plans import search_queries, vector_queries

        t = Tables(spark, folder)
        search_queries.index_v(t)
        search_queries.stats_v(t)
        vector_queries.chunk_vectors_v(t)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {"index_build": timed(build_index)}
    for name in names:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        )
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
