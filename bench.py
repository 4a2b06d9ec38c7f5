"""Time the headline queries: one JSON line {"metric", "value", "unit", "queries", "sf"}.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated choice.
Each query is run once to warm up and once for the clock, and counted by its rows written nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (sys.path[0], os.environ.get("PYTHONPATH")) if x)

from paragraf import plans  # noqa: E402
from paragraf.session import session  # noqa: E402

HEADLINE = (
    "q_bm25_topk", "q_bm25_threshold", "q_bm25_stats", "q_tool_search", "q_rrf", "q_rerank", "q_dense_topk", "q_chunks", "q_case_edges", "q_law_edges", "q_neighbors", "q_top_in_out", "q_cocitation", "q_graph_stats", "q_graph_edges",
    "q_graph_search", "q_upsert_coalesce", "q_macro", "q_micro", "q_map", "q_ndcg", "q_competition", "q_extract_all", "q_count_citations", "q_normalize", "q_gold_citations", "q_dedup_merge", "q_enrich", "q_pairs_pos", "q_pack",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    names = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x] or list(HEADLINE)
    taken = {}
    for name in names:
        for _ in range(2):
            spark.catalog.clearCache()  # what one run keeps is no help to the next
            began = time.perf_counter()
            plans.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total of second runs", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
