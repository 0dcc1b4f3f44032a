"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated, optional).
"""

from __future__ import annotations

import json
import os
import sys
import time

from factweave.session import local_session
from workload.registry import REGISTRY

HEADLINE = (
    "feed_page", "feed_facet_filters", "search_keywords", "dashboard_kpis", "dashboard_top_lists", "evidence_counters",
    "dossier_fields", "incident_narrative", "text_keys", "relevance_bulletins", "relevance_articles", "extraction",
    "dedup_exact_keys", "dedup_first_wins", "dedup_similar_headlines", "link_best_match", "score_severity",
    "score_confidence", "versions_material_changes", "alert_messages", "query_percolation", "store_upsert_articles",
    "source_feed_items", "scan_funnel",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, "factweave-bench")
    REGISTRY["dashboard_kpis"][0](spark, sf_dir).collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
