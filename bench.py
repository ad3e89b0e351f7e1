"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully computed with the ``noop`` sink (no driver collect), once
to warm up and then ``BENCH_REPEAT`` times; the best time is reported.
``monthly_run`` is the whole batch cycle (filters, enrichment join, gate,
de-dup, state folds, versioned sinks) into a fresh scratch folder, the
counterpart of the reference's end-to-end run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "momentum_star",
    "influence_star",
    "momentum",
    "influence_matrix",
    "relevance_score",
    "digest_lines",
    "run_metrics",
    "dedup_cross_feed",
    "parse_meeting_reports",
    "html_to_text",
    "page_links",
    "discover_new_sources",
    "concept_counts",
    "rolling_recent",
    "upsert_momentum",
    "matrix_as_of",
    "work_item_totals",
    "work_items_by_group",
    "top_meetings_per_group",
    "q_search_topics",
    "q_regional_momentum",
]


def main() -> None:
    from signalmart.plans import monthly
    from signalmart.plans.catalog import QUERIES
    from signalmart.session import build_session
    from signalmart.sources.fixtures import AS_OF, Fixtures

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))

    def run(key):
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()

    def monthly_run():
        fx = Fixtures(spark, sf_dir)
        root = tempfile.mkdtemp(prefix="bench-state-", dir=os.environ.get("BENCH_TMP", "/tmp"))
        monthly.run_monthly(spark, fx.entries, fx.articles.select("entry_ord", "ai_insights"), monthly.RunPaths(root), AS_OF)

    jobs = {k: (lambda k=k: run(k)) for k in (only or HEADLINE)}
    if not only or "monthly_run" in only:
        jobs["monthly_run"] = monthly_run
    times = {}
    for key, job in jobs.items():
        job()  # warm-up (JIT, file listing, code generation)
        best = float("inf")
        for _ in range(repeat):
            t0 = time.perf_counter()
            job()
            best = min(best, time.perf_counter() - t0)
        times[key] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_best_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
