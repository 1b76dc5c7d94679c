"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``ingest`` derives and lands the trace tables from the raw tables (once); the queries read the landed
tables, as they would on a cluster. The first run of a query also lands what it shares with later
ones; ``warm`` has the times of a second run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracegraph.plans import registry  # noqa: E402
from tracegraph.session import local_session, release  # noqa: E402

HEADLINE = ["itg_nodes", "itg_edges", "degree_stats", "clustering", "path_stats", "url_view", "network_view",
            "redirect_view", "interaction_view", "itg_view", "cross_view", "all_views", "trace_quality",
            "heuristic_verdict", "trace_fingerprint", "dedup_traces", "domain_score", "domain_points_ct", "serp_score",
            "wl_labels", "tertile_strata", "roc_auc", "mutual_information", "inject_nodes", "gcn_embed", "clf_lr", "candidate_stream"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    registry.load()
    out: dict[str, float] = {}
    warm: dict[str, float] = {}
    start = time.time()
    t = registry.tables(spark, sf_dir)
    for table in (t.ev, t.rq, t.rd, t.tr):
        assert table is not None
    out["ingest"] = round(time.time() - start, 3)
    for name in HEADLINE:
        if name not in registry.QUERIES:
            continue
        for times in (out, warm):
            start = time.time()
            registry.bind(registry.QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": out, "warm": warm,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
