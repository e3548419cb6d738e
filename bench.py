"""Time the headline queries: one JSON line with seconds per query.

Each query runs twice. ``queries`` holds the second run; ``cold`` the first,
which on small tables is mostly start-up, planning and code generation.
``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from ticketmill.plans.queries import REGISTRY
from ticketmill.session import local_session

HEADLINE = (
    "trailing_count", "baseline_rows", "bm25", "knn_topk", "match_keys", "documents", "clean_text",
    "cooldown_alerts", "signal_counts", "cluster_mates", "suggestion_stats", "upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first, so that session start is not charged to a query
    REGISTRY["document_count"](spark, sf_dir).collect()
    runs: list[dict[str, float]] = [{}, {}]
    for name in HEADLINE:
        for seconds in runs:
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    cold, warm = runs
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
