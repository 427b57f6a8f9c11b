"""Headline timings: one JSON line. Each query runs from parquet, cold cache, results counted in Spark.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list),
BENCH_RUNS (default 1; the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitspark.plans.catalog import all_queries  # noqa: E402
from pitspark.session import local_session  # noqa: E402

# The headline queries.
HEADLINE = [
    "daily_bars",
    "daily_features",
    "regime_attached",
    "timing_labels",
    "bars_as_of",
    "macro_at_month_starts",
    "append_changed_bars",
    "evidence_fundamentals",
    "flagship_cost_stress",
    "fold_metrics",
    "forward_quotes",
    "replay_states",
    "spread_distribution",
    "position_ledger",
    "average_cost_pnl",
]


def run(spark, item, sf_dir: str) -> float:
    spark.catalog.clearCache()
    start = time.perf_counter()
    item.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else [n for n in HEADLINE if n in catalog]
    spark = local_session(cores, "bench")
    run(spark, catalog["daily_bars"], sf_dir)  # JVM and parquet footer warm-up
    timings = {name: round(min(run(spark, catalog[name], sf_dir) for _ in range(runs)), 3) for name in names}
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_headline_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
