"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Every query runs three times and the median counts, so the run that compiles its code does not. Then each runs once on the
next smaller tables, so that the growth shows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.queries import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "daily_bars",
    "sma_pairs_long_flat",
    "ema_pairs_long_flat",
    "confirmed_ema_pairs",
    "feature_table",
    "directional_movement",
    "rule_library",
    "compared_strategies",
    "period_batch",
    "daily_winners",
    "features_by_winner",
    "monthly_switching_metrics",
    "daily_switching",
    "signal_thresholds",
)


RUNS = 3


def timed(spark, name: str, sf_dir: str, runs: int) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    seconds = {name: timed(spark, name, sf_dir, RUNS) for name in HEADLINE}
    scale = os.path.basename(sf_dir).removeprefix("sf")
    smaller = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": scale,
    }
    if scale != "0.01" and os.path.isdir(smaller):
        result["queries_sf0.01"] = {name: timed(spark, name, smaller, 1) for name in HEADLINE}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
