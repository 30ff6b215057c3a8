"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads, BENCH_RUNS the
timed runs per query after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from panelspark import plans
from panelspark.session import local_session

HEADLINE = [
    "flagship_exposure",
    "a01_daily_activity",
    "j01_geotag_events",
    "j06_reference_network",
    "p04_many_lags",
    "p09_monotonic_epsilon",
    "p10_smooth",
    "p20_neighbour_mean",
    "a17_quantiles",
    "rs07_word_counts",
    "m07_bootstrap_metrics",
    "e04_effect_distribution",
    "e07_national_risk",
    "e09_index_correlation",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.load(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
