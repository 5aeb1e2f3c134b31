"""Benchmark the headline jobs.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: one warm-up run, then the median of three
timed runs, each result written to the ``noop`` sink (full execution, no
output cost). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantfold.plans.registry import QUERIES, load_all  # noqa: E402
from quantfold.session import local_session  # noqa: E402

HEADLINE = [
    "j01_portfolio_vs_benchmark",
    "j02_portfolio_sell_targets",
    "j03_model_panel",
    "j04_quarterly_macro",
    "h13_similarity_pages",
    "h18_sentence_selection",
    "d06_asof_attach",
    "i15_backtest_predictions",
    "i06_grid_search",
]


def run_once(spark, fn, sf_dir: str) -> float:
    spark.catalog.clearCache()  # a run must not read what an earlier one kept
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "6g"),
                          shuffle_partitions=max(4, 2 * int(cpus)) if cpus.isdigit() else 8)
    load_all()
    results: dict[str, float] = {}
    for name in (only or HEADLINE):
        fn = QUERIES.get(name)
        if fn is None:
            continue
        run_once(spark, fn, sf_dir)  # warm-up
        results[name] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
