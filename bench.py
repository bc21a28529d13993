"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query is warmed up once and its best of
three runs is reported; the long ones (files, runs over all layers, model selection) run once. Results are consumed
by the no-op sink, so nothing is collected. Only the queries of HEADLINE enter the total.
"""

from __future__ import annotations

import json
import os
import time

from voltlake.plans.catalogue import CATALOGUE
from voltlake.session import local_session

HEADLINE = (
    "gold_balance_hourly",
    "gold_balance_by_series",
    "bronze_consumption_b",
    "silver_quarter_hour",
    "duplicate_rank_per_key",
    "backfill_missing_hours",
    "project_forward",
    "positional_lags",
    "previous_known_values",
    "gold_market_hourly",
    "gold_cost_hourly",
    "deficit_training_rows",
    "balance_rollup_daily_by_series",
    "balance_analytics",
    "largest_imbalances",
    "cost_rollup_daily",
    "monthly_coverage",
    "monthly_drift",
    "check_balance_contract",
    "ranking_metrics",
    "stratified_holdout",
)
LONG = (
    "price_csv_header_discovery",
    "price_csv_fixed_preamble",
    "medallion_balance_run",
    "medallion_market_run",
    "cross_validated_logistic",
    "tree_grid_search",
    "deficit_forest_metrics",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    seconds = {}
    for name in (*HEADLINE, *LONG):
        times = []
        for _ in range(RUNS + 1 if name in HEADLINE else 1):
            start = time.perf_counter()
            CATALOGUE[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:] or times), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds[name] for name in HEADLINE), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
