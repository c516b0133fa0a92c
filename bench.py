"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

``panels`` builds every shared panel from the raw tables; each later query is
timed to its full result (the rows are materialised by a no-op sink), with
whatever shared frames earlier queries already wrote.  ``cold_suite`` repeats
the strategy suite from the raw tables with nothing shared.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from stratapanel.operators import models as ML, robustness as X
from stratapanel.plans import bindings as B, model_queries as MQ, report_queries as RQ
from stratapanel.plans.catalog import QUERIES
from stratapanel.session import local_session

HEADLINES = (
    "b3_strategy_suite", "a10_common_period_report", "a17_rolling_risk", "a20_drawdown_episodes",
    "a24_contribution_concentration", "a25_contribution_counterfactuals", "a32_cost_sensitivity",
    "a33_execution_sensitivity", "a34_leave_one_out", "c1_rank_ic", "c5_quantile_returns", "c9_sector_exposure",
    "c14_signal_decay", "b9_topn_sensitivity", "b16_capacity_summary", "b17_capacity_ceilings", "r4_momentum_signals",
    "b12_trade_ledger", "q9_all_flags", "q14_merge_incremental", "q21_investability", "j1_interval_join",
    "f9_factor_table", "f12_labelled_dataset", "w2_capped_simplex", "w6_max_sharpe", "m1_training_rows", "j16_scorecard",
)


def full(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stratapanel-bench")
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    spark.read.parquet(f"{folder}/lineitem.parquet").agg(F.sum("l_quantity")).collect()  # start the JVM side
    timed("cold_suite", lambda: full(QUERIES["b3_strategy_suite"](spark, folder)))
    B.release(spark)
    timed("panels", lambda: [f(spark, folder) for f in (B.brand, B.supplier, B.nation_days, B.region_days, B.market, B.benchmark)])
    for name in HEADLINES:
        timed(name, lambda: full(QUERIES[name](spark, folder)))
    timed("bootstrap_5000x3_blocks", lambda: full(X.bootstrap_summary(X.bootstrap_paths(B.common(spark, folder), 5000, RQ.BLOCKS, RQ.SEED))))
    timed("walk_forward_model", lambda: full(ML.walk_forward_scores(B.brand_dataset(spark, folder), MQ.brand_cutoffs(spark, folder), (MQ.BASE,))))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
