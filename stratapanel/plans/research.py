"""Whole studies over a user's own daily prices.

Each function takes long frames ``prices(date, ticker, close)`` and
``benchmark(date, close)`` and returns named DataFrames.  The suite writes its
scores, positions, ledger and returns (small, but costly to make) once to the
shared folder; all reports on top stay lazy.  Weightings and score models are plain functions and
can be replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators import (
    attribution as A, capacity as K, crosssection as C, ledger as L, metrics as M, models as ML,
    robustness as X, timeseries as T, universe as U, weights as W,
)
from stratapanel.session import stored

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """Study parameters with their published defaults."""

    top_n: int = 5
    cost_bps: float = 10.0
    max_weight: float = 0.40
    risk_free_rate: float = 0.0
    lookback_days: int = 252
    minimum_train_months: int = 36
    strict: bool = True


def model_scorer(config: Config = Config(), setting: ML.Setting = ML.Setting()) -> Scorer:
    """Walk-forward boosting scores for every eligible month."""
    def score(dataset: DataFrame) -> DataFrame:
        cutoffs = U.cutoff_eligibility(dataset, config.minimum_train_months).where("eligible").select("prediction_date")
        return ML.walk_forward_scores(dataset, cutoffs, (setting,)).drop("candidate")

    return score


# Name -> (lookback, skip, weighting); fixed strategy definitions.
MOMENTUM = {
    "momentum_3m_equal": (3, 0, "equal"),
    "momentum_12_1_equal": (12, 1, "equal"),
    "momentum_max_sharpe": (3, 0, "max_sharpe"),
    "momentum_min_vol": (3, 0, "min_vol"),
}


def momentum_positions(prices: DataFrame, monthly: DataFrame, name: str, config: Config = Config()) -> DataFrame:
    lookback, skip, weighting = MOMENTUM[name]
    if weighting == "equal":
        return L.momentum_positions(monthly, lookback, skip, config.top_n, name, config.max_weight).withColumn(
            "optimization_status", F.lit(W.STATUS_EQUAL)
        )
    selected = L.momentum_selection(monthly, lookback, skip, config.top_n, name).drop("rank")
    return W.optimized_weights(
        selected, prices, weighting, config.max_weight, config.lookback_days, rf=config.risk_free_rate
    )


def strategy_suite(prices: DataFrame, benchmark: DataFrame, scorer: Scorer, config: Config = Config()) -> dict[str, DataFrame]:
    """Positions, ledger, scores and common-period returns of all strategies."""
    monthly, bench_monthly = T.last_observation_by_month(prices), T.last_observation_by_month(benchmark)
    dataset = T.labelled_dataset(monthly, bench_monthly)
    scores = stored(scorer(dataset), "scores")
    positions = L.score_positions(scores, config.top_n, "ml").withColumn("optimization_status", F.lit(W.STATUS_EQUAL))
    for name in MOMENTUM:
        positions = positions.unionByName(momentum_positions(prices, monthly, name, config))
    positions = stored(positions, "positions")
    status = positions.groupBy("strategy", "signal_date").agg(F.max("optimization_status").alias("optimization_status"))
    ledger = L.periods(positions.drop("optimization_status"), cost_bps=config.cost_bps, strict=config.strict).join(
        status, ["strategy", "signal_date"]
    )
    ledger = stored(ledger, "ledger")
    bench = T.benchmark_returns(bench_monthly)
    own = bench.where(F.col("bench").isNotNull()).select(F.lit("benchmark").alias("strategy"), "date", F.col("bench").alias("ret"))
    common = M.common_period(L.net_returns(ledger).unionByName(own), len(MOMENTUM) + 2)
    common = stored(common, "common")
    return {"dataset": dataset, "scores": scores, "positions": positions, "ledger": ledger, "bench": bench, "common": common}


def research_report(suite: dict[str, DataFrame], config: Config = Config()) -> dict[str, DataFrame]:
    """Performance, risk, concentration, attribution and ranking reports."""
    common, positions, ledger, scores = (suite[k] for k in ("common", "positions", "ledger", "scores"))
    names = sorted([*MOMENTUM, "ml"])
    series = A.concentration(positions)
    return {
        "performance": M.performance_report(common, [*names, "benchmark"]),
        "diagnostics": L.diagnostics(ledger),
        "yearly": M.yearly_analysis(common, names),
        "rolling": M.rolling_risk(common),
        "drawdowns": M.drawdown_episodes(common),
        "concentration": A.concentration_summary(series),
        "attribution": A.contribution_by_ticker(positions, ledger),
        "ranking": C.ranking_summary(scores, config.top_n, strict=config.strict),
        "ranking_series": C.stability_rolling(C.monthly_metrics(scores, n=config.top_n)),
    }


def robustness_report(
    suite: dict[str, DataFrame], prices: DataFrame, periods: list[tuple[str, str, str]], simulations: int = 5000,
    seed: int = 42, cost_levels=(0, 5, 10, 25, 50, 100), config: Config = Config(),
) -> dict[str, DataFrame]:
    """Cost, delay, sub-period, rolling, bootstrap, outlier and stability studies."""
    common, positions, ledger, bench = (suite[k] for k in ("common", "positions", "ledger", "bench"))
    dates = F.broadcast(common.select("date").distinct())  # one row per month
    kept = ledger.join(dates, "date", "left_semi")
    moved = L.delayed_positions(positions.drop("optimization_status"), T.last_observation_by_month(prices)).drop("execution_date")
    late = L.net_returns(L.periods(moved, cost_bps=config.cost_bps, strict=config.strict))
    costs = X.cost_sensitivity(L.with_costs(kept, cost_levels), bench)
    sub = M.subperiod_performance(common, periods)
    rolling = M.rolling_robustness(common)
    paths = X.bootstrap_paths(common, simulations, (3, 6, 12), seed)
    stability = A.weight_stability(positions, ledger)
    return {
        "costs": costs, "cost_breakpoints": X.cost_breakpoints(costs),
        "execution": X.execution_sensitivity(X.aligned_pair(L.net_returns(kept), late, bench)),
        "subperiods": sub, "subperiod_stability": M.subperiod_stability(sub),
        "rolling": rolling, "rolling_summary": M.rolling_summary(rolling),
        "bootstrap": X.bootstrap_summary(paths, M.evaluate(M.benchmark_column(common))),
        "outliers": M.outlier_diagnostics(common), "outlier_counterfactuals": M.outlier_counterfactuals(common),
        "contribution": A.contribution_concentration(positions.join(dates, "date", "left_semi")),
        "weight_stability": stability, "weight_stability_summary": A.stability_summary(stability),
        "ticker_stability": A.ticker_stability(positions),
    }


def leave_one_out(
    prices: DataFrame, benchmark: DataFrame, runner: Callable[[DataFrame, DataFrame], DataFrame], removed: list[str],
) -> DataFrame:
    """Ledgers of arbitrary re-runs, for a model refitted in each universe: one
    run per listed ticker, unioned (the one loop over studies in this library).

    Momentum and percentile scores use ``scenarios.rerun_ledger``: one plan.
    """
    out = None
    for ticker in removed:
        part = runner(prices.where(F.col("ticker") != ticker), benchmark).withColumn("removed_ticker", F.lit(ticker))
        out = part if out is None else out.unionByName(part)
    return out


def capacity_report(
    suite: dict[str, DataFrame], bars: DataFrame, liquidity: DataFrame, config: K.ExecutionConfig = K.ExecutionConfig()
) -> dict[str, DataFrame]:
    """``bars(date, ticker, open, close)``, ``liquidity(date, ticker, raw_close, volume)``."""
    adv = T.average_dollar_volume(liquidity, config.adv_window)
    schedule = K.paired_schedule(suite["positions"], bars, adv, len(MOMENTUM) + 1)
    trades = K.capacity_trades(K.timed_positions(suite["positions"], schedule, bars), adv, config)
    ledger = K.capacity_periods(trades)
    summary = K.capacity_summary(trades, ledger, config)
    return {
        "schedule": schedule, "trades": trades, "periods": ledger, "summary": summary,
        "ceilings": K.capacity_ceilings(trades, config), "timing": K.timing_comparison(summary),
    }
