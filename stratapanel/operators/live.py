"""As-of tables: current signals, target portfolios, paper ledger, flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import attach
from stratapanel.operators.ledger import one_way_cost, periods
from stratapanel.operators.ranking import ranked_together, top_n
from stratapanel.operators.timeseries import benchmark_returns, calendar, change, on_calendar, outcomes
from stratapanel.session import stored


def momentum_now(monthly: DataFrame, tickers: DataFrame) -> DataFrame:
    """Both momentum signals at the last session with ranks, NULL last.

    Reads three sessions per ticker; securities missing at the end stay NULL.
    """
    sessions = calendar(monthly)
    last = sessions.agg(F.max("t").alias("_t"), F.max("date").alias("signal_date"))
    keyed = attach(on_calendar(monthly, sessions), last)
    back = F.col("_t") - F.col("t")
    at = lambda k: F.max(F.when(back == k, F.col("close")))
    agg = keyed.where(back.isin(0, 1, 3, 12)).groupBy("ticker").agg(
        (F.try_divide(at(0), at(3)) - 1.0).alias("momentum_3m"),
        (F.try_divide(at(1), at(12)) - 1.0).alias("momentum_12_1"),
    )
    out = attach(tickers.select("ticker").join(agg, "ticker", "left"), last.select("signal_date"))
    both = {"momentum_3m": "rank_3m", "momentum_12_1": "rank_12_1"}
    return ranked_together(out, ("signal_date",), both, "row", descending=True).select(
        "ticker", "signal_date", "momentum_3m", "rank_3m", "momentum_12_1", "rank_12_1"
    )


def momentum_signals(monthly: DataFrame, tickers: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Signals with validity and reason; ranks only where the signal exists."""
    rows = momentum_now(monthly, tickers).join(
        eligibility.select("ticker", "eligible", "reason"), "ticker", "left"
    )
    valid = F.col("momentum_3m").isNotNull() & F.col("momentum_12_1").isNotNull() & F.coalesce("eligible", F.lit(False))
    return rows.select(
        "ticker", "signal_date", "momentum_3m",
        F.when(F.col("momentum_3m").isNotNull(), F.col("rank_3m")).alias("rank_3m"), "momentum_12_1",
        F.when(F.col("momentum_12_1").isNotNull(), F.col("rank_12_1")).alias("rank_12_1"),
        valid.alias("signal_valid"),
        F.coalesce("reason", F.when(~valid, F.lit("missing_momentum_history"))).alias("invalid_reason"),
    )


def replay_signals(monthly: DataFrame, start: str, end: str) -> DataFrame:
    """Both signals and ranks as each month end in a range would have seen them.

    Signals only look back, so the as-of date is just the signal's own date: a
    whole replay is one plan over the panel instead of one truncation per date.
    """
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    sessions, missing = calendar(monthly), F.lit(None).cast("double")
    # Both come from one sort by security; the second is read a session before its date, so a security missing at the date keeps it.
    signals = F.array(
        F.struct("t", F.col("_3").alias("momentum_3m"), missing.alias("momentum_12_1")),
        F.struct((F.col("t") + 1).alias("t"), missing.alias("momentum_3m"), F.col("_11").alias("momentum_12_1")))
    rows = (
        on_calendar(monthly, sessions).select("ticker", "t", change("close", 3).alias("_3"), change("close", 11).alias("_11"))
        .select("ticker", F.inline(signals)).where("momentum_3m IS NOT NULL OR momentum_12_1 IS NOT NULL")
        .join(F.broadcast(sessions.where(inside).select("t", "date")), "t")
        .groupBy("date", "ticker").agg(F.max("momentum_3m").alias("momentum_3m"), F.max("momentum_12_1").alias("momentum_12_1"))
    )
    both = {"momentum_3m": "rank_3m", "momentum_12_1": "rank_12_1"}
    rows = ranked_together(rows, ("date",), both, "row", descending=True).drop("rank_3m_size", "rank_12_1_size")
    known = {rank: F.when(F.col(signal).isNotNull(), F.col(rank)) for signal, rank in both.items()}
    return rows.withColumns(known).withColumnRenamed("date", "as_of")


def eligibility_intervals(panel: DataFrame, stale_days: int = 7) -> DataFrame:
    """(ticker, first, last): spans of days on which a security's latest price is at most ``stale_days`` old.

    One row per change: observations close enough together are one span.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    seen = panel.where(F.col("close").isNotNull()).select("ticker", "date")
    opens = F.coalesce(F.datediff("date", F.lag("date").over(w)) > stale_days + 1, F.lit(True))
    spans = seen.withColumn("_span", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("ticker", "_span").agg(F.min("date").alias("first"), F.date_add(F.max("date"), stale_days).alias("last")).drop("_span")


def eligible_as_of(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """(as_of, ticker) of each as-of date inside a span; the dates travel as one short array."""
    listed = dates.agg(F.sort_array(F.collect_set("as_of"))).scalar()
    inside = F.filter("_dates", lambda d: d.between(F.col("first"), F.col("last")))
    return intervals.withColumn("_dates", listed).withColumn("as_of", F.explode(inside)).select("as_of", "ticker").distinct()


def replay_decisions(monthly: DataFrame, scores: DataFrame, start: str, end: str, n: int = 5, stale_days: int = 7) -> DataFrame:
    """What every month end in a range would have decided, with the outcome it could not see.

    One plan for all as-of dates: eligibility from spans, signals that only look
    back, scores of walk-forward models, equal weights for the ``n`` best valid
    names.  (strategy, as_of, next_as_of, ticker, rank, target_weight,
    asset_return, eligible_securities); the last date has no outcome.
    """
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    sessions = calendar(monthly)
    # Read three times.
    eligible = stored(eligible_as_of(eligibility_intervals(monthly, stale_days), sessions.where(inside).select(F.col("date").alias("as_of"))), "eligible")
    breadth = eligible.groupBy("as_of").agg(F.count(F.lit(1)).alias("eligible_securities"))
    signals = replay_signals(monthly, start, end).where("momentum_3m IS NOT NULL AND momentum_12_1 IS NOT NULL").join(eligible, ["as_of", "ticker"], "left_semi")
    both = F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(rank).cast("bigint").alias("rank")) for name, rank in (("momentum_3m_equal", "rank_3m"), ("momentum_12_1_equal", "rank_12_1"))])
    momentum_ranks = signals.select("as_of", "ticker", F.inline(both))
    allowed = scores.where(inside & F.col("ml_score").isNotNull()).withColumnRenamed("date", "as_of").join(eligible, ["as_of", "ticker"], "left_semi")
    best = top_n(allowed.select("as_of", "ticker", "ml_score"), ("as_of",), "ml_score", n).select("as_of", "ticker", F.lit("ml").alias("strategy"), F.col("rank").cast("bigint").alias("rank"))
    ranks = momentum_ranks.unionByName(best)
    w = Window.partitionBy("strategy", "as_of")
    chosen = ranks.withColumn("_nth", F.row_number().over(w.orderBy("rank", "ticker"))).where(F.col("_nth") <= n).drop("_nth")
    # ``n`` rows per strategy and date: only these names' outcomes are worked out.
    chosen = stored(chosen.withColumn("target_weight", 1.0 / F.count(F.lit(1)).over(w)), "chosen")
    held = monthly.join(chosen.select("ticker").distinct(), "ticker", "left_semi")
    later = outcomes(held, sessions).select(F.col("date").alias("as_of"), "ticker", F.col("next_date").alias("next_as_of"), "asset_return")
    out = chosen.join(later, ["as_of", "ticker"], "left").join(breadth, "as_of")
    # A realisation lies inside the replay too.
    seen = F.col("next_as_of") <= F.lit(end).cast("date")
    return out.select(
        "strategy", "as_of", F.when(seen, F.col("next_as_of")).alias("next_as_of"), "ticker", "rank", "target_weight",
        F.when(seen, F.col("asset_return")).alias("asset_return"), "eligible_securities")


def replay_evaluation(decisions: DataFrame, benchmark: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Each decision's frozen weights evaluated at the next as-of date, compounded; costs are those of the decision."""
    positions = decisions.where("next_as_of IS NOT NULL").select(
        "strategy", F.col("as_of").alias("signal_date"), F.col("next_as_of").alias("date"), "ticker", F.col("target_weight").alias("weight"), "asset_return")
    led = periods(positions, cost_bps=cost_bps, strict=False).join(F.broadcast(benchmark_returns(benchmark)), "date")
    net, bench = F.col("net_return"), F.col("bench")
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return led.select(
        "strategy", "signal_date", F.col("date").alias("realization_date"), "gross_return", "transaction_cost", "net_return", bench.alias("benchmark_return"),
        (net - bench).alias("active_return"), F.product(1.0 + net).over(w).alias("portfolio_value"), F.product(1.0 + bench).over(w).alias("benchmark_value"))


def target_portfolios(rankings: DataFrame, n: int) -> DataFrame:
    """Equal-weight targets from ``(strategy, signal_date, ticker, rank)``."""
    w = Window.partitionBy("strategy").orderBy("rank", "ticker")
    chosen = rankings.where(F.col("rank").isNotNull()).withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= n
    )
    g = Window.partitionBy("strategy")
    return chosen.select(
        "strategy", "signal_date", "ticker", (1.0 / F.count(F.lit(1)).over(g)).alias("target_weight"),
        F.col("rank").alias("rank_or_reason"), F.lit("equal").alias("optimization_status"),
    )


def pretrade_weights(previous: DataFrame, prices: DataFrame, current: Column) -> DataFrame:
    """Earlier targets drifted to the current date by price relatives."""
    now = prices.where(F.col("date") == current).select("ticker", F.col("close").alias("_now"))
    then = prices.select("ticker", F.col("date").alias("signal_date"), F.col("close").alias("_then"))
    rows = previous.join(then, ["ticker", "signal_date"]).join(now, "ticker")
    value = F.col("target_weight") * F.try_divide("_now", "_then")
    g = Window.partitionBy("strategy")
    return rows.select("strategy", "ticker", (value / F.sum(value).over(g)).alias("pretrade_weight"))


def _both_sides(targets: DataFrame, pretrade: DataFrame) -> DataFrame:
    t = targets.select("strategy", "ticker", "target_weight")
    p = pretrade.select("strategy", "ticker", "pretrade_weight")
    zero = F.lit(0.0)
    return t.join(p, ["strategy", "ticker"], "full_outer").select(
        "strategy", "ticker", F.coalesce("target_weight", zero).alias("target_weight"),
        F.coalesce("pretrade_weight", zero).alias("pretrade_weight"),
        F.col("pretrade_weight").isNotNull().alias("_old"), F.col("target_weight").isNotNull().alias("_new"),
    )


def portfolio_summary(targets: DataFrame, pretrade: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """Breadth, top weights, turnover and cost per strategy."""
    w = F.col("target_weight")
    r = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("target_weight"), "ticker"))
    agg = _both_sides(targets, pretrade).withColumn("_r", r).groupBy("strategy").agg(
        F.count(F.when(w > 1e-10, 1)).alias("number_holdings"), F.try_divide(F.lit(1.0), F.sum(w * w)).alias("effective_holdings"),
        F.max(w).alias("max_weight"), F.sum(F.when(F.col("_r") <= 3, w)).alias("top3_weight"),
        F.when(F.bool_or("_old"), F.sum(F.abs(w - F.col("pretrade_weight"))) / 2.0).otherwise(1.0).alias("estimated_turnover_vs_previous"),
        F.when(F.bool_or("_old"), "rebalance").otherwise("initial_deployment").alias("deployment_status"),
        F.bool_or("_new").alias("_any"),
    ).where("_any").drop("_any")
    status = targets.groupBy("strategy").agg(F.max("optimization_status").alias("optimization_status"))
    return agg.withColumn(
        "estimated_transaction_cost", one_way_cost(F.col("estimated_turnover_vs_previous"), cost_bps)
    ).join(status, "strategy")


def trade_ledger(targets: DataFrame, pretrade: DataFrame, summary: DataFrame) -> DataFrame:
    """Signed trades; the strategy cost is shared out by absolute trade."""
    rows = _both_sides(targets, pretrade).withColumn("trade_weight", F.col("target_weight") - F.col("pretrade_weight"))
    size = F.abs("trade_weight")
    total = F.sum(size).over(Window.partitionBy("strategy"))
    return rows.join(F.broadcast(summary.select("strategy", "estimated_transaction_cost")), "strategy").select(
        "strategy", "ticker", "pretrade_weight", "target_weight", "trade_weight",
        F.when(total > 0, F.col("estimated_transaction_cost") * size / total).otherwise(0.0).alias("estimated_transaction_cost"),
    )


def recommendations(targets: DataFrame, ledger: DataFrame, prices: DataFrame) -> DataFrame:
    quote = prices.select("ticker", F.col("date").alias("signal_date"), F.col("close").alias("reference_price"))
    cost = ledger.select("strategy", "ticker", F.col("estimated_transaction_cost").alias("estimated_cost"))
    return targets.select("strategy", "signal_date", "ticker", "target_weight").join(
        quote, ["ticker", "signal_date"], "left"
    ).join(cost, ["strategy", "ticker"], "left").select(
        "strategy", "signal_date", "ticker", "target_weight", "reference_price",
        F.coalesce("estimated_cost", F.lit(0.0)).alias("estimated_cost"),
        F.lit("research_reference_price_not_execution_fill").alias("status"),
    )


def frozen_evaluation(decisions: DataFrame, prices: DataFrame, benchmark: DataFrame, realization: DataFrame) -> DataFrame:
    """Realised result of frozen weights between two dates, compounded.

    ``decisions``: (strategy, signal_date, ticker, target_weight, estimated_cost);
    ``realization``: (signal_date, realization_date), one row per decision date.
    """
    p = prices.select("ticker", "date", "close")
    a = p.select("ticker", F.col("date").alias("signal_date"), F.col("close").alias("_a"))
    b = p.select("ticker", F.col("date").alias("realization_date"), F.col("close").alias("_b"))
    rows = decisions.join(F.broadcast(realization), "signal_date").join(a, ["ticker", "signal_date"], "left").join(
        b, ["ticker", "realization_date"], "left"
    )
    g = rows.groupBy("strategy", "signal_date", "realization_date").agg(
        F.when(F.count("_a") + F.count("_b") == 2 * F.count(F.lit(1)),
               F.sum(F.col("target_weight") * (F.try_divide("_b", "_a") - 1.0))).alias("gross_return"),
        F.sum("estimated_cost").alias("transaction_cost"),
    )
    ba = benchmark.select(F.col("date").alias("signal_date"), F.col("close").alias("_ba"))
    bb = benchmark.select(F.col("date").alias("realization_date"), F.col("close").alias("_bb"))
    out = g.join(F.broadcast(ba), "signal_date").join(F.broadcast(bb), "realization_date")
    net = F.col("gross_return") - F.col("transaction_cost")
    bench = F.try_divide("_bb", "_ba") - 1.0
    w = Window.partitionBy("strategy").orderBy("realization_date").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        "strategy", "signal_date", "realization_date", "gross_return", "transaction_cost", net.alias("net_return"),
        bench.alias("benchmark_return"), (net - bench).alias("active_return"),
        F.product(1.0 + net).over(w).alias("portfolio_value"), F.product(1.0 + bench).over(w).alias("benchmark_value"),
    )


def consensus(portfolios: DataFrame, signals: DataFrame, predictions: DataFrame, strategies: dict[str, str], weights: dict[str, str]) -> DataFrame:
    """Who selects each ticker, and its mean normalised rank.

    ``strategies`` maps a flag column to a strategy, ``weights`` a weight column.
    """
    held = portfolios.groupBy("ticker").agg(
        *[F.bool_or(F.col("strategy") == s).alias(c) for c, s in strategies.items()],
        *[F.max(F.when(F.col("strategy") == s, F.col("target_weight"))).alias(c) for c, s in weights.items()],
        F.count_distinct("strategy").alias("_n"),
    )
    ranks = signals.select("ticker", "rank_3m", "rank_12_1").join(
        predictions.select("ticker", "ml_rank"), "ticker", "full_outer"
    )
    names = ("rank_3m", "rank_12_1", "ml_rank")
    top = ranks.agg(*[F.max(n).alias(f"_m{n}") for n in names])
    scaled = [F.try_divide(F.col(n), F.col(f"_m{n}")) for n in names]
    known = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in scaled[1:]), F.when(scaled[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scaled[1:]), F.coalesce(scaled[0], F.lit(0.0)))
    return attach(ranks, top).join(held, "ticker", "left").select(
        "ticker", *[F.coalesce(c, F.lit(False)).alias(c) for c in strategies],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in weights],
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("number_strategies_selecting_or_holding"),
        F.try_divide(total, known).alias("average_normalized_rank"),
    )


def cross_summary(rankings: DataFrame, momentum: DataFrame, n: int) -> DataFrame:
    hit = lambda c: F.coalesce((F.col(c) <= n).cast("int"), F.lit(0))
    return rankings.join(momentum.drop("signal_date"), "ticker", "left").withColumn(
        "consensus_count", hit("ml_rank") + hit("rank_3m") + hit("rank_12_1")
    )


@dataclass(frozen=True)
class FlagThresholds:
    high_single_name_weight: float = 0.35
    low_effective_holdings: float = 3.5
    high_turnover: float = 0.75
    model_score_range_low: float = 0.10
    historical_top1_contribution_high: float = 0.25


def risk_flags(
    summary: DataFrame, eligibility: DataFrame, signals: DataFrame, predictions: DataFrame,
    contribution: DataFrame | None = None, limits: FlagThresholds = FlagThresholds(),
) -> DataFrame:
    """(scope, flag, value, threshold) rules over five small tables, unioned.

    Values and thresholds are text because some rules compare statuses.
    """
    def rule(condition, name, value, threshold):
        return F.when(condition, F.struct(
            F.lit(name).alias("flag"), value.cast("string").alias("value"), F.lit(str(threshold)).alias("threshold")
        ))

    def emit(df, scope, *rules):
        return df.select(scope.alias("scope"), F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))

    number = lambda c: F.format_number(F.col(c), 6)
    status = F.col("optimization_status")
    parts = [
        emit(
            summary, F.col("strategy"),
            rule(F.col("max_weight") >= limits.high_single_name_weight, "HIGH_SINGLE_NAME_WEIGHT", number("max_weight"), limits.high_single_name_weight),
            rule(F.col("effective_holdings") < limits.low_effective_holdings, "LOW_EFFECTIVE_HOLDINGS", number("effective_holdings"), limits.low_effective_holdings),
            rule(F.col("estimated_turnover_vs_previous") > limits.high_turnover, "HIGH_TURNOVER", number("estimated_turnover_vs_previous"), limits.high_turnover),
            rule(F.startswith(status, F.lit("fallback_equal:")), "OPTIMIZER_FALLBACK", status, "optimized"),
        ),
        emit(
            eligibility.where(~F.col("eligible")), F.col("ticker"),
            rule(F.col("reason") == "stale_price", "STALE_MARKET_DATA", F.col("staleness_days"), 7),
            rule(F.col("reason") != "stale_price", "MISSING_SIGNAL", F.col("staleness_days"), 7),
        ),
        emit(
            signals.where(~F.col("signal_valid")), F.col("ticker"),
            rule(F.lit(True), "MISSING_SIGNAL", F.col("invalid_reason"), "valid"),
        ),
        emit(
            predictions.agg((F.max("ml_score") - F.min("ml_score")).alias("r")), F.lit("ml"),
            rule(F.col("r") < limits.model_score_range_low, "MODEL_SCORE_CONCENTRATION", number("r"), limits.model_score_range_low),
        ),
    ]
    if contribution is not None:
        parts.append(emit(
            contribution, F.col("strategy"),
            rule(F.col("top_1_share") > limits.historical_top1_contribution_high,
                 "HIGH_HISTORICAL_CONTRIBUTION_DEPENDENCE", number("top_1_share"), limits.historical_top1_contribution_high),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
