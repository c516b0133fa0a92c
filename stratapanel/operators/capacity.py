"""Execution timing, liquidity and capacity diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import attach, checked, count_if, message_if, share_if
from stratapanel.operators.ledger import trades, turnover_from_trades
from stratapanel.operators.metrics import performance
from stratapanel.operators.quality import duplicates, require_columns
from stratapanel.operators.timeseries import calendar, session_grid

DUST = 1e-12
SAME_CLOSE, NEXT_OPEN = "same_close_diagnostic", "next_session_open"


@dataclass(frozen=True)
class ExecutionConfig:
    """Assumptions of the capacity scenarios."""

    aums: tuple[float, ...] = (100_000.0, 1_000_000.0, 10_000_000.0, 50_000_000.0, 100_000_000.0)
    adv_window: int = 20
    spread_bps: float = 5.0
    impact_bps: float = 10.0
    reference_participation: float = 0.01
    limits: tuple[float, ...] = (0.01, 0.05, 0.10)

    def __post_init__(self):
        for values in (self.aums, self.limits):
            if not values or len(set(values)) != len(values) or any(not 0 < v < float("inf") for v in values):
                raise ValueError("Scenario values must be positive, finite and unique.")
        if max(self.limits) > 1:
            raise ValueError("Participation limits must be at most one.")
        if not (0 <= self.spread_bps < float("inf") and 0 <= self.impact_bps < float("inf")):
            raise ValueError("Cost assumptions must be finite and non-negative.")
        if not 0 < self.reference_participation < float("inf") or self.adv_window < 1:
            raise ValueError("Reference participation and window must be positive.")


def execution_prices(panel: DataFrame) -> DataFrame:
    """(date, ticker, close, open): Open aligned to the Close cells."""
    require_columns(panel, "date", "ticker", "open", "close")
    return panel.where(F.col("close").isNotNull()).select("date", "ticker", "close", "open")


def execution_price_violations(panel: DataFrame) -> DataFrame:
    return duplicates(panel, "date", "ticker")


def liquidity_on_sessions(panel: DataFrame, sessions: DataFrame, tickers: DataFrame) -> DataFrame:
    """Raw close and volume on the execution sessions x tickers, missing NULL."""
    require_columns(panel, "date", "ticker", "raw_close", "volume")
    return session_grid(tickers, sessions).join(
        panel.select("date", "ticker", "raw_close", "volume"), ["date", "ticker"], "left"
    )


def paired_schedule(positions: DataFrame, panel: DataFrame, adv: DataFrame, strategies: int, strict: bool = True) -> DataFrame:
    """Shared signals with entry and exit sessions, or the exclusion reason.

    ``strict`` fails the job without a complete liquidity window, with fewer
    than two kept periods, or where a kept period does not start at the end of
    the one before.  All tables here have one row per session.
    """
    cal = calendar(panel).select("date", F.col("next_date").alias("_next"))
    shared = positions.select("strategy", "signal_date", "date").distinct().groupBy("signal_date").agg(
        F.count_distinct("strategy").alias("_n"), F.min("date").alias("realization_date"),
        F.count_distinct("date").alias("_ends"),
    ).where(F.col("_n") == strategies)
    names = panel.agg(F.count_distinct("ticker").alias("_all"))
    ready = attach(adv.groupBy("date").agg(F.count("adv").alias("_ok")), names).where(
        F.col("_ok") >= F.col("_all")
    ).agg(F.min("date").alias("_start"))
    dated = (
        shared.join(F.broadcast(cal.select(F.col("date").alias("signal_date"), F.col("_next").alias("next_entry"))), "signal_date", "left")
        .join(F.broadcast(cal.select(F.col("date").alias("realization_date"), F.col("_next").alias("next_exit"))), "realization_date", "left")
    )
    out = attach(dated, ready)
    reason = (
        F.when(F.col("_ends") > 1, F.raise_error(F.lit("Strategy realization dates disagree")))
        .when(F.col("_start").isNull() | (F.col("signal_date") < F.col("_start")), "before_complete_liquidity_history")
        .when(F.col("next_entry").isNull() | F.col("next_exit").isNull(), "terminal_next_session_unavailable")
    )
    schedule = out.select("signal_date", "realization_date", "next_entry", "next_exit", reason.alias("reason"))
    if not strict:
        return schedule
    schedule = checked(schedule, ready.where(F.col("_start").isNull()), "INSUFFICIENT_LIQUIDITY_HISTORY: no complete ADV window")
    return checked_schedule(schedule)


def checked_schedule(schedule: DataFrame) -> DataFrame:
    """``schedule``, failing on fewer than two kept periods and on a gap between kept periods."""
    few = schedule.agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("_kept")).where("_kept < 2")
    out = checked(schedule, few, "INSUFFICIENT_PAIRED_EXECUTION_PERIODS")
    return checked(out, schedule_violations(schedule), "NONCONTIGUOUS_PAIRED_SCHEDULE: cannot skip holding periods")


def schedule_violations(schedule: DataFrame) -> DataFrame:
    """Kept periods that do not start where the previous one ended."""
    w = Window.orderBy("signal_date")
    kept = schedule.where(F.col("reason").isNull())
    return kept.withColumn("previous_end", F.lag("realization_date").over(w)).where(
        F.col("previous_end") != F.col("signal_date")
    ).withColumn("violation", F.lit("NONCONTIGUOUS_PAIRED_SCHEDULE"))


def timed_positions(positions: DataFrame, schedule: DataFrame, panel: DataFrame) -> DataFrame:
    """Targets re-priced under both timings; the timing is a key column."""
    kept = schedule.where(F.col("reason").isNull()).select("signal_date", F.inline(F.array(
        F.struct(F.lit(SAME_CLOSE).alias("timing"), F.col("signal_date").alias("execution_date"), F.col("realization_date").alias("valuation_date")),
        F.struct(F.lit(NEXT_OPEN).alias("timing"), F.col("next_entry").alias("execution_date"), F.col("next_exit").alias("valuation_date")),
    )))
    quotes = panel.select("date", "ticker", F.inline(F.array(
        F.struct(F.lit(SAME_CLOSE).alias("timing"), F.col("close").alias("price")),
        F.struct(F.lit(NEXT_OPEN).alias("timing"), F.col("open").alias("price")),
    )))
    entry = quotes.select("timing", "ticker", F.col("date").alias("execution_date"), F.col("price").alias("_a"))
    leave = quotes.select("timing", "ticker", F.col("date").alias("valuation_date"), F.col("price").alias("_b"))
    # Broadcast: two rows per scheduled session.
    rows = positions.where(F.col("weight") > 0).select("strategy", "signal_date", "ticker", "weight").join(
        F.broadcast(kept), "signal_date"
    ).join(entry, ["timing", "ticker", "execution_date"], "left").join(leave, ["timing", "ticker", "valuation_date"], "left")
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") <= 0) | (F.col("_b") <= 0)
    ret = message_if(bad, "MISSING_EXECUTION_PRICE", F.try_divide("_b", "_a") - 1.0)
    return rows.select(
        "strategy", "timing", "signal_date", "execution_date", F.col("valuation_date").alias("date"), "ticker",
        "weight", ret.alias("asset_return"),
    )


def trade_diagnostics(moves: DataFrame, aum: Column, adv: Column, config: ExecutionConfig = ExecutionConfig()) -> DataFrame:
    """Trade size, ADV participation and assumed cost per name."""
    delta = F.col("target_weight") - F.col("pretrade_weight")
    trade = F.when(F.abs(delta) <= DUST, F.lit(0.0)).otherwise(delta)
    trading = F.abs(trade) > 0
    unusable = adv.isNull() | F.isnan(adv) | (adv <= 0) | (adv == float("inf"))
    used = message_if(trading & unusable, "INVALID_ADV for a trade", F.try_divide(aum * F.abs(trade), adv))
    out = moves.withColumn("trade_weight", trade).withColumn(
        "trade_as_pct_adv", F.when(trading, used).otherwise(0.0)
    )
    bps = config.spread_bps + config.impact_bps * F.sqrt(F.col("trade_as_pct_adv") / config.reference_participation)
    return out.withColumn("cost_bps_per_traded_dollar", bps).withColumn(
        "position_dollars", aum * F.col("target_weight")
    ).withColumn("trade_dollars", aum * F.col("trade_weight")).withColumn(
        "estimated_cost_dollars", aum * F.abs("trade_weight") * F.col("cost_bps_per_traded_dollar") / 10_000.0
    )


def capacity_trades(timed: DataFrame, adv: DataFrame, config: ExecutionConfig = ExecutionConfig()) -> DataFrame:
    """Trades of every (strategy, timing) path at every AUM level."""
    moves = trades(timed.drop("execution_date"), ("strategy", "timing"))
    priced = moves.join(adv.select(F.col("date").alias("signal_date"), "ticker", "adv"), ["signal_date", "ticker"], "left")
    keyed = priced.withColumn("aum", F.explode(F.array(*[F.lit(float(a)) for a in config.aums])))
    return trade_diagnostics(keyed, F.col("aum"), F.col("adv"), config)


def capacity_periods(capacity: DataFrame) -> DataFrame:
    """Ledger per (strategy, timing, aum, period)."""
    held = F.col("held")
    gross = F.sum(F.when(held, F.col("target_weight") * F.col("asset_return")))
    out = capacity.groupBy("strategy", "timing", "aum", "seq").agg(
        F.max("signal_date").alias("signal_date"), F.max("date").alias("valuation_date"), gross.alias("gross_return"),
        turnover_from_trades(F.col("seq")).alias("turnover"),
        (F.sum("estimated_cost_dollars") / F.max("aum")).alias("_cost"),
    )
    broke = F.col("_cost") >= 1.0 + F.col("gross_return")
    return out.select(
        "strategy", "timing", "aum", "seq", "signal_date", "valuation_date", "gross_return", "turnover",
        (F.col("gross_return") - F.col("turnover") * 0.001).alias("constant_10bps_return"),
        (F.col("_cost") * 10_000.0).alias("estimated_cost_bps"),
        message_if(broke, "Diagnostic costs exhaust capital", F.col("gross_return") - F.col("_cost")).alias("diagnostic_net_return"),
        (F.col("seq") == 1).alias("initial_deployment"),
    )


def capacity_summary(capacity: DataFrame, ledger: DataFrame, config: ExecutionConfig = ExecutionConfig()) -> DataFrame:
    keys = ["strategy", "timing", "aum"]
    p = F.col("trade_as_pct_adv")
    use = capacity.where(F.col("trade_weight") != 0).groupBy(*keys).agg(
        F.percentile(p, F.lit(0.5)).alias("median_trade_pct_adv"), F.percentile(p, F.lit(0.95)).alias("p95_trade_pct_adv"),
        F.max(p).alias("max_trade_pct_adv"),
        *[share_if(p > n / 100.0).alias(f"pct_trades_gt_{n}pct_adv") for n in (1, 5, 10)],
    )
    dated = ledger.withColumn("date", F.col("valuation_date"))
    net = performance(dated.withColumn("ret", F.col("diagnostic_net_return")), tuple(keys)).select(
        *keys, F.col("sharpe").alias("diagnostic_sharpe"), F.col("annual_return").alias("diagnostic_cagr")
    )
    flat = performance(dated.withColumn("ret", F.col("constant_10bps_return")), tuple(keys)).select(
        *keys, F.col("sharpe").alias("constant_10bps_sharpe")
    )
    base = ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.min("signal_date").alias("first_signal_date"),
        F.max("valuation_date").alias("last_valuation_date"), F.avg("estimated_cost_bps").alias("estimated_cost_bps"),
        (F.avg("turnover") * 12).alias("annualized_turnover"),
    )
    above = F.col("max_trade_pct_adv") > max(config.limits)
    return base.join(use, keys, "left").join(net, keys).join(flat, keys).withColumn(
        "capacity_flag",
        F.when(above, "above_largest_tested_limit").otherwise("within_largest_tested_limit_not_execution_assurance"),
    )


def capacity_ceilings(capacity: DataFrame, config: ExecutionConfig = ExecutionConfig()) -> DataFrame:
    """Largest AUM per participation limit and the trade that binds it."""
    one = capacity.where((F.col("aum") == config.aums[0]) & (F.col("trade_weight") != 0))
    keyed = one.withColumn("max_participation", F.explode(F.array(*[F.lit(float(x)) for x in config.limits])))
    bound = F.col("max_participation") * F.col("adv") / F.abs("trade_weight")
    return keyed.withColumn("_b", bound).groupBy("strategy", "timing", "max_participation").agg(
        F.min("_b").alias("diagnostic_aum_ceiling"),
        F.min_by(F.struct("ticker", "signal_date"), F.struct("_b", "ticker", "signal_date")).alias("_x"),
    ).select(
        "strategy", "timing", "max_participation", "diagnostic_aum_ceiling",
        F.col("_x.ticker").alias("binding_ticker"), F.col("_x.signal_date").alias("binding_signal_date"),
    )


def timing_comparison(summary: DataFrame) -> DataFrame:
    metrics = ("diagnostic_sharpe", "diagnostic_cagr", "constant_10bps_sharpe")
    cell = lambda m, t: F.max(F.when(F.col("timing") == t, F.col(m)))
    out = summary.groupBy("strategy", "aum").agg(
        *[cell(m, t).alias(f"{m}_{t}") for m in metrics for t in (NEXT_OPEN, SAME_CLOSE)]
    )
    return out.select("*", *[
        (F.col(f"{m}_{NEXT_OPEN}") - F.col(f"{m}_{SAME_CLOSE}")).alias(f"{m}_next_minus_same") for m in metrics
    ])
