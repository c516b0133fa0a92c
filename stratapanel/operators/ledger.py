"""Portfolio ledgers: selection, drift, turnover, costs and re-runs.

A ledger is positions ``(keys..., signal_date, date, ticker, weight,
asset_return)``.  Pre-trade weights depend only on the previous rebalance, so
nothing is recursive: each position emits ``+weight`` at its own rebalance and
``-drifted weight`` at the next, and turnover is a grouped sum.  A key's
positions number at most top_n x periods, and every later step keeps the same
partitioning: one shuffle in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import compound, count_if, message_if, share_if
from stratapanel.operators.ranking import top_n as best
from stratapanel.operators.timeseries import lagged, momentum, on_calendar, outcomes

MISSING_OUTCOME = "Missing next-period returns for selected assets"


def equal_weights(selected: DataFrame, keys=("signal_date",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    return selected.withColumn("weight", 1.0 / F.count(F.lit(1)).over(w))


def drifted(weight: Column, ret: Column, over) -> Column:
    """Weight after one holding period, renormalised."""
    value = weight * (1.0 + ret)
    return value / F.sum(value).over(over)


def one_way_cost(turnover: Column, bps: float | Column) -> Column:
    return turnover * bps / 10_000.0


def momentum_selection(monthly: DataFrame, lookback: int, skip: int, n: int, strategy: str) -> DataFrame:
    """Top-``n`` momentum names per signal date, with their later outcome.

    The outcome is attached before selection but never used by it.
    """
    signal = momentum(monthly, lookback, skip).where(F.col("next_date").isNotNull())
    return best(signal, ("date",), "momentum", n).select(
        F.lit(strategy).alias("strategy"), F.col("date").alias("signal_date"),
        F.col("next_date").alias("date"), "ticker", "rank", "asset_return",
    )


def momentum_positions(monthly: DataFrame, lookback=3, skip=0, n=5, strategy="momentum", max_weight: float = 0.40) -> DataFrame:
    selected = momentum_selection(monthly, lookback, skip, n, strategy)
    out = equal_weights(selected, ("strategy", "signal_date"))
    infeasible = F.col("weight") > max_weight + 1e-12
    return out.withColumn(
        "weight", message_if(infeasible, "Position cap is infeasible for the selected portfolio", F.col("weight"))
    ).drop("rank")


def score_positions(scores: DataFrame, n: int = 5, strategy: str = "ml", keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal-weight top-``n`` by score; fully unlabelled dates are skipped."""
    labelled = scores.where(F.col("future_return").isNotNull()).select(*keys, "date").distinct()
    selected = best(
        scores.join(F.broadcast(labelled), [*keys, "date"], "left_semi"), (*keys, "date"), "ml_score", n
    )
    target = F.max("target_date").over(Window.partitionBy(*keys, "date"))
    out = selected.select(
        F.lit(strategy).alias("strategy"), *keys, F.col("date").alias("signal_date"),
        target.alias("date"), "ticker", F.col("future_return").alias("asset_return"),
    )
    return equal_weights(out, ("strategy", *keys, "signal_date"))


def trades(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    """Per rebalance and name: target, pre-trade and outcome.

    ``seq`` counts emitted rebalances; sold names appear with target 0.
    """
    period = Window.partitionBy(*keys, "seq")
    numbered = positions.withColumn(
        "seq", F.dense_rank().over(Window.partitionBy(*keys).orderBy("signal_date"))
    ).withColumn("_end", F.sum(F.col("weight") * (1.0 + F.col("asset_return"))).over(period)).withColumn(
        "_known", F.count("asset_return").over(period) == F.count(F.lit(1)).over(period)
    )
    end = F.col("weight") * (1.0 + F.col("asset_return")) / F.col("_end")
    missing = F.lit(None).cast("double")
    moves = numbered.select(*keys, "ticker", F.inline(F.array(
        F.struct(
            F.col("seq"), F.col("weight").alias("target"), F.lit(0.0).alias("pre"),
            F.col("asset_return"), F.col("signal_date"), F.col("date"),
        ),
        F.struct(
            (F.col("seq") + 1).alias("seq"), F.lit(0.0).alias("target"),
            F.when(F.col("_known") & (F.col("_end") > 0), end).alias("pre"),
            missing.alias("asset_return"), F.lit(None).cast("date").alias("signal_date"),
            F.lit(None).cast("date").alias("date"),
        ),
    )))
    merged = moves.groupBy(*keys, "seq", "ticker").agg(
        F.sum("target").alias("target_weight"),
        # A NULL drift (unknown outcome before) stays NULL, it is not zero.
        F.when(F.count(F.lit(1)) == F.count("pre"), F.sum("pre")).alias("pretrade_weight"),
        F.max("asset_return").alias("asset_return"),
        F.max("signal_date").alias("_signal"), F.max("date").alias("_date"),
    )
    return merged.select(
        *keys, "seq", "ticker", "target_weight", "pretrade_weight", "asset_return",
        F.col("_signal").isNotNull().alias("held"),
        F.max("_signal").over(period).alias("signal_date"),
        F.max("_date").over(period).alias("date"),
    ).where(F.col("signal_date").isNotNull())


def turnover_from_trades(seq: Column) -> Column:
    """Half the absolute weight change; the first deployment counts as 1."""
    change = F.sum(F.abs(F.col("target_weight") - F.col("pretrade_weight"))) / 2.0
    known = F.count(F.lit(1)) == F.count("pretrade_weight")
    return F.when(F.max(seq) == 1, F.lit(1.0)).when(known, change)


def periods(positions: DataFrame, keys=("strategy",), cost_bps: float = 10.0, strict: bool = True) -> DataFrame:
    """One row per rebalance: gross, turnover, cost and net return.

    ``strict`` fails the job when a selected name has no outcome; otherwise the
    period is NULL.
    """
    held = F.col("held")
    unknown = held & F.col("asset_return").isNull()
    gross = F.sum(F.when(held, F.col("target_weight") * F.col("asset_return")))
    out = trades(positions, keys).groupBy(*keys, "seq").agg(
        F.max("signal_date").alias("signal_date"), F.max("date").alias("date"),
        gross.alias("_gross"), count_if(unknown).alias("_unknown"),
        turnover_from_trades(F.col("seq")).alias("turnover"), count_if(held).alias("holdings"),
        F.sum(F.when(held, F.col("target_weight") * F.col("target_weight"))).alias("hhi"),
    )
    lost = F.col("_unknown") > 0
    value = message_if(lost, MISSING_OUTCOME, F.col("_gross")) if strict else F.when(~lost, F.col("_gross"))
    return out.withColumn("gross_return", value).withColumn(
        "transaction_cost", one_way_cost(F.col("turnover"), cost_bps)
    ).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost")).drop("_gross", "_unknown")


def outcome_violations(positions: DataFrame) -> DataFrame:
    """Selected names without a realised return (never replaced)."""
    return positions.where(F.col("asset_return").isNull()).withColumn("violation", F.lit(MISSING_OUTCOME))


def net_returns(ledger: DataFrame, keys=("strategy",)) -> DataFrame:
    return ledger.select(*keys, "date", F.col("net_return").alias("ret"))


def nested_view(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    """Holdings list and weight / return maps, for flat sinks."""
    pair = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", v))))
    return positions.groupBy(*keys, "signal_date", "date").agg(
        F.sort_array(F.collect_list("ticker")).alias("holdings"),
        pair("weight").alias("weights"), pair("asset_return").alias("asset_returns"),
    )


def delayed_positions(positions: DataFrame, monthly: DataFrame) -> DataFrame:
    """Weights formed at ``t`` earn ``t+1`` to ``t+2``."""
    later = outcomes(monthly).where(F.col("next_date").isNotNull()).select(
        F.col("date").alias("execution_date"), "ticker", F.col("asset_return"),
        F.col("next_date").alias("_date"),
    )
    moved = positions.withColumnRenamed("date", "execution_date").drop("asset_return")
    dates = later.select("execution_date", "_date").distinct()
    return (
        moved.join(F.broadcast(dates), "execution_date")
        .join(later.drop("_date"), ["execution_date", "ticker"], "left")
        .withColumnRenamed("_date", "date")
    )


def with_costs(ledger: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Re-cost fixed paths: the cost level is one more key column."""
    return ledger.withColumn(
        "cost_bps", F.explode(F.array(*[F.lit(int(b)) for b in levels]))
    ).withColumn("transaction_cost", one_way_cost(F.col("turnover"), F.col("cost_bps"))).withColumn(
        "net_return", F.col("gross_return") - F.col("transaction_cost")
    )


def diagnostics(ledger: DataFrame, keys=("strategy",)) -> DataFrame:
    status = F.col("optimization_status") if "optimization_status" in ledger.columns else F.lit("equal")
    return ledger.groupBy(*keys).agg(
        F.avg("turnover").alias("average_turnover"), F.max("turnover").alias("maximum_turnover"),
        F.sum("transaction_cost").alias("total_transaction_cost"),
        F.avg("holdings").alias("average_holdings"),
        (compound(F.col("gross_return")) - compound(F.col("net_return"))).alias("gross_net_growth_difference"),
        share_if(F.startswith(status, F.lit("fallback"))).alias("optimization_fallback_rate"),
    )


def top_n_scenarios(scores: DataFrame, sizes=(10, 20, 25, 50)) -> DataFrame:
    """Positions for several portfolio sizes from one ranking pass."""
    largest = score_positions(scores, max(sizes)).drop("weight")
    ranked = scores.select(F.col("date").alias("signal_date"), "ticker", "ml_score")
    w = Window.partitionBy("signal_date").orderBy(F.desc("ml_score"), "ticker")
    rows = largest.join(ranked, ["signal_date", "ticker"]).withColumn("_r", F.row_number().over(w))
    keyed = rows.withColumn("top_n", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(
        F.col("_r") <= F.col("top_n")
    ).drop("_r", "ml_score")
    return equal_weights(keyed, ("top_n", "signal_date"))
