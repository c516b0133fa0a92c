"""Return attribution, concentration and weight-stability reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stratapanel.functions.columns import count_if, near_zero, share_if
from stratapanel.operators.ranking import ranked
from stratapanel.operators.weights import spread


def period_attribution(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    return positions.select(
        *keys, "signal_date", "date", "ticker", "weight", "asset_return",
        (F.col("weight") * F.col("asset_return")).alias("contribution"),
    )


def attribution_violations(positions: DataFrame, ledger: DataFrame, keys=("strategy",), tolerance=1e-10) -> DataFrame:
    """Periods whose contributions do not add up to the gross return."""
    total = period_attribution(positions, keys).groupBy(*keys, "date").agg(F.sum("contribution").alias("explained"))
    gross = ledger.select(*keys, "date", "gross_return")
    gap = F.abs(F.col("explained") - F.col("gross_return")) > tolerance + 1e-5 * F.abs(F.col("gross_return"))
    return total.join(gross, [*keys, "date"], "full_outer").where(
        gap | F.col("explained").isNull() | F.col("gross_return").isNull()
    )


def contribution_by_ticker(positions: DataFrame, ledger: DataFrame, keys=("strategy",)) -> DataFrame:
    """Ticker totals and one separate TRANSACTION_COST row per strategy."""
    names = period_attribution(positions, keys).groupBy(*keys, "ticker").agg(
        F.sum("contribution").alias("contribution")
    ).withColumn("attribution_type", F.lit("security"))
    costs = ledger.groupBy(*keys).agg((-F.sum("transaction_cost")).alias("contribution")).select(
        *keys, F.lit("TRANSACTION_COST").alias("ticker"), "contribution",
        F.lit("transaction_cost").alias("attribution_type"),
    )
    return names.unionByName(costs)


def contribution_ranks(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    """Per strategy and ticker: total, rank, share of positive and net totals."""
    total = period_attribution(positions, keys).groupBy(*keys, "ticker").agg(
        F.sum("contribution").alias("total_contribution")
    )
    g = Window.partitionBy(*keys)
    c = F.col("total_contribution")
    positive = F.sum(F.greatest(c, F.lit(0.0))).over(g)
    net = F.sum(c).over(g)
    return ranked(total, keys, "total_contribution", "rank", descending=True).withColumn(
        "share_of_positive_contribution",
        F.when((c > 0) & (positive > 0), F.try_divide(c, positive)).otherwise(0.0),
    ).withColumn("share_of_net_arithmetic_contribution", F.when(~near_zero(net), F.try_divide(c, net)))


def contribution_concentration(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    c, r = F.col("total_contribution"), F.col("rank")
    gain = F.when(c > 0, c)
    pos = F.sum(F.greatest(c, F.lit(0.0)))

    def top(k):
        return F.coalesce(F.sum(F.when((c > 0) & (r <= k), c)), F.lit(0.0))

    last = F.col("_n") - F.col("rank")
    sized = contribution_ranks(positions, keys).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    agg = sized.groupBy(*keys).agg(
        F.sum(c).alias("net_arithmetic_contribution"), pos.alias("positive_contribution_total"),
        F.min_by("ticker", "rank").alias("largest_contributor"),
        F.max(c).alias("largest_contributor_contribution"),
        top(1).alias("_top_1"), top(2).alias("top_2_contribution"),
        top(3).alias("top_3_contribution"), top(5).alias("top_5_contribution"),
        F.max_by("ticker", "rank").alias("bottom_contributor"),
        F.sum(F.when(last < 3, c)).alias("bottom_3_contribution"),
        F.sum(gain * gain).alias("_squares"),
    )
    p = F.col("positive_contribution_total")
    share = lambda name: F.when(p > 0, F.try_divide(F.col(name), p))
    return agg.select(
        *keys, "net_arithmetic_contribution", "positive_contribution_total", "largest_contributor",
        "largest_contributor_contribution", "top_2_contribution", "top_3_contribution",
        "top_5_contribution", "bottom_contributor", "bottom_3_contribution",
        share("_top_1").alias("top_1_share"), share("top_2_contribution").alias("top_2_share"),
        share("top_3_contribution").alias("top_3_share"), share("top_5_contribution").alias("top_5_share"),
        F.when(p > 0, F.try_divide(F.col("_squares"), p * p)).alias("positive_contribution_hhi"),
    )


def removal_sets(ranks: DataFrame, sizes=(1, 2, 3)) -> DataFrame:
    """(strategy, scenario, removed): the top contributors to leave out.

    Arrays hold at most ``max(sizes)`` tickers.
    """
    top = ranks.where(F.col("rank") <= max(sizes)).withColumn(
        "scenario", F.explode(F.array(*[F.lit(s) for s in sizes]))
    ).where(F.col("rank") <= F.col("scenario"))
    return top.groupBy("strategy", "scenario").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("removed"),
        F.sum("total_contribution").alias("removed_contribution"),
    )


def contribution_counterfactuals(sets: DataFrame, reruns: DataFrame, baseline: DataFrame) -> DataFrame:
    """Attribution subtraction and true re-runs, typed and unioned."""
    text = F.array_join("removed", "|").alias("removed_tickers")
    none = F.lit(None).cast("double")
    subtraction = sets.select(
        "strategy", "scenario", F.lit("attribution_counterfactual").alias("counterfactual_type"), text,
        none.alias("annual_return"), none.alias("sharpe"), none.alias("max_drawdown"),
        none.alias("information_ratio"), (-F.col("removed_contribution")).alias("delta_vs_baseline"),
    )
    again = sets.join(reruns, ["strategy", "scenario"]).join(
        baseline.select("strategy", F.col("sharpe").alias("_base")), "strategy"
    ).select(
        "strategy", "scenario", F.lit("rerun_counterfactual").alias("counterfactual_type"), text,
        "annual_return", "sharpe", "max_drawdown", "information_ratio",
        (F.col("sharpe") - F.col("_base")).alias("delta_vs_baseline"),
    )
    return subtraction.unionByName(again)


def concentration(positions: DataFrame, keys=("strategy",)) -> DataFrame:
    """Largest weight, HHI and 1/HHI per period on renormalised weights."""
    usable = positions.where(F.col("weight").isNotNull())
    agg = usable.groupBy(*keys, "date").agg(
        F.sum("weight").alias("_s"), F.max("weight").alias("_m"), F.sum(F.col("weight") * F.col("weight")).alias("_q")
    ).where(F.col("_s") > 0)
    hhi = F.col("_q") / (F.col("_s") * F.col("_s"))
    return agg.select(
        *keys, "date", (F.col("_m") / F.col("_s")).alias("maximum_weight"), hhi.alias("hhi"),
        (1.0 / hhi).alias("effective_holdings"),
    )


def concentration_summary(series: DataFrame, keys=("strategy",)) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.avg("maximum_weight").alias("average_maximum_weight"),
        F.max("maximum_weight").alias("maximum_single_name_weight"),
        F.avg("hhi").alias("average_hhi"), F.max("hhi").alias("maximum_hhi"),
        F.avg("effective_holdings").alias("average_effective_holdings"),
        F.min("effective_holdings").alias("minimum_effective_holdings"),
    )


def weight_stability(positions: DataFrame, ledger: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Per period: breadth, top weights, HHI, entropy and target-weight change.

    The change is the L1 distance to the previous target, 1.0 at the start; it
    uses the +weight / -previous-weight union, not a self join.
    """
    keys = ("strategy",)
    seq = F.dense_rank().over(Window.partitionBy("strategy").orderBy("signal_date"))
    order = Window.partitionBy("strategy", "signal_date").orderBy(F.desc("weight"), "ticker")
    numbered = positions.withColumn("seq", seq).withColumn("_r", F.row_number().over(order))
    moves = numbered.select("strategy", "ticker", F.inline(F.array(
        F.struct(F.col("seq"), F.col("weight").alias("d"), F.col("weight").alias("w"), F.col("_r").alias("r"), F.col("date")),
        F.struct((F.col("seq") + 1).alias("seq"), (-F.col("weight")).alias("d"), F.lit(None).cast("double").alias("w"),
                 F.lit(None).cast("int").alias("r"), F.lit(None).cast("date").alias("date")),
    )))
    names = moves.groupBy(*keys, "seq", "ticker").agg(
        F.sum("d").alias("d"), F.max("w").alias("w"), F.max("r").alias("r"), F.max("date").alias("date")
    )
    w = F.col("w")
    held = w > tolerance
    hhi = F.sum(w * w)
    agg = names.groupBy(*keys, "seq").agg(
        F.max("date").alias("date"), count_if(held).alias("number_nonzero_holdings"),
        F.max("w").alias("maximum_weight"),
        F.sum(F.when(held & (F.col("r") <= 2), w)).alias("top_2_weight"),
        F.sum(F.when(held & (F.col("r") <= 3), w)).alias("top_3_weight"),
        hhi.alias("hhi"), (1.0 / hhi).alias("effective_holdings"),
        F.sum(F.when(held, -w * F.ln(F.when(held, w)))).alias("entropy"),
        F.when(F.max("seq") == 1, F.lit(1.0)).otherwise(F.sum(F.abs("d"))).alias("l1_target_weight_change"),
    ).where(F.col("date").isNotNull())
    status = "optimization_status" if "optimization_status" in positions.columns else None
    extra = positions.groupBy("strategy", "date").agg(F.max(status).alias("optimization_status")) if status else None
    out = agg.join(ledger.select("strategy", "date", "turnover"), ["strategy", "date"], "left")
    out = out.join(extra, ["strategy", "date"], "left") if status else out.withColumn("optimization_status", F.lit("equal"))
    return out.withColumn(
        "fallback_indicator", F.startswith(F.col("optimization_status"), F.lit("fallback_equal:"))
    ).drop("seq")


def stability_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rebalance_periods"),
        F.avg("number_nonzero_holdings").alias("average_nonzero_holdings"),
        F.avg("maximum_weight").alias("average_max_weight"), F.max("maximum_weight").alias("maximum_max_weight"),
        F.avg("top_3_weight").alias("average_top3_weight"), F.avg("hhi").alias("average_hhi"),
        F.avg("effective_holdings").alias("average_effective_holdings"),
        F.min("effective_holdings").alias("minimum_effective_holdings"),
        F.avg("turnover").alias("average_turnover"), F.median("turnover").alias("median_turnover"),
        F.max("turnover").alias("maximum_turnover"),
        F.avg("l1_target_weight_change").alias("average_l1_weight_change"),
        share_if(F.col("fallback_indicator")).alias("fallback_rate"),
    )


def ticker_stability(positions: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Holding statistics per (strategy, ticker) over all rebalances.

    Works on held rows only: gaps in the rebalance number separate streaks, and
    periods not held enter through the period count, so no dense grid is built.
    """
    by = Window.partitionBy("strategy")
    seq = F.dense_rank().over(by.orderBy("signal_date"))
    numbered = positions.withColumn("seq", seq).withColumn("_periods", F.max("seq").over(by)).withColumn(
        "_top", F.max("weight").over(Window.partitionBy("strategy", "seq"))
    )
    names = Window.partitionBy("strategy", "ticker").orderBy("seq")
    rows = numbered.withColumn("_held", F.col("weight") > tolerance)
    held = rows.where("_held").withColumn("_island", F.col("seq") - F.row_number().over(names))
    streaks = held.groupBy("strategy", "ticker", "_island").agg(
        F.count(F.lit(1)).alias("_len"), F.max("seq").alias("_last"),
    ).groupBy("strategy", "ticker").agg(
        F.max("_len").alias("_longest"), F.count(F.lit(1)).alias("_runs"), F.max("_last").alias("_last")
    )
    agg = rows.groupBy("strategy", "ticker").agg(
        F.max("_periods").alias("_p"), count_if(F.col("_held")).alias("_h"), F.sum("weight").alias("_sum"),
        F.sum(F.when(F.col("_held"), F.col("weight"))).alias("_hsum"), F.max("weight").alias("maximum_weight"),
        count_if(F.col("_held") & (F.col("weight") == F.col("_top"))).alias("_largest"),
        F.sort_array(F.collect_list("weight"), asc=False).alias("_w"),
    )
    # The median counts unheld periods as zero: positions from the top.
    at = lambda k: F.coalesce(F.try_element_at("_w", k.cast("int")), F.lit(0.0))
    p = F.col("_p")
    median = (at(F.floor((p + 1) / 2)) + at(F.floor(p / 2) + 1)) / 2.0
    zero = F.lit(0)
    return agg.join(streaks, ["strategy", "ticker"], "left").select(
        "strategy", "ticker", (F.col("_h") / p).alias("held_period_fraction"),
        F.coalesce(F.try_divide("_hsum", "_h"), F.lit(0.0)).alias("average_weight_when_held"),
        (F.col("_sum") / p).alias("unconditional_average_weight"), median.alias("median_weight"), "maximum_weight",
        (F.col("_largest") / p).alias("largest_position_fraction"),
        F.coalesce("_longest", zero).cast("bigint").alias("longest_consecutive_holding_streak"),
        F.coalesce("_runs", zero).cast("bigint").alias("entries"),
        (F.coalesce("_runs", zero) - F.coalesce((F.col("_last") == p).cast("int"), zero)).cast("bigint").alias("exits"),
    )


def estimator_diagnostics(history: DataFrame, frequency: int, keys=("strategy", "signal_date")) -> DataFrame:
    """Eigenvalues, condition number and rank of each window's covariance.

    One Arrow group per signal with at most top_n x lookback rows.
    """
    def spectrum(pdf):
        import numpy as np
        import pandas as pd

        wide = pdf.pivot(index="t", columns="ticker", values="ret").sort_index().dropna()
        sigma = np.atleast_2d(np.cov(wide.to_numpy(float), rowvar=False, ddof=1)) * frequency
        values = np.linalg.eigvalsh(sigma)
        return pd.DataFrame([{
            **{k: pdf[k].iloc[0] for k in keys}, "observations": len(wide), "assets": wide.shape[1],
            "covariance_condition_number": float(np.linalg.cond(sigma)),
            "minimum_eigenvalue": values.min(), "maximum_eigenvalue": values.max(),
            "covariance_rank": int(np.linalg.matrix_rank(sigma)),
        }])

    fields = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + (
        ", observations bigint, assets bigint, covariance_condition_number double,"
        " minimum_eigenvalue double, maximum_eigenvalue double, covariance_rank bigint"
    )
    return spread(history.where("ret is not null"), keys).groupBy(*keys).applyInPandas(spectrum, schema)


def correlation_diagnostics(pairs: DataFrame, keys=("strategy", "signal_date")) -> DataFrame:
    off = pairs.where(F.col("i") < F.col("j"))
    return off.groupBy(*keys).agg(
        F.avg("correlation").alias("average_pairwise_correlation"),
        F.max("correlation").alias("maximum_pairwise_correlation"),
        F.min("correlation").alias("minimum_pairwise_correlation"),
        F.max("observations").alias("observations"),
    )


def estimator_summary(details: DataFrame) -> DataFrame:
    c = F.col("covariance_condition_number")
    return details.groupBy("strategy").agg(
        F.count(c).alias("valid_estimator_periods"), F.median(c).alias("median_covariance_condition_number"),
        F.percentile(c, F.lit(0.95)).alias("p95_covariance_condition_number"),
        *[share_if(c > 10.0**e).alias(f"fraction_condition_number_above_1e{e}") for e in (3, 4, 5)],
    )
