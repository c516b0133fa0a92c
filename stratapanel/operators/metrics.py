"""Return, risk and benchmark-relative metrics as single grouped aggregations.

Every function takes long returns ``(keys..., date, ret[, bench])``; scenarios,
strategies, years or simulations are just more key columns of the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import (
    annual_ratio, annual_return, annual_volatility, compound, count_if, near_zero, ratio, share_if,
)
from stratapanel.operators.timeseries import wealth_path

ABSOLUTE = ("annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "calmar")
ACTIVE = ("annual_active_return", "tracking_error", "information_ratio", "beta", "annual_alpha")


def _absolute(ret: str, rf: float, periods: int) -> list[Column]:
    r = F.col(ret)
    excess = r - rf / periods
    return [
        compound(r).alias("_growth"),
        F.min(r).alias("_worst"),
        F.count(r).alias("observations"),
        F.avg(excess).alias("_mean"),
        F.stddev_samp(r).alias("_std"),
        F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2.0)))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
    ]


def _active(ret: str, bench: str) -> list[Column]:
    r, b = F.col(ret), F.col(bench)
    paired = F.when(r.isNotNull(), b)
    return [
        F.avg(r - b).alias("_active_mean"),
        F.stddev_samp(r - b).alias("_active_std"),
        F.covar_samp(ret, bench).alias("_cov"),
        F.var_samp(paired).alias("_bvar"),
        F.avg(F.when(b.isNotNull(), r)).alias("_pmean"),
        F.avg(paired).alias("_bmean"),
        F.count(r - b).alias("_pairs"),
    ]


def _absolute_values(periods: int) -> list[Column]:
    growth = annual_return(F.col("_growth"), F.col("observations"), F.col("_worst"), periods)
    return [
        growth.alias("annual_return"),
        annual_volatility(F.col("_std"), periods).alias("annual_volatility"),
        annual_ratio(F.col("_mean"), F.col("_std"), periods).alias("sharpe"),
        annual_ratio(F.col("_mean"), F.col("_down"), periods).alias("sortino"),
        F.col("max_drawdown"),
        F.try_divide(growth, F.abs("max_drawdown")).alias("calmar"),
    ]


def _active_values(periods: int) -> list[Column]:
    enough = F.col("_pairs") >= 2
    beta = F.when(enough & ~near_zero(F.col("_bvar")), F.try_divide("_cov", "_bvar"))
    return [
        F.when(enough, F.col("_active_mean") * periods).alias("annual_active_return"),
        annual_volatility(F.col("_active_std"), periods).alias("tracking_error"),
        annual_ratio(F.col("_active_mean"), F.col("_active_std"), periods).alias("information_ratio"),
        beta.alias("beta"),
        ((F.col("_pmean") - beta * F.col("_bmean")) * periods).alias("annual_alpha"),
    ]


def performance(returns: DataFrame, keys=("strategy",), ret: str = "ret", rf: float = 0.0, periods: int = 12) -> DataFrame:
    """Six absolute metrics and the observation count per key."""
    return (
        wealth_path(returns, keys, ret).groupBy(*keys).agg(*_absolute(ret, rf, periods))
        .select(*keys, "observations", *_absolute_values(periods))
    )


def active_performance(returns: DataFrame, keys=("strategy",), ret="ret", bench="bench", periods: int = 12) -> DataFrame:
    """Benchmark-relative metrics over the rows where both returns exist."""
    return returns.groupBy(*keys).agg(*_active(ret, bench)).select(*keys, *_active_values(periods))


def evaluate(returns: DataFrame, keys=("strategy",), ret="ret", bench="bench", periods: int = 12, extra: dict[str, Column] | None = None) -> DataFrame:
    """Absolute and active metrics on identical dates, in one aggregation."""
    paired = returns.where(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    extra = extra or {}
    return (
        wealth_path(paired, keys, ret).groupBy(*keys)
        .agg(
            F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            *_absolute(ret, 0.0, periods), *_active(ret, bench), *[c.alias(k) for k, c in extra.items()],
        )
        .select(
            *keys, "start_date", "end_date", "observations",
            *_absolute_values(periods), *_active_values(periods), *extra,
        )
    )


def common_period(returns: DataFrame, strategies: int | None = None) -> DataFrame:
    """Rows on dates where every strategy (benchmark included) has a return.

    Counting per date replaces an N-way join; only dates are compared.
    """
    present = returns.where(F.col("ret").isNotNull())
    dates = present.groupBy("date").agg(F.count_distinct("strategy").alias("_n"))
    if strategies is None:
        total = present.agg(F.count_distinct("strategy").alias("_n"))
        full = dates.join(F.broadcast(total), "_n", "left_semi")
    else:
        full = dates.where(F.col("_n") == strategies)
    return present.join(F.broadcast(full.select("date")), "date", "left_semi")


def return_date_violations(returns: DataFrame) -> DataFrame:
    """Duplicate realisation dates of a strategy."""
    return returns.groupBy("strategy", "date").count().where("count > 1")


def with_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Attach ``bench`` by date.  Broadcast: one row per period."""
    return returns.join(F.broadcast(benchmark.select("date", "bench")), "date", "left")


def benchmark_column(common: DataFrame, name: str = "benchmark") -> DataFrame:
    """Long common returns with the benchmark's own row joined as ``bench``."""
    bench = common.where(F.col("strategy") == name).select("date", F.col("ret").alias("bench"))
    return common.join(F.broadcast(bench), "date", "left")


def performance_report(common: DataFrame, names: list[str], benchmark: str = "benchmark") -> DataFrame:
    """Metrics as rows, strategies as columns (absolute then active)."""
    tidy = evaluate(benchmark_column(common, benchmark)).select("strategy", *ABSOLUTE, *ACTIVE)
    for c in ACTIVE:
        tidy = tidy.withColumn(c, F.when(F.col("strategy") != benchmark, F.col(c)))
    long = tidy.unpivot("strategy", [*ABSOLUTE, *ACTIVE], "metric", "value")
    return long.groupBy("metric").pivot("strategy", names).agg(F.first("value", ignorenulls=True))


def calendar_year_returns(common: DataFrame) -> DataFrame:
    return common.groupBy("strategy", F.year("date").alias("year")).agg(
        (compound(F.col("ret")) - 1.0).alias("annual_return")
    )


def yearly_performance(returns: DataFrame, periods: int = 12) -> DataFrame:
    """Per calendar year; drawdown restarts every year."""
    keyed = returns.withColumn("year", F.year("date"))
    agg = wealth_path(keyed, ("strategy", "year")).groupBy("strategy", "year").agg(
        (compound(F.col("ret")) - 1.0).alias("return"),
        F.stddev_samp("ret").alias("_std"), F.avg("ret").alias("_mean"),
        F.min("drawdown").alias("max_drawdown"), F.count("ret").alias("observations"),
    )
    return agg.select(
        "strategy", "year", "return", annual_volatility(F.col("_std"), periods).alias("volatility"),
        annual_ratio(F.col("_mean"), F.col("_std"), periods).alias("sharpe"),
        "max_drawdown", "observations",
    )


def yearly_analysis(common: DataFrame, names: list[str], benchmark="benchmark", expected: int = 12) -> DataFrame:
    """Yearly returns pivoted, leaders, laggards, excess over the benchmark."""
    yearly = common.groupBy("strategy", F.year("date").alias("year")).agg(
        (compound(F.col("ret")) - 1.0).alias("r"), F.count("ret").alias("n")
    )
    own = F.col("strategy") != benchmark
    agg = yearly.groupBy("year").agg(
        *[F.max(F.when(F.col("strategy") == s, F.col("r"))).alias(s) for s in [*names, benchmark]],
        F.max("n").alias("observations"),
        # Ties go to the first name in order.
        F.min_by("strategy", F.when(own, F.struct(-F.col("r"), "strategy"))).alias("best_strategy"),
        F.min_by("strategy", F.when(own, F.struct("r", "strategy"))).alias("worst_strategy"),
    )
    return agg.withColumn("partial_year", F.col("observations") < expected).select(
        "*", *[(F.col(s) - F.col(benchmark)).alias(f"{s}_excess_vs_{benchmark}") for s in names]
    )


def subperiod_performance(common: DataFrame, periods: list[tuple[str, str, str]], benchmark="benchmark") -> DataFrame:
    """Metrics inside fixed, non-overlapping calendar ranges (inclusive)."""
    ordered = sorted(periods, key=lambda p: p[1])
    for (_, start, end), following in zip(ordered, ordered[1:] + [None]):
        if start > end or (following and following[1] <= end):
            raise ValueError("Sub-periods overlap or are inverted.")
    label, lo, hi = F.lit(None).cast("string"), F.lit(None).cast("date"), F.lit(None).cast("date")
    for name, start, end in periods:
        inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        label = F.when(inside, F.lit(name)).otherwise(label)
        lo = F.when(inside, F.lit(start).cast("date")).otherwise(lo)
        hi = F.when(inside, F.lit(end).cast("date")).otherwise(hi)
    keyed = benchmark_column(common, benchmark).select(
        "*", label.alias("subperiod"), lo.alias("requested_start"), hi.alias("requested_end")
    ).where(F.col("subperiod").isNotNull())
    out = evaluate(keyed, ("subperiod", "requested_start", "requested_end", "strategy"))
    for c in ACTIVE:
        out = out.withColumn(c, F.when(F.col("strategy") != benchmark, F.col(c)))
    return out


def subperiod_stability(performance: DataFrame, benchmark="benchmark") -> DataFrame:
    base = performance.where(F.col("strategy") == benchmark).select(
        "subperiod", F.col("annual_return").alias("_br"), F.col("sharpe").alias("_bs")
    )
    own = performance.where(F.col("strategy") != benchmark).join(F.broadcast(base), "subperiod", "left")
    positive = F.col("annual_active_return") > 0
    return own.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total_subperiods"),
        count_if(positive).alias("positive_active_return_subperiods"),
        share_if(positive).alias("positive_active_return_ratio"),
        count_if(F.col("annual_return") > F.col("_br")).alias("benchmark_beating_return_subperiods"),
        count_if(F.col("sharpe") > F.col("_bs")).alias("benchmark_beating_sharpe_subperiods"),
        F.max("sharpe").alias("best_subperiod_sharpe"),
        F.min("sharpe").alias("worst_subperiod_sharpe"),
        F.avg("sharpe").alias("mean_subperiod_sharpe"),
        F.stddev_samp("sharpe").alias("std_subperiod_sharpe"),
    )


def _window_drawdown(frame) -> Column:
    """Worst drawdown inside a frame: a fold over at most ``window`` values."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d"))

    def step(acc, r):
        w = acc["w"] * (1.0 + r)
        p = F.greatest(acc["p"], w)
        return F.struct(w.alias("w"), p.alias("p"), F.least(acc["d"], w / p - 1.0).alias("d"))

    return F.aggregate(F.collect_list("ret").over(frame), start, step)["d"]


def rolling_risk(common: DataFrame, window: int = 12, periods: int = 12, benchmark="benchmark") -> DataFrame:
    """Rolling metrics per strategy, NULL until a window is complete.

    Frames hold at most ``window`` rows, so their state is bounded.
    """
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(-(window - 1), 0)
    full = F.count("ret").over(w) == window
    active = F.col("ret") - F.col("bench")
    values = {
        "annualized_return": F.when(F.min("ret").over(w) <= -1.0, F.lit(-1.0)).otherwise(
            F.pow(F.product(1.0 + F.col("ret")).over(w), F.lit(periods / window)) - 1.0
        ),
        "annualized_volatility": annual_volatility(F.stddev_samp("ret").over(w), periods),
        "sharpe_ratio": annual_ratio(F.avg("ret").over(w), F.stddev_samp("ret").over(w), periods),
        "beta": ratio(F.covar_samp("ret", "bench").over(w), F.var_samp("bench").over(w)),
        "tracking_error": annual_volatility(F.stddev_samp(active).over(w), periods),
        "information_ratio": annual_ratio(F.avg(active).over(w), F.stddev_samp(active).over(w), periods),
        "maximum_drawdown": _window_drawdown(w),
    }
    return benchmark_column(common, benchmark).select(
        "strategy", "date", F.min("date").over(w).alias("start_date"), full.alias("complete"),
        *[F.when(full, v).alias(k) for k, v in values.items()],
        F.when(full, F.avg(active).over(w) * periods).alias("annual_active_return"),
    )


def rolling_robustness(common: DataFrame, window: int = 24, benchmark="benchmark") -> DataFrame:
    """Complete rolling windows only, with active metrics for strategies."""
    own = F.col("strategy") != benchmark
    return rolling_risk(common, window, benchmark=benchmark).where("complete").select(
        "strategy", "start_date", "date", F.lit(window).cast("bigint").alias("observations"),
        F.col("annualized_return").alias("annual_return"),
        F.col("annualized_volatility").alias("annual_volatility"),
        F.col("sharpe_ratio").alias("sharpe"), F.col("maximum_drawdown").alias("max_drawdown"),
        *[F.when(own, F.col(c)).alias(c) for c in ("annual_active_return", "tracking_error", "information_ratio")],
    )


def rolling_summary(details: DataFrame, benchmark="benchmark") -> DataFrame:
    base = details.where(F.col("strategy") == benchmark).select("date", F.col("sharpe").alias("_bs"))
    own = details.where(F.col("strategy") != benchmark).join(F.broadcast(base), "date", "left")
    return own.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("rolling_windows"),
        share_if(F.col("sharpe") > 0).alias("positive_sharpe_ratio"),
        share_if(F.col("sharpe") > F.col("_bs")).alias("sharpe_above_benchmark_ratio"),
        share_if(F.col("annual_active_return") > 0).alias("positive_active_return_ratio"),
        F.min("sharpe").alias("minimum_rolling_sharpe"),
        F.median("sharpe").alias("median_rolling_sharpe"),
        F.max("sharpe").alias("maximum_rolling_sharpe"),
        F.min("information_ratio").alias("minimum_rolling_information_ratio"),
    )


def drawdown_episodes(returns: DataFrame, keys=("strategy",), tolerance: float = 1e-12) -> DataFrame:
    """Deepest episode (start, trough, recovery, duration) and longest duration.

    Gaps and islands: the running count of high-water rows names the episode.
    Rows before the first high-water row start at row 0.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    island = Window.partitionBy(*keys, "_episode")
    path = (
        wealth_path(returns, keys)
        .withColumn("_pos", F.row_number().over(w) - 1)
        .withColumn("_high", F.col("drawdown") >= -tolerance)
        .withColumn("_episode", F.sum(F.col("_high").cast("int")).over(w))
        .withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1)
        .withColumn("_next", F.lead("date").over(w))
    )
    under = ~F.col("_high")
    episodes = path.groupBy(*keys, "_episode").agg(
        # The island opens at its high-water row; the first island at row 0.
        F.min("_pos").alias("_start"), F.min("date").alias("start_date"),
        F.min(F.when(under, F.col("drawdown"))).alias("depth"),
        F.min_by(F.when(under, F.col("date")), F.when(under, F.struct("drawdown", "date"))).alias("trough_date"),
        F.max("_pos").alias("_end"), F.max("_last").alias("_last"),
        F.max_by("_next", "_pos").alias("recovery_date"),
    ).where(F.col("depth").isNotNull()).withColumn(
        "duration",
        F.when(F.col("recovery_date").isNull(), F.col("_last") - F.col("_start"))
        .otherwise(F.col("_end") + 1 - F.col("_start")),
    )
    deepest = episodes.groupBy(*keys).agg(
        F.min_by(
            F.struct("depth", "start_date", "trough_date", "recovery_date", "duration"),
            F.struct("depth", "_start"),
        ).alias("d"),
        F.max("duration").alias("longest_drawdown_duration"),
    )
    everyone = returns.where(F.col("ret").isNotNull()).select(*keys).distinct()
    return everyone.join(deepest, list(keys), "left").select(
        *keys,
        F.coalesce("d.depth", F.lit(0.0)).alias("maximum_drawdown"),
        F.col("d.start_date").alias("drawdown_start"), F.col("d.trough_date").alias("trough_date"),
        F.col("d.recovery_date").alias("recovery_date"),
        F.coalesce("d.duration", F.lit(0)).cast("bigint").alias("drawdown_duration"),
        F.coalesce("longest_drawdown_duration", F.lit(0)).cast("bigint").alias("longest_drawdown_duration"),
    )


def _moment_adjusted(name: str) -> tuple[Column, Column]:
    n, g1, g2 = F.count(name), F.skewness(name), F.kurtosis(name)
    spread = F.stddev_samp(name) > 0
    skew = F.when(spread & (n > 2), F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))
    kurt = F.when(
        spread & (n > 3),
        F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0),
    )
    return skew, kurt


def outlier_ranks(common: DataFrame) -> DataFrame:
    """Adds ``_best`` and ``_worst`` positions of each return in its series."""
    best = Window.partitionBy("strategy").orderBy(F.desc("ret"), F.desc("date"))
    worst = Window.partitionBy("strategy").orderBy("ret", "date")
    return common.where(F.col("ret").isNotNull()).withColumn(
        "_best", F.row_number().over(best)
    ).withColumn("_worst", F.row_number().over(worst))


def outlier_diagnostics(common: DataFrame) -> DataFrame:
    skew, kurt = _moment_adjusted("ret")
    total = F.sum("ret")
    return outlier_ranks(common).groupBy("strategy").agg(
        F.min_by("date", F.struct(-F.col("ret"), "date")).alias("best_month"),
        F.max("ret").alias("best_monthly_return"),
        F.min_by("date", F.struct("ret", "date")).alias("worst_month"),
        F.min("ret").alias("worst_monthly_return"),
        F.median("ret").alias("median_monthly_return"),
        share_if(F.col("ret") > 0).alias("positive_month_fraction"),
        share_if(F.col("ret") < 0).alias("negative_month_fraction"),
        skew.alias("skewness"), kurt.alias("excess_kurtosis"),
        *[
            F.try_divide(F.sum(F.when(F.col(c) <= k, F.col("ret"))), total).alias(f"{side}_{k}_month_arithmetic_share")
            for side, c in (("best", "_best"), ("worst", "_worst")) for k in (1, 3, 5)
        ],
    )


def outlier_counterfactuals(common: DataFrame, sizes=(1, 3, 5)) -> DataFrame:
    """Metrics after removing the best or worst months; scenario is a key."""
    options = [F.struct(F.lit("baseline").alias("counterfactual"), F.lit(True).alias("keep"))]
    for side in ("best", "worst"):
        for k in sizes:
            options.append(F.struct(
                F.lit(f"remove_{side}_{k}_months").alias("counterfactual"),
                (F.col(f"_{side}") > k).alias("keep"),
            ))
    rows = outlier_ranks(common).select("strategy", "date", "ret", F.inline(F.array(*options)))
    kept = performance(rows.where("keep"), ("strategy", "counterfactual"))
    removed = rows.groupBy("strategy", "counterfactual").agg(
        # In return order; at most the largest removal size survives the filter.
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(~F.col("keep"), F.struct("ret", "date")))),
            lambda x: F.date_format(x["date"], "yyyy-MM-dd"),
        ), "|").alias("removed_months")
    )
    return kept.join(removed, ["strategy", "counterfactual"]).select(
        "strategy", "counterfactual", "removed_months", "observations",
        "annual_return", "annual_volatility", "sharpe", "max_drawdown",
    )
