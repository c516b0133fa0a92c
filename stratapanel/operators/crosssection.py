"""Ranking, quantile and sector diagnostics of a score panel.

Scores are ``(date, target_date, ticker, ml_score, future_return,
benchmark_return, target)``; extra key columns (horizon, scenario) may lead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import attach, count_if, flag, message_if, pearson, ratio, share_if
from stratapanel.operators.metrics import performance
from stratapanel.operators.ranking import medians, quantiles, ranked_together, top_n
from stratapanel.operators.timeseries import forward_returns
from stratapanel.operators.universe import with_sector

QUANTILES = ("Q1", "Q2", "Q3", "Q4", "Q5")


def rank_ic(scores: DataFrame, keys=("date",), score="ml_score", ret="future_return") -> DataFrame:
    """(keys, rank_ic, pearson_ic, realized): Spearman with average tie ranks.

    Dates with fewer than two realised pairs, or a constant side, give NULL.
    """
    both = scores.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    both = ranked_together(both.select(*keys, "ticker", score, ret), tuple(keys), {score: "_rx", ret: "_ry"}, method="average")
    agg = both.groupBy(*keys).agg(
        pearson(F.col("_rx"), F.col("_ry")).alias("rank_ic"),
        pearson(F.col(score), F.col(ret)).alias("pearson_ic"), F.count(F.lit(1)).alias("realized"),
    )
    return scores.select(*keys).distinct().join(agg, list(keys), "left")


def _with_rank(scores: DataFrame, keys, n: int, score: str = "ml_score") -> DataFrame:
    """(keys, ticker, top): the selected names, for a conditional average."""
    return top_n(scores.select(*keys, "ticker", score), keys, score, n).select(
        *keys, "ticker", F.lit(True).alias("top")
    )


def _flag_top(scores: DataFrame, keys, n: int, score: str = "ml_score") -> DataFrame:
    """Mark the top names.  The selection has n rows per date, so joining it
    back costs less than ranking a whole cross-section."""
    chosen = _with_rank(scores, keys, n, score)
    return scores.join(chosen, [*keys, "ticker"], "left").withColumn("top", F.coalesce("top", F.lit(False)))


def monthly_metrics(scores: DataFrame, keys=("date",), ret="future_return", bench="benchmark_return", n=5) -> DataFrame:
    """(keys, rank_ic, top_n_hit_rate, top_n_spread) over realised rows."""
    valid = scores.where(F.col("ml_score").isNotNull() & F.col(ret).isNotNull())
    marked = _flag_top(valid, keys, n)
    top = F.col("top")
    agg = marked.groupBy(*keys).agg(
        F.avg(F.when(top, flag(F.col(ret) > F.col(bench)))).alias("top_n_hit_rate"),
        (F.avg(F.when(top, F.col(ret))) - F.avg(ret)).alias("top_n_spread"),
    )
    ic = rank_ic(valid, keys, ret=ret).select(*keys, "rank_ic")
    return agg.join(ic, list(keys), "left")


def ranking_by_date(scores: DataFrame, n: int = 5, score: str = "ml_score", strict: bool = True) -> DataFrame:
    """Per evaluated date: hit rate and spread of the top names; partially
    missing outcomes fail the job."""
    marked = _flag_top(scores.where(F.col(score).isNotNull()), ("date",), n, score)
    top = F.col("top")
    partial = count_if(F.col("future_return").isNull() | F.col("target").isNull()) > 0
    agg = marked.groupBy("date").agg(
        F.avg(F.when(top, F.col("target").cast("double"))).alias("_hit"),
        (F.avg(F.when(top, F.col("future_return"))) - F.avg("future_return")).alias("top_n_spread"),
        F.count("future_return").alias("_known"), partial.alias("_partial"),
    ).where(F.col("_known") > 0)
    hit = F.col("_hit")
    if strict:
        hit = message_if(F.col("_partial"), "Partially missing realized outcomes", hit)
    return agg.select("date", hit.alias("top_n_hit_rate"), "top_n_spread")


def ranking_summary(scores: DataFrame, n: int = 5, score: str = "ml_score", strict: bool = True) -> DataFrame:
    ic = rank_ic(scores, score=score)
    merged = ic.join(ranking_by_date(scores, n, score, strict), "date", "left")
    c = F.col("rank_ic")
    return merged.agg(
        F.avg(c).alias("mean_rank_ic"), ratio(F.avg(c), F.stddev_samp(c)).alias("rank_ic_information_ratio"),
        F.avg("top_n_hit_rate").alias("top_n_hit_rate"), F.avg("top_n_spread").alias("top_n_return_spread"),
        F.count("top_n_spread").alias("evaluated_periods"),
        F.avg(F.when(c.isNotNull(), flag(c > 0))).alias("positive_rank_ic_fraction"),
    )


def _rolling(column: str | Column, window: int, order: str = "date") -> Column:
    w = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    value = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(value).over(w) == window, F.avg(value).over(w))


def ranking_timeseries(scores: DataFrame, n: int = 5, window: int = 12, score="ml_score") -> DataFrame:
    """Rank IC, its rolling mean and the top-N hit rate: one row per date, so
    the calendar-ordered frame is short."""
    ic = rank_ic(scores, score=score).select("date", "rank_ic")
    hits = ranking_by_date(scores, n, score).select("date", "top_n_hit_rate")
    return ic.join(hits, "date", "left").select(
        "date", "rank_ic", _rolling("rank_ic", window).alias("rolling_mean_rank_ic"), "top_n_hit_rate"
    )


def diagnostics(scores: DataFrame, n: int = 25) -> DataFrame:
    ic = rank_ic(scores)
    spread = scores.groupBy("date").agg(
        F.stddev_samp("ml_score").alias("score_dispersion"), F.count("ml_score").alias("eligible_securities")
    )
    s = F.col("rank_ic")
    return ic.join(spread, "date").select(
        "date", s.alias("spearman_rank_ic"), "pearson_ic", (s > 0).alias("positive_rank_ic"), "score_dispersion",
        "eligible_securities", F.least(F.lit(n).cast("bigint"), F.col("eligible_securities")).alias("selected_securities"),
    )


def quantile_returns(scores: DataFrame) -> DataFrame:
    """(date, Q1..Q5, Q5_minus_Q1): buckets from scores, means of outcomes."""
    q = quantiles(scores).where(F.col("future_return").isNotNull())
    mean = lambda k: F.avg(F.when(F.col("quantile_number") == k, F.col("future_return")))
    return q.groupBy("date").agg(*[mean(i).alias(f"Q{i}") for i in range(1, 6)]).withColumn(
        "Q5_minus_Q1", F.col("Q5") - F.col("Q1")
    )


def quantile_summary(returns: DataFrame, periods: int = 12) -> DataFrame:
    names = [*QUANTILES, "Q5_minus_Q1"]
    return performance(returns.unpivot("date", names, "portfolio", "ret"), ("portfolio",), periods=periods)


def quantile_monotonicity(returns: DataFrame) -> DataFrame:
    full = returns.dropna(subset=list(QUANTILES))
    rising = F.lit(True)
    for a, b in zip(QUANTILES, QUANTILES[1:]):
        rising = rising & (F.col(a) <= F.col(b))
    spread = F.col("Q5") - F.col("Q1")
    return full.agg(
        share_if(spread > 0).alias("Q5_gt_Q1_fraction"), F.avg(spread).alias("average_Q5_minus_Q1"),
        F.median(spread).alias("median_Q5_minus_Q1"), share_if(rising).alias("monotonic_period_fraction"),
        *[F.avg(q).alias(f"average_{q}") for q in QUANTILES],
    )


def long_short(returns: DataFrame, periods: int = 12) -> DataFrame:
    s = returns.select("date", F.col("Q5_minus_Q1").alias("ret"), F.lit("research_long_short_spread").alias("series"))
    perf = performance(s, ("series",), periods=periods)
    r = F.col("ret")
    error = F.stddev_samp(r) / F.sqrt(F.count(r))
    moments = s.where(r.isNotNull()).groupBy("series").agg(
        F.avg(r).alias("mean_monthly_spread"), share_if(r > 0).alias("positive_month_fraction"),
        F.when(error > 0, F.try_divide(F.avg(r), error)).alias("naive_iid_t_stat"),
    )
    return perf.join(moments, "series").select(
        "series", "mean_monthly_spread", F.col("annual_return").alias("annualized_return"),
        F.col("annual_volatility").alias("annualized_volatility"), "sharpe", "positive_month_fraction", "naive_iid_t_stat",
    )


def sector_exposure(sectored: DataFrame, n: int = 25) -> DataFrame:
    """(date, sector, universe, top-N, Q5 and active weights), equal weighting.

    Input carries ``sector``; sectors are few, so everything after the ranks is
    a small two-level aggregation.
    """
    q = quantiles(sectored).select("date", "ticker", "sector", "ml_score", "quantile_number")
    marked = _flag_top(q, ("date",), n)
    counts = marked.groupBy("date", "sector").agg(
        F.count(F.lit(1)).alias("_u"), count_if(F.col("top")).alias("_t"),
        count_if(F.col("quantile_number") == 5).alias("_q"),
    )
    d = Window.partitionBy("date")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(d)), F.lit(0.0))
    return counts.select(
        "date", "sector", part("_u").alias("universe_weight"), part("_t").alias("topn_weight"),
        part("_q").alias("q5_weight"), (part("_t") - part("_u")).alias("active_sector_weight"),
    )


def sector_attribution(exposure: DataFrame, scores: DataFrame, n: int = 25) -> DataFrame:
    a = F.col("active_sector_weight")
    per_date = exposure.groupBy("date").agg((F.sum(F.abs(a)) / 2).alias("half_l1"))
    valid = scores.where(F.col("ml_score").isNotNull() & F.col("future_return").isNotNull())
    spread = _flag_top(valid, ("date",), n).groupBy("date").agg(
        (F.avg(F.when(F.col("top"), F.col("future_return"))) - F.avg("future_return")).alias("spread")
    )
    by_sector = exposure.groupBy("sector").agg(F.avg(a).alias("m")).agg(
        F.max_by("sector", F.struct("m", "sector")).alias("most_persistently_overweight_sector"),
        F.min_by("sector", F.struct("m", "sector")).alias("most_persistently_underweight_sector"),
    )
    overall = exposure.agg(F.avg(F.abs(a)).alias("average_absolute_sector_active_exposure"))
    dates = per_date.join(spread, "date", "left").agg(
        F.avg("half_l1").alias("average_sector_concentration_half_l1"),
        pearson(F.col("half_l1"), F.col("spread")).alias("concentration_topn_spread_correlation"),
    )
    return attach(attach(overall, dates), by_sector)


def current_sector_exposure(ranked_now: DataFrame, metadata: DataFrame, n: int) -> DataFrame:
    return sector_exposure(with_sector(ranked_now, metadata), n).select(
        "sector", F.col("universe_weight").alias("eligible_equal_weight"), F.col("q5_weight").alias("q5_equal_weight"),
        F.col("topn_weight").alias("topn_equal_weight"), F.col("active_sector_weight").alias("topn_active_equal_weight"),
    )


def stability_by_year(monthly: DataFrame) -> DataFrame:
    c = F.col("rank_ic")
    return monthly.groupBy(F.year("date").alias("year")).agg(
        F.count(c).alias("observations"), F.avg(c).alias("mean_rank_ic"), F.median(c).alias("median_rank_ic"),
        F.stddev_samp(c).alias("rank_ic_std"), share_if(c > 0).alias("positive_rank_ic_fraction"),
        F.avg("top_n_hit_rate").alias("top_n_hit_rate"), F.avg("top_n_spread").alias("average_top_n_return_spread"),
    )


def stability_rolling(monthly: DataFrame, window: int = 12) -> DataFrame:
    c = F.col("rank_ic")
    return monthly.select(
        "date", "rank_ic", "top_n_hit_rate", "top_n_spread",
        _rolling("rank_ic", window).alias("rolling_12m_mean_rank_ic"),
        _rolling(F.when(c.isNotNull(), flag(c > 0)), window).alias("rolling_12m_positive_ic_fraction"),
        _rolling("top_n_hit_rate", window).alias("rolling_12m_top_n_hit_rate"),
        _rolling("top_n_spread", window).alias("rolling_12m_top_n_spread"),
    )


def signal_decay(scores: DataFrame, monthly: DataFrame, benchmark: DataFrame, horizons=(1, 2, 3), n: int = 5) -> DataFrame:
    """Fixed scores against cumulative returns; the horizon is a key."""
    future = forward_returns(monthly, benchmark, horizons)
    keyed = scores.select("date", "ticker", "ml_score").join(future, ["date", "ticker"])
    m = monthly_metrics(
        keyed, ("horizon", "date"), ret="horizon_return", bench="horizon_benchmark_return", n=n
    )
    c = F.col("rank_ic")
    return m.groupBy(F.col("horizon").alias("horizon_months")).agg(
        F.count(c).alias("observations"), F.avg(c).alias("mean_rank_ic"), F.median(c).alias("median_rank_ic"),
        F.stddev_samp(c).alias("rank_ic_std"), share_if(c > 0).alias("positive_rank_ic_fraction"),
        ratio(F.avg(c), F.stddev_samp(c)).alias("rank_ic_ir"),
        F.avg("top_n_spread").alias("average_top_n_spread"), F.avg("top_n_hit_rate").alias("top_n_hit_rate"),
    )


def score_dispersion(scores: DataFrame, n: int = 5) -> DataFrame:
    s = F.col("ml_score")
    five = top_n(scores.select("date", "ticker", "ml_score"), ("date",), "ml_score", max(5, n)).groupBy("date").agg(
        F.avg(F.when(F.col("rank") <= 5, s)).alias("_five"), F.avg(F.when(F.col("rank") <= n, s)).alias("selected_score_average")
    )
    agg = scores.where(s.isNotNull()).groupBy("date").agg(
        F.avg(s).alias("score_mean"), F.stddev_samp(s).alias("score_std"), F.min(s).alias("score_min"),
        F.max(s).alias("score_max"), (F.max(s) - F.min(s)).alias("score_range"),
    )
    middle = medians(scores.select("date", "ticker", "ml_score"), ("date",), "ml_score", "_median")
    agg = agg.join(middle, "date").withColumn("top_1_minus_median_score", F.col("score_max") - F.col("_median")).drop("_median")
    return agg.join(five, "date").join(monthly_metrics(scores, n=n), "date", "left").select(
        *agg.columns, (F.col("_five") - F.col("score_mean")).alias("top_5_average_minus_universe_average"),
        "selected_score_average", "rank_ic", "top_n_hit_rate", "top_n_spread",
    )


def dispersion_correlations(details: DataFrame) -> DataFrame:
    names = ["score_std", "score_range", "top_1_minus_median_score", "top_5_average_minus_universe_average"]
    long = details.unpivot(["date", "top_n_spread", "rank_ic"], names, "dispersion_measure", "x")
    return long.groupBy("dispersion_measure").agg(
        pearson(F.col("x"), F.col("top_n_spread")).alias("correlation_with_top_n_spread"),
        pearson(F.col("x"), F.col("rank_ic")).alias("correlation_with_rank_ic"),
    )
