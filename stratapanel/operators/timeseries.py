"""Calendar-aligned time-series operators over sparse long panels.

Lags step over *calendar* sessions, not over a security's own rows: every date
carries its ordinal ``t`` and the frames are RANGE frames on ``t``.  A missing
cell is an absent row, so a gap yields NULL instead of a longer-period return,
and no dates x tickers grid is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import annual_volatility

FEATURES = ("momentum_1m", "momentum_3m", "momentum_6m", "volatility_3m", "drawdown_3m")


def calendar(panel: DataFrame) -> DataFrame:
    """(date, t, next_date): one row per observed session of the whole panel.

    Bounded by the number of sessions in history, so one task numbers it.
    """
    w = Window.orderBy("date")
    return (
        panel.select("date")
        .distinct()
        .select(
            "date",
            F.row_number().over(w).alias("t"),
            F.lead("date").over(w).alias("next_date"),
        )
    )


def on_calendar(panel: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Attach ``t`` and ``next_date``.  Broadcast: one row per session."""
    sessions = calendar(panel) if sessions is None else sessions
    return panel.join(F.broadcast(sessions), "date")


def series(keys: tuple[str, ...] = ("ticker",)):
    return Window.partitionBy(*keys).orderBy("t")


def lagged(column: str | Column, k: int, keys=("ticker",)) -> Column:
    """Value exactly ``k`` sessions earlier (later for negative ``k``)."""
    return F.first(column).over(series(keys).rangeBetween(-k, -k))


def trailing(k: int, keys=("ticker",)):
    return series(keys).rangeBetween(-(k - 1), 0)


def full_window(aggregate, column: str, k: int, keys=("ticker",)) -> Column:
    """Aggregate over the last ``k`` sessions, NULL unless all are observed."""
    w = trailing(k, keys)
    return F.when(F.count(column).over(w) == k, aggregate(column).over(w))


def change(column: str, k: int = 1, keys=("ticker",)) -> Column:
    return F.try_divide(F.col(column), lagged(column, k, keys)) - 1.0


def month_end_sessions(panel: DataFrame) -> DataFrame:
    """Last observed session of every month, over the whole panel."""
    return (
        panel.select("date").distinct()
        .groupBy(F.trunc("date", "month").alias("_month"))
        .agg(F.max("date").alias("date"))
        .select("date")
    )


def last_observation_by_month(panel: DataFrame) -> DataFrame:
    """Rows of each month's final session; a security missing then stays missing."""
    return panel.join(F.broadcast(month_end_sessions(panel)), "date", "left_semi")


def simple_returns(panel: DataFrame, keys=("ticker",)) -> DataFrame:
    return on_calendar(panel).withColumn("ret", change("close", 1, keys))


def momentum(panel: DataFrame, lookback: int, skip: int = 0, name: str = "momentum") -> DataFrame:
    """(date, ticker, name, asset_return, next_date): ``P[t-skip]/P[t-lookback] - 1``.

    ``asset_return`` is the outcome from ``t`` to ``next_date``.  Everything is
    read from one sort at session ``t-skip`` and then re-dated to ``t``, so a
    security missing at ``t`` itself keeps its signal; NULL signals are dropped.
    """
    if lookback < 1 or skip < 0 or skip >= lookback:
        raise ValueError("Need 0 <= skip < lookback.")
    sessions = calendar(panel)
    signal = (
        on_calendar(panel, sessions)
        .select(
            "date", "next_date", (F.col("t") + skip).alias("t"), "ticker",
            change("close", lookback - skip).alias(name),
            (F.try_divide(lagged("close", -skip - 1), lagged("close", -skip)) - 1.0).alias("asset_return"),
        )
        .where(F.col(name).isNotNull())
    )
    if skip:
        signal = signal.drop("date", "next_date").join(F.broadcast(sessions), "t")
    return signal.select("date", "t", "ticker", name, "asset_return", "next_date")


def rolling_volatility(panel: DataFrame, window: int = 60, periods: int = 252) -> DataFrame:
    """Annualised sample volatility of returns over a complete window."""
    return simple_returns(panel).withColumn(
        "volatility", annual_volatility(full_window(F.stddev_samp, "ret", window), periods)
    )


def sample_volatility(panel: DataFrame, periods: int = 252) -> DataFrame:
    return (
        simple_returns(panel).groupBy("ticker")
        .agg(annual_volatility(F.stddev_samp("ret"), periods).alias("volatility"))
    )


def moving_average_ratio(panel: DataFrame, window: int) -> DataFrame:
    return on_calendar(panel).withColumn(
        "ma_ratio", F.try_divide(F.col("close"), full_window(F.avg, "close", window)) - 1.0
    )


def rolling_drawdown(panel: DataFrame, window: int = 60) -> DataFrame:
    return on_calendar(panel).withColumn(
        "drawdown", F.try_divide(F.col("close"), full_window(F.max, "close", window)) - 1.0
    )


def factor_table(panel: DataFrame) -> DataFrame:
    """20/60/120-session momentum and 60-session volatility from one sort."""
    return simple_returns(panel).select(
        "date", "t", "ticker",
        change("close", 20).alias("momentum_20d"),
        change("close", 60).alias("momentum_60d"),
        change("close", 120).alias("momentum_120d"),
        annual_volatility(full_window(F.stddev_samp, "ret", 60), 252).alias("volatility_60d"),
    )


def latest_factor_snapshot(factors: DataFrame) -> DataFrame:
    """Complete rows at the panel's last session."""
    names = [c for c in factors.columns if c not in ("date", "t", "ticker")]
    last = factors.agg(F.max("date").alias("date"))
    return factors.join(F.broadcast(last), "date", "left_semi").dropna(subset=names).select(
        "date", "ticker", *names
    )


def _with_features(frame: DataFrame) -> DataFrame:
    w3 = trailing(3)
    return (
        frame.withColumn("momentum_1m", change("close", 1))
        .withColumn("momentum_3m", change("close", 3))
        .withColumn("momentum_6m", change("close", 6))
        .withColumn(
            "drawdown_3m",
            F.try_divide(F.col("close"), F.when(F.count("close").over(w3) == 3, F.max("close").over(w3))) - 1.0,
        )
        .withColumn(
            "volatility_3m",
            F.when(F.count("momentum_1m").over(w3) == 3, F.stddev_samp("momentum_1m").over(w3)) * 12**0.5,
        )
    )


def feature_panel(monthly: DataFrame) -> DataFrame:
    """Five monthly features; partially filled rows are kept."""
    return _with_features(on_calendar(monthly)).select("date", "ticker", *FEATURES)


def benchmark_returns(benchmark: DataFrame) -> DataFrame:
    """(date, bench): one-period return of the reference series (month rows)."""
    w = Window.orderBy("date")
    return benchmark.select(
        "date", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0).alias("bench")
    )


def labelled_dataset(monthly: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Features at ``t`` with outcomes realised at ``t+1``.

    Rows are kept by feature completeness alone; an unavailable outcome leaves
    the label columns NULL and never removes the row.
    """
    outcome = benchmark_returns(benchmark).select(
        F.col("date").alias("target_date"), F.col("bench").alias("benchmark_return")
    )
    frame = (
        _with_features(on_calendar(monthly))
        .withColumn("future_return", F.try_divide(lagged("close", -1), F.col("close")) - 1.0)
        .dropna(subset=list(FEATURES))
        .withColumnRenamed("next_date", "target_date")
        .join(F.broadcast(outcome), "target_date", "left")
    )
    known = F.col("future_return").isNotNull() & F.col("benchmark_return").isNotNull()
    return frame.select(
        "date", "ticker", *FEATURES, "future_return", "target_date", "benchmark_return",
        F.when(known, (F.col("future_return") > F.col("benchmark_return")).cast("int")).alias("target"),
    )


def calendar_violations(panel: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(ticker, panel_date, benchmark_date): months whose last observation of a security is not the benchmark's."""
    month = F.trunc("date", "month").alias("month")
    own = panel.where(F.col("close").isNotNull()).groupBy("ticker", month).agg(F.max("date").alias("panel_date"))
    reference = benchmark.groupBy(month).agg(F.max("date").alias("benchmark_date"))
    # The calendar's months, as one short array for every security.
    months = reference.agg(F.sort_array(F.collect_list(F.struct("month", "benchmark_date")))).scalar()
    expected = panel.select("ticker").distinct().withColumn("_m", months).select("ticker", F.inline("_m"))
    return own.join(expected, ["ticker", "month"], "full_outer").where(
        ~F.col("panel_date").eqNullSafe(F.col("benchmark_date"))
    ).select("ticker", "panel_date", "benchmark_date")


def average_dollar_volume(panel: DataFrame, window: int = 20) -> DataFrame:
    """(date, t, ticker, adv): mean of price x volume over the ``window``
    sessions strictly before ``date``; any invalid cell voids the window."""
    sessions = calendar(panel)
    price, volume = F.col("raw_close"), F.col("volume")
    infinite = float("inf")
    valid = (price > 0) & (volume > 0) & (price < infinite) & (volume < infinite)
    return (
        on_calendar(panel, sessions)
        .withColumn("_dollars", F.when(valid, price * volume))
        .withColumn("adv", full_window(F.avg, "_dollars", window))
        .where(F.col("adv").isNotNull())
        .select((F.col("t") + 1).alias("t"), "ticker", "adv")
        .join(F.broadcast(sessions), "t")
        .select("date", "t", "ticker", "adv")
    )


def forward_returns(monthly: DataFrame, benchmark: DataFrame, horizons=(1, 2, 3)) -> DataFrame:
    """(date, ticker, horizon, horizon_return, horizon_benchmark_return)."""
    def stacked(frame: DataFrame, keys, name: str) -> DataFrame:
        options = [
            F.struct(
                F.lit(h).alias("horizon"),
                (F.try_divide(lagged("close", -h, keys), F.col("close")) - 1.0).alias(name),
            )
            for h in horizons
        ]
        return frame.select(*[c for c in ("date", "ticker") if c in frame.columns], F.array(*options).alias("_h"))

    stock = stacked(on_calendar(monthly), ("ticker",), "horizon_return").select(
        "date", "ticker", F.inline("_h")
    )
    one = on_calendar(benchmark).withColumn("_all", F.lit(1))
    bench = stacked(one, ("_all",), "horizon_benchmark_return").select("date", F.inline("_h"))
    return stock.join(F.broadcast(bench), ["date", "horizon"], "left")


def wealth_path(returns: DataFrame, keys=("strategy",), ret: str = "ret") -> DataFrame:
    """Adds cumulative ``wealth`` and ``drawdown`` with initial capital 1 as first peak."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        returns.where(F.col(ret).isNotNull())
        .withColumn("wealth", F.product(1.0 + F.col(ret)).over(w))
        .withColumn(
            "drawdown",
            F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1.0,
        )
    )


def outcomes(monthly: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(date, ticker, asset_return, next_date): return earned from ``date`` on; ``sessions``: the calendar where ``monthly`` is a part of a panel."""
    return on_calendar(monthly, sessions).select(
        "date", "ticker", (F.try_divide(lagged("close", -1), F.col("close")) - 1.0).alias("asset_return"),
        "next_date",
    )


def session_grid(tickers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(date, ticker) for every session of every ticker.

    Only for reports that must show missing cells.  The session list is one
    calendar-bounded array, exploded next to each ticker: no join.
    """
    listed = sessions.agg(F.sort_array(F.collect_set("date"))).scalar()
    return tickers.select("ticker").distinct().withColumn("_d", listed).select(
        F.explode("_d").alias("date"), "ticker"
    )
