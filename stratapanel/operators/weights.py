"""Weight constraints, risk estimates and optimised portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stratapanel.functions.columns import count_if, near_zero
from stratapanel.operators.timeseries import change, on_calendar
from stratapanel.scale import even_width

STATUS_EQUAL = "equal"
STATUS_OPTIMIZED = "optimized"
FALLBACK = "fallback_equal:"


def cap_weights(weights: DataFrame, cap: float = 0.40, keys=("signal_date",), column="weight") -> DataFrame:
    """Project onto ``0 <= x <= cap, sum x = 1`` as ``clip(w - lambda, 0, cap)``.

    The sum is piecewise linear in lambda with knots ``w_i`` and ``w_i - cap``.
    Running sums over the sorted knots give its value at each of them, and
    lambda is interpolated between the two knots around 1: O(n log n), no pairs.
    """
    g = Window.partitionBy(*keys)
    clipped = F.greatest(F.col(column), F.lit(0.0))
    total = F.sum(clipped).over(g)
    raw = weights.withColumn(
        "_x", F.when(total > 0, clipped / total).otherwise(1.0 / F.count(F.lit(1)).over(g))
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    knots = raw.select(*keys, F.inline(F.array(
        F.struct(F.col("_x").alias("p"), F.lit(1.0).alias("s")),
        F.struct((F.col("_x") - cap).alias("p"), F.lit(-1.0).alias("s")),
    ))).withColumn("f", F.sum(F.col("s") * F.col("p")).over(w) - F.col("p") * F.sum("s").over(w))
    above, n = F.col("f") >= 1.0, F.count(F.lit(1)) / 2
    lo, hi = F.max(F.when(above, F.col("p"))), F.min(F.when(~above, F.col("p")))
    flo = F.max_by("f", F.when(above, F.col("p")))
    fhi = F.min_by("f", F.when(~above, F.col("p")))
    inner = F.try_divide(flo - 1.0, flo - fhi)
    lam = knots.groupBy(*keys).agg(
        F.when(n * cap < 1.0 - 1e-12, F.raise_error(F.lit("Maximum weight is infeasible")).cast("double"))
        # n * cap = 1 exactly: every weight sits at the cap.
        .when(lo.isNull(), F.min("p"))
        .otherwise(lo + F.coalesce(inner, F.lit(0.0)) * (hi - lo)).alias("_lambda")
    )
    return raw.join(lam, list(keys)).withColumn(
        column, F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("_x") - F.col("_lambda")))
    ).drop("_x", "_lambda")


def weight_violations(weights: DataFrame, keys=("strategy", "signal_date"), cap: float | None = None, tolerance=1e-6) -> DataFrame:
    """Groups that are duplicated, non-finite, negative, mis-summed or capped out."""
    w = F.col("weight")
    unusable = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    out = weights.groupBy(*keys).agg(
        (F.count("ticker") - F.count_distinct("ticker")).alias("duplicates"),
        count_if(unusable).alias("non_finite"), count_if(w < 0).alias("negative"),
        F.sum("weight").alias("total"), F.max("weight").alias("largest"),
    )
    bad = (
        (F.col("duplicates") > 0) | (F.col("non_finite") > 0) | (F.col("negative") > 0)
        | (F.abs(F.col("total") - 1.0) > tolerance)
    )
    return out.where(bad | (F.col("largest") > cap + tolerance) if cap is not None else bad)


def selection_history(selected: DataFrame, panel: DataFrame, lookback: int, keys=("strategy", "signal_date")) -> DataFrame:
    """Last ``lookback`` sessions up to each signal for its selected names.

    The signal's session ordinal turns the as-of range into an equi join: a
    selected row lists its ``lookback`` ordinals and meets the panel on
    (ticker, t).  Rows: top_n x lookback per signal.
    """
    # One list of sessions serves the signal dates and the prices alike.
    located = on_calendar(panel).withColumn("ret", change("close", 1)).select("date", "t", "ticker", "close", "ret")
    sessions = located.select(F.col("date").alias("signal_date"), F.col("t").alias("_s")).distinct()
    wanted = selected.select(*keys, "ticker").join(F.broadcast(sessions), "signal_date").withColumn(
        "t", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_s") - lookback + 1), F.col("_s")))
    )
    return wanted.join(located.select("t", "ticker", "close", "ret"), ["ticker", "t"], "left").withColumn(
        # A window's first session has no in-window predecessor.
        "ret", F.when(F.col("t") > F.greatest(F.lit(1), F.col("_s") - lookback + 1), F.col("ret"))
    ).drop("_s")


def history_status(history: DataFrame, minimum: int, keys=("strategy", "signal_date")) -> DataFrame:
    """(keys, status): whether the window is long enough and complete."""
    return history.groupBy(*keys).agg(
        F.count_distinct("t").alias("_sessions"),
        F.count(F.lit(1)).alias("_cells"), F.count("close").alias("_filled"),
    ).select(*keys, F.when(F.col("_sessions") < minimum, F.lit(FALLBACK + "insufficient_history"))
             .when(F.col("_filled") < F.col("_cells"), F.lit(FALLBACK + "missing_data"))
             .otherwise(F.lit(STATUS_OPTIMIZED)).alias("optimization_status"))


def covariance_pairs(history: DataFrame, frequency: int, keys=("strategy", "signal_date")) -> DataFrame:
    """Annualised sample covariance and correlation per pair of held names.

    Pairs only among the at most top_n names of one signal.
    """
    a = history.select(*keys, "t", F.col("ticker").alias("i"), F.col("ret").alias("x")).where("x is not null")
    b = history.select(*keys, "t", F.col("ticker").alias("j"), F.col("ret").alias("y")).where("y is not null")
    spread = F.stddev_samp("x") * F.stddev_samp("y")
    return a.join(b, [*keys, "t"]).groupBy(*keys, "i", "j").agg(
        (F.covar_samp("x", "y") * frequency).alias("covariance"),
        F.when(~near_zero(spread), F.try_divide(F.covar_samp("x", "y"), spread)).alias("correlation"),
        F.count(F.lit(1)).alias("observations"),
    )


def expected_returns(history: DataFrame, frequency: int, keys=("strategy", "signal_date")) -> DataFrame:
    """Compounded mean return per name, annualised."""
    return history.where("ret is not null").groupBy(*keys, "ticker").agg(
        (F.pow(F.product(1.0 + F.col("ret")), F.lit(float(frequency)) / F.count("ret")) - 1.0).alias("expected_return")
    )


def portfolio_risk(weights: DataFrame, pairs: DataFrame, keys=("strategy", "signal_date")) -> DataFrame:
    """sqrt(w' S w) from the pair table."""
    wi = weights.select(*keys, F.col("ticker").alias("i"), F.col("weight").alias("_wi"))
    wj = weights.select(*keys, F.col("ticker").alias("j"), F.col("weight").alias("_wj"))
    return pairs.join(wi, [*keys, "i"]).join(wj, [*keys, "j"]).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("_wi") * F.col("_wj") * F.col("covariance"))).alias("expected_volatility")
    )


def _bounded_minimum(sigma, c, cap):
    """min x'Sx/2 - c'x over the capped simplex: active set on few names."""
    import numpy as np

    n = len(c)
    x = np.full(n, 1.0 / n)
    state = np.zeros(n, dtype=int)  # -1 at zero, 1 at cap, 0 free
    for _ in range(50 * n):
        free = np.flatnonzero(state == 0)
        fixed = np.where(state == 1, cap, 0.0)
        if len(free):
            k = len(free)
            kkt = np.zeros((k + 1, k + 1))
            kkt[:k, :k] = sigma[np.ix_(free, free)]
            kkt[:k, k] = kkt[k, :k] = 1.0
            rhs = np.append(c[free] - sigma[free] @ fixed, 1.0 - fixed.sum())
            target = fixed.copy()
            target[free] = np.linalg.lstsq(kkt, rhs, rcond=None)[0][:k]
            step, hit = 1.0, None
            for i in free:
                d = target[i] - x[i]
                room = -x[i] if d < 0 else cap - x[i]
                if abs(d) > 1e-14 and abs(room) < abs(d) * step:
                    step, hit = abs(room / d), i
            moved = x + step * (target - x)
            if hit is not None:
                state[hit] = -1 if target[hit] < x[hit] else 1
                moved[hit] = 0.0 if state[hit] < 0 else cap
                x = moved
                continue
            x = target
        gradient = sigma @ x - c
        level = gradient[free].mean() if len(free) else np.median(gradient)
        gain = np.where(state == -1, level - gradient, np.where(state == 1, gradient - level, 0.0))
        if gain.max(initial=0.0) <= 1e-12 or not state.any():
            return x
        state[int(gain.argmax())] = 0
    return x


def _best_weights(returns, method, cap, rf, frequency):
    """Weights of one group of at most top_n names; None when it has no solution."""
    import numpy as np

    sigma = np.atleast_2d(np.cov(returns, rowvar=False, ddof=1)) * frequency
    n = sigma.shape[0]
    if method == "min_vol":
        return _bounded_minimum(sigma, np.zeros(n), cap)
    mu = np.prod(1.0 + returns, axis=0) ** (frequency / len(returns)) - 1.0 - rf
    if (mu <= 0).all():
        return None

    def at(log_tau):
        x = _bounded_minimum(sigma, np.exp(log_tau) * mu, cap)
        return (mu @ x) / np.sqrt(max(x @ sigma @ x, 1e-18)), x

    # Sharpe is unimodal along the frontier but flat at its ends: bracket the
    # best risk tolerance on a grid, then refine by golden section.
    grid = np.linspace(-10.0, 6.0, 25)
    k = int(np.argmax([at(t)[0] for t in grid]))
    lo, hi, g = grid[max(k - 1, 0)], grid[min(k + 1, 24)], (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if at(a)[0] >= at(b)[0] else (a, hi)
    return max((at(t) for t in (lo, hi, grid[k])), key=lambda v: v[0])[1]


def spread(rows: DataFrame, keys) -> DataFrame:
    """Hash by group into a fixed width: small but CPU-heavy groups would
    otherwise be coalesced into one task."""
    return rows.repartition(even_width(rows), *keys)


def optimized_weights(
    selected: DataFrame, panel: DataFrame, method: str, cap: float = 0.40, lookback: int = 252,
    minimum: int | None = None, rf: float = 0.0, frequency: int = 252, keys=("strategy", "signal_date"),
) -> DataFrame:
    """Adds ``weight`` and ``optimization_status`` to the selected names.

    Status is settled relationally first; only clean windows reach the grouped
    Arrow job, one group per signal with at most top_n x lookback rows.  Anything
    else falls back to equal weights, with the reason on record.
    """
    if method not in ("min_vol", "max_sharpe"):
        raise ValueError(f"Unknown weighting method: {method}")
    history = selection_history(selected, panel, lookback, keys)
    status = history_status(history, minimum or lookback, keys)
    clean = history.join(status.where(F.col("optimization_status") == STATUS_OPTIMIZED), list(keys), "left_semi")

    def solve(pdf):
        import pandas as pd

        wide = pdf.pivot(index="t", columns="ticker", values="ret").sort_index().dropna()
        out = _best_weights(wide.to_numpy(float), method, cap, rf, frequency) if wide.shape[1] > 1 else [1.0]
        first = {k: pdf[k].iloc[0] for k in keys}
        if out is None:
            out = [None] * wide.shape[1]
        return pd.DataFrame({**first, "ticker": list(wide.columns), "solved": out})[[*keys, "ticker", "solved"]]

    fields = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in (*keys, "ticker")) + ", solved double"
    rows = spread(clean.where("ret is not null").select(*keys, "ticker", "t", "ret"), keys)
    solved = rows.groupBy(*keys).applyInPandas(solve, schema)
    joined = selected.join(status, list(keys), "left").join(solved, [*keys, "ticker"], "left")
    g = Window.partitionBy(*keys)
    complete = F.count("solved").over(g) == F.count(F.lit(1)).over(g)
    out = joined.withColumn(
        "optimization_status",
        F.when(F.col("optimization_status") != STATUS_OPTIMIZED, F.col("optimization_status"))
        .when(complete, F.col("optimization_status"))
        .otherwise(F.lit(FALLBACK + "optimizer_failure")),
    ).withColumn("weight", F.when(complete, F.col("solved")).otherwise(1.0 / F.count(F.lit(1)).over(g))).drop("solved")
    return cap_weights(out, cap, keys)
