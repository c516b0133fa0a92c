import numpy as np
import pandas as pd
import pytest
from conftest import month_ends
from pyspark.sql import functions as F

from stratapanel.operators import ledger as L, weights as W


@pytest.fixture(scope="module")
def drift_panel(panel):
    return panel({"A": [100, 110, 121, 133.1], "B": [100, 105, 105, 105], "C": [100, 90, 80, 70]})


def test_drift_turnover(drift_panel):
    led = L.periods(L.momentum_positions(drift_panel, 1, 0, 2, max_weight=0.5), cost_bps=0).orderBy("seq").collect()
    dates = month_ends(4)
    assert (led[0]["signal_date"], led[0]["date"]) == (dates[1], dates[2])
    assert led[0]["turnover"] == 1.0
    assert led[1]["turnover"] == pytest.approx(abs(0.5 - 0.5 * 1.1 / 1.05))
    assert led[0]["transaction_cost"] == 0.0
    assert led[0]["gross_return"] == pytest.approx(0.05)


def test_missing_outcome_fails_and_is_not_replaced(panel):
    p = panel({"A": [100, 120, None], "B": [100, 110, 121]})
    positions = L.momentum_positions(p, 1, 0, 1, max_weight=1.0)
    assert [r["ticker"] for r in L.outcome_violations(positions).collect()] == ["A"]
    with pytest.raises(Exception, match="Missing next-period returns"):
        L.periods(positions).collect()
    assert L.periods(positions, strict=False).collect()[0]["gross_return"] is None


def test_score_rank_comes_before_outcome(spark):
    d = month_ends(2)
    rows = [(d[0], d[1], "A", 0.9, None), (d[0], d[1], "B", 0.8, 0.1)]
    scores = spark.createDataFrame(rows, "date date, target_date date, ticker string, ml_score double, future_return double")
    assert [r["ticker"] for r in L.outcome_violations(L.score_positions(scores, 1)).collect()] == ["A"]
    blank = scores.withColumn("future_return", F.lit(None).cast("double"))
    assert L.score_positions(blank, 1).count() == 0


def test_infeasible_cap(drift_panel):
    with pytest.raises(Exception, match="infeasible"):
        L.momentum_positions(drift_panel, 1, 0, 2, max_weight=0.4).collect()


def test_delayed_ledger_shifts_dates(panel):
    p = panel({"A": [100, 110, 121, 130, 140], "B": [100, 100, 101, 102, 103]})
    pos = L.momentum_positions(p, 1, 0, 2, max_weight=0.5)
    later = L.delayed_positions(pos, p)
    d = month_ends(5)
    assert sorted({(r["signal_date"], r["execution_date"], r["date"]) for r in later.collect()}) == [(d[1], d[2], d[3]), (d[2], d[3], d[4])]
    one = {r["ticker"]: r["asset_return"] for r in later.where(F.col("signal_date") == d[1]).collect()}
    assert one == {"A": pytest.approx(130 / 121 - 1), "B": pytest.approx(102 / 101 - 1)}


def test_cost_levels_are_monotone(drift_panel):
    led = L.with_costs(L.periods(L.momentum_positions(drift_panel, 1, 0, 2, max_weight=0.5)), (0, 10, 100))
    total = {r["cost_bps"]: r["s"] for r in led.groupBy("cost_bps").agg(F.sum("transaction_cost").alias("s")).collect()}
    assert total[0] == 0 and total[0] < total[10] < total[100]


def bisect_cap(w, cap):
    x = np.clip(np.asarray(w, float), 0, None)
    x = x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))
    lo, hi = x.min() - cap, x.max()
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(x - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(x - hi, 0, cap)


@pytest.mark.parametrize("weights,cap", [
    ([0.8, 0.1, 0.1], 0.4), ([0.5, 0.3, 0.2], 0.9), ([0.0, 0.0, 0.0], 0.5), ([-1.0, 0.5, 0.6], 0.7), ([0.7, 0.2, 0.05, 0.05], 0.25), ([5.0, 1.0, 1.0, 1.0], 0.3),
])
def test_cap_projection(spark, weights, cap):
    df = spark.createDataFrame([("d", f"t{i}", w) for i, w in enumerate(weights)], "signal_date string, ticker string, weight double")
    out = [r["weight"] for r in W.cap_weights(df, cap).orderBy("ticker").collect()]
    assert out == pytest.approx(list(bisect_cap(weights, cap)), abs=1e-9)
    assert sum(out) == pytest.approx(1.0)


def test_cap_infeasible(spark):
    df = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.5)], "signal_date string, ticker string, weight double")
    with pytest.raises(Exception, match="infeasible"):
        W.cap_weights(df, 0.4).collect()


def test_weight_violations(spark):
    rows = [("ok", "a", 0.5), ("ok", "b", 0.5), ("sum", "a", 0.7), ("neg", "a", 1.2), ("neg", "b", -0.2), ("dup", "a", 0.5), ("dup", "a", 0.5)]
    df = spark.createDataFrame(rows, "strategy string, ticker string, weight double")
    assert {r["strategy"] for r in W.weight_violations(df, ("strategy",)).collect()} == {"sum", "neg", "dup"}
    assert {r["strategy"] for r in W.weight_violations(df, ("strategy",), cap=0.4).collect()} == {"ok", "sum", "neg", "dup"}


def test_optimised_weights_satisfy_optimality(panel):
    rng = np.random.default_rng(5)
    wide = {f"T{i}": list(100 * np.cumprod(1 + rng.normal(0.01, 0.03 + 0.01 * i, 30))) for i in range(5)}
    p = panel(wide)
    selected = L.momentum_selection(p, 3, 0, 4, "m").drop("rank")
    for method in ("min_vol", "max_sharpe"):
        out = W.optimized_weights(selected, p, method, cap=0.4, lookback=12, frequency=12).toPandas()
        status = out.groupby("signal_date")["optimization_status"].first()
        assert (status.iloc[:8] == "fallback_equal:insufficient_history").all()
        assert (status.iloc[9:] == "optimized").any()
        sums = out.groupby("signal_date")["weight"].sum()
        assert np.allclose(sums, 1) and out["weight"].max() <= 0.4 + 1e-9 and out["weight"].min() >= 0
        date = status[status == "optimized"].index[-1]
        held = out[out["signal_date"] == date].sort_values("ticker")
        frame = pd.DataFrame(wide, index=month_ends(30)).loc[:date, list(held["ticker"])].tail(12).pct_change().dropna()
        sigma, mu = frame.cov().to_numpy() * 12, (1 + frame).prod().to_numpy() ** (12 / len(frame)) - 1
        w = held["weight"].to_numpy()

        def score(v):
            risk = v @ sigma @ v
            return -risk if method == "min_vol" else (mu @ v) / np.sqrt(risk)

        others = [v for v in rng.dirichlet(np.ones(len(w)), 20000) if v.max() <= 0.4]
        assert score(w) >= max(score(v) for v in others) - 1e-6
