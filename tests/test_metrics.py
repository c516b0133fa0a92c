import numpy as np
import pandas as pd
import pytest
from conftest import month_ends
from pyspark.sql import functions as F

from stratapanel.operators import attribution as A, metrics as M, robustness as X


def test_sortino_and_drawdown(returns):
    out = {r["strategy"]: r for r in M.performance(returns({"s": [0.1, -0.1], "d": [-0.2, 0.1]})).collect()}
    assert out["s"]["sortino"] == pytest.approx(0.0)
    assert out["d"]["max_drawdown"] == pytest.approx(-0.2)
    assert out["d"]["sortino"] == pytest.approx(-0.05 / np.sqrt(0.02) * np.sqrt(12))


def test_total_loss_and_constant_series(returns):
    out = {r["strategy"]: r for r in M.performance(returns({"lost": [0.1, -1.0, 0.5], "flat": [0.01, 0.01, 0.01]})).collect()}
    assert out["lost"]["annual_return"] == -1.0
    assert out["flat"]["sharpe"] is None and out["flat"]["calmar"] is None


def test_common_period_keeps_shared_dates(returns):
    d = month_ends(6)
    frames = [returns({f"s{k}": [0.01] * (6 - k)}, d[k:]) for k in range(5)]
    all_rows = frames[0]
    for f in frames[1:]:
        all_rows = all_rows.unionByName(f)
    assert sorted({r["date"] for r in M.common_period(all_rows).collect()}) == d[4:]
    assert M.return_date_violations(all_rows.unionByName(frames[0])).count() == 6


def test_short_rolling_sample_is_null(returns):
    out = M.rolling_risk(returns({"s": [0.01, 0.02, 0.03, 0.01, 0.0], "benchmark": [0.0] * 5}), 12).collect()
    assert len(out) == 10
    assert all(r[c] is None for r in out for c in ("annualized_return", "sharpe_ratio", "beta", "maximum_drawdown"))


def test_rolling_24_constant(returns):
    details = M.rolling_robustness(returns({"s": [0.02] * 30, "benchmark": [0.01, 0.0] * 15}), 24)
    assert {r["observations"] for r in details.collect()} == {24}
    assert M.rolling_summary(details).collect()[0]["positive_active_return_ratio"] == 1.0


def test_drawdown_episode(returns):
    d = month_ends(4)
    r = M.drawdown_episodes(returns({"s": [0.10, -0.20, 0.10, 0.20]})).collect()[0]
    assert (r["drawdown_start"], r["trough_date"], r["recovery_date"], r["drawdown_duration"]) == (d[0], d[1], d[3], 3)
    opened = M.drawdown_episodes(returns({"s": [-0.1, 0.05, -0.2]})).collect()[0]
    assert (opened["drawdown_start"], opened["recovery_date"], opened["drawdown_duration"]) == (d[0], None, 2)
    calm = M.drawdown_episodes(returns({"s": [0.1, 0.1]})).collect()[0]
    assert calm["maximum_drawdown"] == 0.0 and calm["longest_drawdown_duration"] == 0


def test_outliers_match_pandas(returns):
    rng = np.random.default_rng(1)
    values = list(rng.normal(0.01, 0.05, 40))
    r = M.outlier_diagnostics(returns({"s": values})).collect()[0]
    s = pd.Series(values)
    assert r["skewness"] == pytest.approx(s.skew()) and r["excess_kurtosis"] == pytest.approx(s.kurt())
    assert r["best_3_month_arithmetic_share"] == pytest.approx(s.nlargest(3).sum() / s.sum())


def test_outlier_removal(returns):
    d = month_ends(12)
    common = returns({"s": [i / 100 for i in range(12)]})
    out = {r["counterfactual"]: r for r in M.outlier_counterfactuals(common).collect()}
    assert out["remove_best_3_months"]["observations"] == 9
    assert out["remove_best_1_months"]["removed_months"] == str(d[11])
    assert M.outlier_diagnostics(common).collect()[0]["best_month"] == d[11]


def test_yearly_leaders(returns):
    d = month_ends(3, 2020, 11)
    common = returns({"alpha": [0.05, 0.05, 0.01], "beta": [-0.01, 0.0, 0.03], "benchmark": [0.02, 0.01, 0.02]}, d)
    out = {r["year"]: r for r in M.yearly_analysis(common, ["alpha", "beta"]).collect()}
    assert out[2020]["partial_year"] and out[2020]["best_strategy"] == "alpha" and out[2020]["worst_strategy"] == "beta"
    assert out[2021]["best_strategy"] == "beta"


def test_subperiods_must_not_overlap(returns):
    with pytest.raises(ValueError):
        M.subperiod_performance(returns({"benchmark": [0.1]}), [("a", "2020-01-01", "2020-06-30"), ("b", "2020-06-30", "2020-12-31")])


@pytest.fixture(scope="module")
def book(spark):
    d = month_ends(2)
    pos = spark.createDataFrame(
        [("s", d[0], d[1], "A", 0.6, 0.10), ("s", d[0], d[1], "B", 0.4, -0.05)],
        "strategy string, signal_date date, date date, ticker string, weight double, asset_return double")
    led = spark.createDataFrame([("s", d[1], 0.04, 0.001)], "strategy string, date date, gross_return double, transaction_cost double")
    return pos, led


def test_attribution_reconciles(book):
    pos, led = book
    out = {r["ticker"]: r["contribution"] for r in A.contribution_by_ticker(pos, led).collect()}
    assert out["A"] + out["B"] == pytest.approx(0.04) and out["TRANSACTION_COST"] == pytest.approx(-0.001)
    assert A.attribution_violations(pos, led).count() == 0
    assert A.attribution_violations(pos, led.withColumn("gross_return", F.lit(0.05))).count() == 1


def test_concentration(spark):
    d = month_ends(1)[0]
    pos = spark.createDataFrame([("s", d, f"t{i}", 0.25) for i in range(4)], "strategy string, date date, ticker string, weight double")
    r = A.concentration(pos).collect()[0]
    assert r["hhi"] == pytest.approx(0.25) and r["effective_holdings"] == pytest.approx(4)


def test_ticker_streaks(spark):
    d = month_ends(5)
    held = {"A": [0, 1, 2, 4], "B": [0, 1, 2, 3, 4], "C": [3]}
    rows = [("s", d[i], d[i], t, 0.5) for t, seqs in held.items() for i in seqs]
    pos = spark.createDataFrame(rows, "strategy string, signal_date date, date date, ticker string, weight double")
    out = {r["ticker"]: r for r in A.ticker_stability(pos).collect()}
    assert (out["A"]["longest_consecutive_holding_streak"], out["A"]["entries"], out["A"]["exits"]) == (3, 2, 1)
    assert (out["C"]["entries"], out["C"]["exits"], out["C"]["median_weight"]) == (1, 1, 0.0)
    assert out["B"]["held_period_fraction"] == 1.0


def test_bootstrap_matches_numpy(returns):
    import hashlib

    rng = np.random.default_rng(2)
    n, sims, block, seed = 17, 20, 6, 42
    s, b = rng.normal(0.01, 0.04, n), rng.normal(0.008, 0.03, n)
    common = returns({"s": list(s), "benchmark": list(b)})
    out = {r["sim"]: r for r in X.bootstrap_paths(common, sims, (block,), seed).collect()}
    assert sorted(out) == list(range(sims))
    for sim in range(sims):
        idx = []
        for k in range(-(-n // block)):
            start = int(hashlib.md5(f"{seed}:{sim}:{k}".encode()).hexdigest()[:8], 16) % n
            idx += [(start + o) % n for o in range(block)]
        idx = idx[:n]
        x, y = s[idx], b[idx]
        wealth = np.cumprod(1 + x)
        peak = np.maximum.accumulate(np.r_[1.0, wealth])[1:]
        assert out[sim]["max_drawdown"] == pytest.approx(min(0, (wealth / peak - 1).min()))
        assert out[sim]["annual_volatility"] == pytest.approx(x.std(ddof=1) * np.sqrt(12))
        assert out[sim]["information_ratio"] == pytest.approx((x - y).mean() / (x - y).std(ddof=1) * np.sqrt(12))
        assert out[sim]["benchmark_annual_return"] == pytest.approx(np.prod(1 + y) ** (12 / n) - 1)


def test_bootstrap_constant_active(returns):
    b = [0.01, -0.02, 0.03] * 6
    common = returns({"s": [x + 0.01 for x in b], "benchmark": b})
    assert all(r["annual_active_return"] == pytest.approx(0.12) for r in X.bootstrap_paths(common, 20, (6,)).collect())
