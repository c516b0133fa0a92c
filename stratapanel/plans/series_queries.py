"""Bound queries: time series, ranking, weights, ledgers (F, R, W, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import ledger as L, ranking as R, timeseries as T, weights as W
from stratapanel.operators import metrics as M, scenarios as N, universe as U
from stratapanel.plans import bindings as B
from stratapanel.plans.oracle_base import FEATURES, evaluated, frag, ledger, momentum_pos, out, query, score_pos
from stratapanel.plans.registry import register

FEATS = " ".join(FEATURES)
MONTHS = lambda s, d: B.closes(B.brand(s, d))
DAYS = lambda s, d: B.closes(B.region_days(s, d))

# --- F: features -----------------------------------------------------------
register(
    "f1_month_end",
    lambda s, d: T.last_observation_by_month(B.nation_days(s, d)).select("date", "ticker", "close"),
    out("px_n", "date ticker", "close", where="date IN (SELECT max(date) FROM px_n GROUP BY date_trunc('month', date))"),
)
register(
    "f2_returns", lambda s, d: T.simple_returns(DAYS(s, d)).where("ret is not null").select("date", "ticker", "ret"),
    query("SELECT date, ticker, round(momentum_1m, 6) + 0.0 AS ret FROM lag_r WHERE momentum_1m IS NOT NULL"),
)
register(
    "f3_momentum",
    lambda s, d: T.momentum(DAYS(s, d), 60, 0, "momentum_60").select("date", "ticker", "momentum_60"),
    out("(SELECT date, ticker, close / lag(close, 60) OVER (PARTITION BY ticker ORDER BY date) - 1 AS momentum_60 FROM grid_r)",
        "date ticker", "momentum_60", where="momentum_60 IS NOT NULL"),
)
register(
    "f4_momentum_skip",
    lambda s, d: T.momentum(B.closes(B.supplier(s, d)), 12, 1, "momentum_12_1").select("date", "ticker", "momentum_12_1"),
    out("lag_s", "date ticker", "momentum_12_1", where="momentum_12_1 IS NOT NULL"),
)
register(
    "f5_rolling_volatility",
    lambda s, d: T.rolling_volatility(DAYS(s, d), 60).where("volatility is not null").select("date", "ticker", "volatility"),
    out("""(SELECT date, ticker, CASE WHEN count(momentum_1m) OVER w = 60 THEN stddev_samp(momentum_1m) OVER w * sqrt(252) END AS volatility
      FROM lag_r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""",
        "date ticker", "volatility", where="volatility IS NOT NULL"),
)
register(
    "f6_sample_volatility", lambda s, d: T.sample_volatility(DAYS(s, d)),
    out("(SELECT ticker, stddev_samp(momentum_1m) * sqrt(252) AS volatility FROM lag_r GROUP BY 1)", "ticker", "volatility"),
)
register(
    "f7_moving_average_ratio",
    lambda s, d: T.moving_average_ratio(DAYS(s, d), 20).where("ma_ratio is not null").select("date", "ticker", "ma_ratio"),
    out("""(SELECT date, ticker, CASE WHEN count(close) OVER w = 20 THEN close / avg(close) OVER w - 1 END AS ma_ratio FROM grid_r
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
        "date ticker", "ma_ratio", where="ma_ratio IS NOT NULL"),
)
register(
    "f8_rolling_drawdown",
    lambda s, d: T.rolling_drawdown(DAYS(s, d), 60).where("drawdown is not null").select("date", "ticker", "drawdown"),
    out("""(SELECT date, ticker, CASE WHEN count(close) OVER w = 60 THEN close / max(close) OVER w - 1 END AS drawdown FROM grid_r
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""",
        "date ticker", "drawdown", where="drawdown IS NOT NULL"),
)
frag("factors", """SELECT date, ticker, close / lag(close, 20) OVER w - 1 AS momentum_20d, close / lag(close, 60) OVER w - 1 AS momentum_60d,
  close / lag(close, 120) OVER w - 1 AS momentum_120d,
  CASE WHEN count(momentum_1m) OVER w60 = 60 THEN stddev_samp(momentum_1m) OVER w60 * sqrt(252) END AS volatility_60d, close
  FROM lag_r WINDOW w AS (PARTITION BY ticker ORDER BY date), w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
FACTORS = "momentum_20d momentum_60d momentum_120d volatility_60d"
register(
    "f9_factor_table", lambda s, d: T.factor_table(DAYS(s, d)).drop("t"),
    out("factors", "date ticker", FACTORS, where="close IS NOT NULL"),
)
register(
    "f10_latest_factors", lambda s, d: T.latest_factor_snapshot(T.factor_table(DAYS(s, d))),
    out("factors", "date ticker", FACTORS,
        where="date = (SELECT max(date) FROM px_r) AND " + " AND ".join(f"{c} IS NOT NULL" for c in FACTORS.split())),
)
register(
    "f11_feature_panel", lambda s, d: T.feature_panel(B.closes(B.supplier(s, d))),
    out("feat_s", "date ticker", FEATS, where="close IS NOT NULL"),
)
register(
    "f12_labelled_dataset", B.supplier_dataset,
    out("ds_s", "date ticker target_date", FEATS + " future_return benchmark_return", "target"),
)
RAW = lambda panel: panel.withColumnRenamed("close", "raw_close")
ADV = """(SELECT date, ticker, CASE WHEN count(d) OVER w = {n} THEN avg(d) OVER w END AS adv FROM
 (SELECT date, ticker, CASE WHEN close > 0 AND volume > 0 THEN close * volume END AS d FROM grid_{x})
 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"""
frag("adv_b", ADV.format(n=3, x="b")[1:-1])
register(
    "f13_adv",
    lambda s, d: T.average_dollar_volume(RAW(B.region_days(s, d)), 20).select("date", "ticker", "adv"),
    out(ADV.format(n=20, x="r"), "date ticker", "adv", where="adv IS NOT NULL"),
)
frag("fwd", " UNION ALL ".join(
    f"SELECT date, ticker, {h} AS horizon, lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS horizon_return, close FROM grid_s" for h in (1, 2, 3)))
frag("bfwd", " UNION ALL ".join(
    f"SELECT date, {h} AS horizon, lead(close, {h}) OVER (ORDER BY date) / close - 1 AS horizon_benchmark_return FROM bm" for h in (1, 2, 3)))
register(
    "f14_forward_returns", lambda s, d: T.forward_returns(B.closes(B.supplier(s, d)), B.benchmark(s, d)),
    query("""SELECT f.date, f.ticker, CAST(f.horizon AS BIGINT) AS horizon, round(horizon_return, 6) + 0.0 AS horizon_return,
      round(horizon_benchmark_return, 6) + 0.0 AS horizon_benchmark_return FROM fwd f LEFT JOIN bfwd b ON f.date = b.date AND f.horizon = b.horizon
      WHERE f.close IS NOT NULL"""),
)
frag("tick_ret", "SELECT ticker, date, momentum_1m AS ret FROM lag_s WHERE momentum_1m IS NOT NULL")
frag("tick_path_w", "SELECT *, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS wealth FROM tick_ret")
TICK_RET = lambda s, d: T.simple_returns(B.closes(B.supplier(s, d))).select("ticker", "date", "ret")
register(
    "f15_wealth", lambda s, d: T.wealth_path(TICK_RET(s, d), ("ticker",)).select("ticker", "date", "wealth"),
    out("tick_path_w", "ticker date", "wealth"),
)
register(
    "f16_drawdown", lambda s, d: T.wealth_path(TICK_RET(s, d), ("ticker",)).select("ticker", "date", "drawdown"),
    out("(SELECT ticker, date, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY ticker ORDER BY date)) - 1 AS drawdown FROM tick_path_w)",
        "ticker date", "drawdown"),
)

# --- R: ranks --------------------------------------------------------------
register(
    "r1_top_n",
    lambda s, d: R.top_n(T.momentum(B.closes(B.supplier(s, d)), 3), ("date",), "momentum", 5).select("date", "ticker", "momentum", "rank"),
    query("""SELECT date, ticker, round(momentum_3m, 6) + 0.0 AS momentum, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum_3m DESC, ticker) AS rank
      FROM lag_s WHERE momentum_3m IS NOT NULL) WHERE rank <= 5"""),
)
register(
    "r2_top_n_scores",
    lambda s, d: R.top_n(B.supplier_scores(s, d), ("date",), "ml_score", 5).select("date", "ticker", "ml_score", "rank"),
    query("""SELECT date, ticker, round(ml_score, 6) + 0.0 AS ml_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, ticker) AS rank
      FROM sc_s) WHERE rank <= 5"""),
)
register(
    "r3_dense_rank",
    lambda s, d: R.ranked(
        T.on_calendar(B.closes(B.supplier(s, d))).withColumn("m", T.change("close", 6)), ("date",), "m", "rank_6m", descending=True
    ).select("date", "ticker", "rank_6m"),
    query("""SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY momentum_6m DESC NULLS LAST, ticker) AS rank_6m
      FROM lag_s WHERE close IS NOT NULL"""),
)
frag("q_s", """SELECT *, CAST(floor((row_number() OVER (PARTITION BY date ORDER BY ml_score, ticker) - 1) * 5
  / count(*) OVER (PARTITION BY date)) AS INT) + 1 AS quantile_number FROM sc_s WHERE ml_score IS NOT NULL""")
register(
    "r5_quantiles",
    lambda s, d: R.quantiles(B.supplier_scores(s, d)).select("date", "ticker", "quantile", "quantile_number"),
    query("SELECT date, ticker, 'Q' || quantile_number AS quantile, CAST(quantile_number AS BIGINT) AS quantile_number FROM q_s"),
)
register(
    "r6_score_order",
    lambda s, d: R.score_order(B.supplier_scores(s, d)).select("date", "ticker", "ml_score", "rank"),
    query("SELECT date, ticker, round(ml_score, 6) + 0.0 AS ml_score, row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, ticker) AS rank FROM sc_s"),
)
register(
    "r_baseline_score", B.supplier_scores,
    out("sc_s", "date target_date ticker", "ml_score future_return benchmark_return", "target"),
)

# --- L, U: sorts, limits, set operations ------------------------------------
register(
    "l1_sorted_dataset", lambda s, d: B.brand_dataset(s, d).orderBy("date", "ticker"),
    out("ds_b", "date ticker target_date", FEATS + " future_return benchmark_return", "target"),
)
register(
    "l2_bottom_k", lambda s, d: R.bottom_n(B.supplier_scores(s, d), ("date",), "ml_score", 3).select("date", "ticker", "ml_score", "rank"),
    query("""SELECT date, ticker, round(ml_score, 6) + 0.0 AS ml_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ml_score, ticker) AS rank FROM sc_s) WHERE rank <= 3"""),
)
HIST = lambda s, d, n=24: W.selection_history(
    L.momentum_selection(MONTHS(s, d), 3, 0, 5, "momentum_min_vol"), MONTHS(s, d), n
)
frag("sel3", momentum_pos("momentum_min_vol", "b", "momentum_3m"))
frag("hist", """SELECT s.strategy, s.signal_date, s.ticker, g.t, g.close, CASE WHEN g.t > greatest(1, c.t - 23) THEN g.momentum_1m END AS ret
  FROM sel3 s JOIN cal_b c ON c.date = s.signal_date JOIN lag_b g ON g.ticker = s.ticker AND g.t BETWEEN c.t - 23 AND c.t""")
register(
    "l3_last_n_history", lambda s, d: HIST(s, d).select("strategy", "signal_date", "ticker", "t", "close", "ret"),
    out("hist", "strategy signal_date ticker", "close ret", "t"),
)
frag("contrib", "SELECT strategy, ticker, sum(weight * asset_return) AS contribution FROM pos GROUP BY 1, 2")
register(
    "l4_extremes",
    lambda s, d: R.extremes(
        B.suite_positions(s, d).groupBy("strategy", "ticker").agg(F.sum(F.col("weight") * F.col("asset_return")).alias("contribution")),
        ("strategy",), "contribution", 3,
    ).select("strategy", "ticker", "contribution"),
    out("""(SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY contribution DESC, ticker) AS a,
      row_number() OVER (PARTITION BY strategy ORDER BY contribution, ticker) AS b FROM contrib)""", "strategy ticker", "contribution", where="a <= 3 OR b <= 3"),
)
register(
    "u1_union", lambda s, d: B.returns(s, d).select("strategy", "date", "ret"),
    out("all_ret", "strategy date", "ret"),
)
register(
    "u2_intersect",
    lambda s, d: B.suite_positions(s, d).where("strategy = 'ml'").select("signal_date").intersect(
        B.suite_positions(s, d).where("strategy = 'momentum_12_1_equal'").select("signal_date")),
    query("SELECT signal_date FROM pos WHERE strategy = 'ml' INTERSECT SELECT signal_date FROM pos WHERE strategy = 'momentum_12_1_equal'"),
)
register(
    "u3_except",
    lambda s, d: B.suite_positions(s, d).where("strategy = 'momentum_3m_equal'").select("signal_date").subtract(
        B.suite_positions(s, d).where("strategy = 'momentum_12_1_equal'").select("signal_date")),
    query("SELECT signal_date FROM pos WHERE strategy = 'momentum_3m_equal' EXCEPT SELECT signal_date FROM pos WHERE strategy = 'momentum_12_1_equal'"),
)

# --- W: weights ------------------------------------------------------------
register(
    "w1_equal_weights", lambda s, d: L.momentum_positions(MONTHS(s, d)).select("signal_date", "ticker", "weight"),
    out("sel3", "signal_date ticker", "weight"),
)
TILT = lambda s, d: L.momentum_selection(MONTHS(s, d), 3, 0, 8, "momentum_tilt").withColumn(
    "weight", F.exp(-0.6 * (F.col("rank") - 1)))
frag("tilt", "SELECT *, exp(-0.6 * (rk - 1)) AS raw FROM (" + momentum_pos("momentum_tilt", "b", "momentum_3m", 8) + ")")
CAP = "0.3"
frag("tilt_x", "SELECT *, raw / sum(raw) OVER (PARTITION BY signal_date) AS x FROM tilt")
frag("tilt_k", f"SELECT DISTINCT signal_date, x AS p FROM tilt_x UNION SELECT DISTINCT signal_date, x - {CAP} FROM tilt_x")
frag("tilt_f", f"""SELECT k.signal_date, k.p, sum(greatest(0, least({CAP}, t.x - k.p))) AS f FROM tilt_k k JOIN tilt_x t ON t.signal_date = k.signal_date GROUP BY 1, 2""")
frag("tilt_l", """SELECT signal_date, max(p) FILTER (f >= 1) AS lo, min(p) FILTER (f < 1) AS hi, arg_max(f, p) FILTER (f >= 1) AS flo,
  arg_min(f, p) FILTER (f < 1) AS fhi FROM tilt_f GROUP BY 1""")
frag("capped", f"""SELECT t.strategy, t.signal_date, t.date, t.ticker, t.asset_return,
  greatest(0, least({CAP}, t.x - (l.lo + (l.flo - 1) / (l.flo - l.fhi) * (l.hi - l.lo)))) AS weight FROM tilt_x t JOIN tilt_l l ON t.signal_date = l.signal_date""")
CAPPED = lambda s, d: W.cap_weights(TILT(s, d), 0.3, ("strategy", "signal_date")).drop("rank")
register(
    "w2_capped_simplex", lambda s, d: CAPPED(s, d).select("signal_date", "ticker", "weight"),
    out("capped", "signal_date ticker", "weight"),
)
register(
    "w3_weight_violations", lambda s, d: W.weight_violations(TILT(s, d), cap=0.4),
    out("""(SELECT strategy, signal_date, count(*) - count(DISTINCT ticker) AS duplicates, 0 AS non_finite, 0 AS negative, sum(raw) AS total, max(raw) AS largest
      FROM tilt GROUP BY 1, 2)""", "strategy signal_date", "total largest", "duplicates non_finite negative", where="abs(total - 1) > 1e-6 OR largest > 0.4 + 1e-6"),
)
frag("pairs", """SELECT a.strategy, a.signal_date, a.ticker AS i, b.ticker AS j, covar_samp(a.ret, b.ret) * 12 AS covariance,
  CASE WHEN stddev_samp(a.ret) * stddev_samp(b.ret) > 1e-8 THEN covar_samp(a.ret, b.ret) / (stddev_samp(a.ret) * stddev_samp(b.ret)) END AS correlation, count(*) AS observations
  FROM hist a JOIN hist b ON a.signal_date = b.signal_date AND a.t = b.t WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3, 4""")
register(
    "w4_covariance", lambda s, d: W.covariance_pairs(HIST(s, d), 12),
    out("pairs", "strategy signal_date i j", "covariance correlation", "observations"),
)
register(
    "w4_expected_returns", lambda s, d: W.expected_returns(HIST(s, d), 12),
    out("(SELECT strategy, signal_date, ticker, pow(product(1 + ret), 12.0 / count(ret)) - 1 AS expected_return FROM hist WHERE ret IS NOT NULL GROUP BY 1, 2, 3)",
        "strategy signal_date ticker", "expected_return"),
)
SELECTED = lambda s, d, name: L.momentum_selection(MONTHS(s, d), 3, 0, 5, name).drop("rank")
OPTIMIZED = lambda s, d, method, name: W.optimized_weights(
    SELECTED(s, d, name), MONTHS(s, d), method, cap=0.4, lookback=24, frequency=12)
register("w5_min_variance", lambda s, d: OPTIMIZED(s, d, "min_vol", "momentum_min_vol").select("strategy", "signal_date", "ticker", "weight", "optimization_status"))
register("w6_max_sharpe", lambda s, d: OPTIMIZED(s, d, "max_sharpe", "momentum_max_sharpe").select("strategy", "signal_date", "ticker", "weight", "optimization_status"))
register(
    "w7_weight_status", lambda s, d: W.history_status(HIST(s, d), 24),
    query("""SELECT strategy, signal_date, CASE WHEN count(DISTINCT t) < 24 THEN 'fallback_equal:insufficient_history'
      WHEN count(close) < count(*) THEN 'fallback_equal:missing_data' ELSE 'optimized' END AS optimization_status FROM hist GROUP BY 1, 2"""),
)
register(
    "w8_drift",
    lambda s, d: L.trades(B.suite_positions(s, d)).where("pretrade_weight > 0").select("strategy", "signal_date", "ticker", "pretrade_weight"),
    out("pos_tr", "strategy signal_date ticker", "pretrade_weight", where="pretrade_weight > 0"),
)
register(
    "w9_turnover", lambda s, d: B.suite_ledger(s, d).select("strategy", "signal_date", "turnover"),
    out("pos_led", "strategy signal_date", "turnover"),
)
register(
    "w10_cost", lambda s, d: B.suite_ledger(s, d).select("strategy", "signal_date", "transaction_cost"),
    out("pos_led", "strategy signal_date", "transaction_cost"),
)

# --- B: ledgers -------------------------------------------------------------
LED = "gross_return turnover transaction_cost net_return hhi"
frag("pos3", momentum_pos("momentum_3m_equal", "b", "momentum_3m"))
ledger("pos3")
register(
    "b1_momentum_ledger", lambda s, d: L.periods(L.momentum_positions(MONTHS(s, d), 3, 0, 5, "momentum_3m_equal")),
    out("pos3_led", "strategy signal_date date", LED, "seq holdings"),
)
frag("poss", score_pos("ml", "s", 25))
ledger("poss")
register(
    "b2_score_ledger", lambda s, d: L.periods(L.score_positions(B.supplier_scores(s, d), 25), strict=False),
    out("poss_led", "strategy signal_date date", LED, "seq holdings"),
)
register(
    "b3_strategy_suite", B.suite_ledger, out("pos_led", "strategy signal_date date", LED, "seq holdings"),
)


def optimised_suite(s, d):
    both = OPTIMIZED(s, d, "max_sharpe", "momentum_max_sharpe").unionByName(OPTIMIZED(s, d, "min_vol", "momentum_min_vol"))
    return both


register("b3_optimised_ledgers", lambda s, d: L.periods(optimised_suite(s, d).drop("optimization_status")))
register(
    "b4_net_returns", lambda s, d: L.net_returns(B.suite_ledger(s, d)),
    out("(SELECT strategy, date, net_return AS ret FROM pos_led)", "strategy date", "ret"),
)
frag("delayed", """SELECT p.strategy, p.signal_date, c.next_date AS date, p.date AS execution_date, p.ticker, p.weight, g.future_return AS asset_return
  FROM pos p JOIN cal_b c ON c.date = p.date AND c.next_date IS NOT NULL LEFT JOIN lag_b g ON g.date = p.date AND g.ticker = p.ticker""")
ledger("delayed")
DELAYED = B.delayed_ledger
register(
    "b5_delayed_ledger", DELAYED, out("delayed_led", "strategy signal_date date", LED, "seq holdings"),
)
COSTS = (0, 5, 10, 25, 50, 100)
frag("costed", """SELECT l.strategy, l.signal_date, l.date, b.cost_bps, l.gross_return, l.turnover, l.turnover * b.cost_bps / 10000.0 AS transaction_cost,
  l.gross_return - l.turnover * b.cost_bps / 10000.0 AS net_return FROM pos_led0 l CROSS JOIN (SELECT unnest([0, 5, 10, 25, 50, 100]) AS cost_bps) b""")
register(
    "b6_cost_scenarios",
    lambda s, d: L.with_costs(B.suite_ledger(s, d), COSTS).select("strategy", "signal_date", "cost_bps", "transaction_cost", "net_return"),
    out("costed", "strategy signal_date", "transaction_cost net_return", "cost_bps"),
)
LOO_KEYS = ("strategy", "removed_ticker")
LOO = B.leave_one_out_ledger


# The oracle really re-runs every reduced universe, also those that change nothing: names, ranks and percentiles anew.
frag("cand", " UNION ALL ".join([
    momentum_pos("momentum_3m_equal", "b", "momentum_3m", 25), momentum_pos("momentum_12_1_equal", "b", "momentum_12_1", 25)]))


def rescored(key: str, source: str) -> str:
    """Positions of the percentile score in the universes of ``source`` (key, and ``ds_b`` rows that stay)."""
    ranks = " + ".join(f"percent_rank() OVER (PARTITION BY {key}, date ORDER BY {c})" for c in FEATURES)
    return f"""SELECT 'ml' AS strategy, date AS signal_date, target_date AS date, ticker, future_return AS asset_return, {key}, rk AS r2 FROM (
      SELECT *, row_number() OVER (PARTITION BY {key}, date ORDER BY ml_score DESC, ticker) AS rk, count(future_return) OVER (PARTITION BY {key}, date) AS known
      FROM (SELECT *, ({ranks}) / 5 AS ml_score FROM ({source}))) WHERE rk <= 5 AND known > 0"""


frag("loo", f"""SELECT *, 1.0 / count(*) OVER (PARTITION BY strategy, removed_ticker, signal_date) AS weight FROM (
  SELECT c.strategy, c.signal_date, c.date, c.ticker, c.asset_return, r.ticker AS removed_ticker,
  row_number() OVER (PARTITION BY c.strategy, r.ticker, c.signal_date ORDER BY c.rk) AS r2
  FROM cand c JOIN tick_b r ON c.ticker <> r.ticker
  UNION ALL {rescored("removed_ticker", "SELECT r.ticker AS removed_ticker, d.* FROM ds_b d JOIN tick_b r ON d.ticker <> r.ticker")}) WHERE r2 <= 5""")
ledger("loo", "strategy, removed_ticker")
register(
    "b7_leave_one_out",
    lambda s, d: N.every_ledger(LOO(s, d), B.suite_ledger(s, d), B.removals(s, d), "removed_ticker").select(
        *LOO_KEYS, "signal_date", "date", "gross_return", "turnover", "net_return"),
    out("loo_led", "strategy removed_ticker signal_date date", "gross_return turnover net_return"),
)
SIZES = (10, 20, 25, 50)
frag("tops", """SELECT *, 1.0 / count(*) OVER (PARTITION BY top_n, signal_date) AS weight FROM (
  SELECT 'ml' AS strategy, n.top_n, date AS signal_date, target_date AS date, ticker, future_return AS asset_return,
  row_number() OVER (PARTITION BY n.top_n, date ORDER BY ml_score DESC, ticker) AS rk
  FROM sc_s CROSS JOIN (SELECT unnest([10, 20, 25, 50]) AS top_n) n WHERE date IN (SELECT date FROM sc_s WHERE future_return IS NOT NULL)) WHERE rk <= top_n""")
ledger("tops", "top_n")
frag("tops_r", "SELECT top_n, date, net_return AS ret FROM tops_led")
evaluated("tops_m", "tops_r", "top_n", active=False)


def topn_sensitivity(s, d):
    led = L.periods(L.top_n_scenarios(B.supplier_scores(s, d), SIZES), ("top_n",), strict=False)
    perf = M.performance(led.withColumn("ret", F.col("net_return")), ("top_n",))
    return perf.join(led.groupBy("top_n").agg(
        F.avg("turnover").alias("average_turnover"), F.avg(1 / F.col("hhi")).alias("average_effective_holdings"),
        F.avg("holdings").alias("average_holdings"), F.avg("hhi").alias("average_hhi_concentration"),
    ), "top_n").select("top_n", "annual_return", "annual_volatility", "sharpe", "average_turnover",
                       "average_effective_holdings", "average_holdings", "average_hhi_concentration")


register(
    "b9_topn_sensitivity", topn_sensitivity,
    out("""(SELECT m.top_n, annual_return, annual_volatility, sharpe, average_turnover, average_effective_holdings, average_holdings, average_hhi_concentration
      FROM tops_m m JOIN (SELECT top_n, avg(turnover) AS average_turnover, avg(1 / hhi) AS average_effective_holdings, avg(holdings) AS average_holdings,
      avg(hhi) AS average_hhi_concentration FROM tops_led GROUP BY 1) x ON m.top_n = x.top_n)""", "",
        "annual_return annual_volatility sharpe average_turnover average_effective_holdings average_holdings average_hhi_concentration", "top_n"),
)
register(
    "b11_portfolio_risk",
    lambda s, d: W.portfolio_risk(L.momentum_positions(MONTHS(s, d), strategy="momentum_min_vol"), W.covariance_pairs(HIST(s, d), 12)),
    out("""(SELECT p.strategy, p.signal_date, sqrt(sum(a.weight * b.weight * covariance)) AS expected_volatility FROM pairs p
      JOIN sel3 a ON a.signal_date = p.signal_date AND a.ticker = p.i JOIN sel3 b ON b.signal_date = p.signal_date AND b.ticker = p.j GROUP BY 1, 2)""",
        "strategy signal_date", "expected_volatility"),
)
