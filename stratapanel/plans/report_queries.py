"""Bound queries: metrics, attribution, robustness, cross-section (A, B8, C, J6-J7, J14, J16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import attribution as A, crosssection as C, ledger as L, metrics as M
from stratapanel.operators import robustness as X, weights as W
from stratapanel.plans import bindings as B, series_queries as S
from stratapanel.plans.oracle_base import (
    ABS_NAMES, ACT_NAMES, evaluated, frag, ledger, out, path, pearson, query, ratio,
)
from stratapanel.plans.registry import register
from stratapanel.operators.universe import with_sector
from stratapanel.sources import panels as P

NAMES = list(B.STRATEGIES)
ALL = [*NAMES, "benchmark"]
SIMULATIONS, SEED = 5000, 42


def with_bench(s, d):
    return M.benchmark_column(B.common(s, d))


# --- A1-A10: return and risk ------------------------------------------------
register(
    "a1_annual_return", lambda s, d: M.performance(B.common(s, d)).select("strategy", "annual_return"),
    out("cev", "strategy", "annual_return"),
)
register(
    "a2_annual_volatility", lambda s, d: M.performance(B.common(s, d)).select("strategy", "annual_volatility"),
    out("cev", "strategy", "annual_volatility"),
)
register(
    "a3_sharpe", lambda s, d: M.performance(B.common(s, d)).select("strategy", "sharpe"), out("cev", "strategy", "sharpe"),
)
register(
    "a4_sortino", lambda s, d: M.performance(B.common(s, d)).select("strategy", "sortino"), out("cev", "strategy", "sortino"),
)
register(
    "a5_max_drawdown", lambda s, d: M.performance(B.common(s, d)).select("strategy", "max_drawdown"),
    out("cev", "strategy", "max_drawdown"),
)
register(
    "a6_calmar", lambda s, d: M.performance(B.common(s, d)).select("strategy", "calmar"), out("cev", "strategy", "calmar"),
)
register(
    "a7_active_metrics", lambda s, d: M.active_performance(with_bench(s, d).where("strategy <> 'benchmark'")),
    out("cev", "strategy", ACT_NAMES, where="strategy <> 'benchmark'"),
)
evaluated("tick_perf", "tick_ret", "ticker", active=False)
register(
    "a8_performance_summary", lambda s, d: M.performance(S.TICK_RET(s, d), ("ticker",)),
    out("tick_perf", "ticker", ABS_NAMES, "observations"),
)
register(
    "a9_evaluate", lambda s, d: M.evaluate(with_bench(s, d)),
    out("cev", "strategy start_date end_date", f"{ABS_NAMES} {ACT_NAMES}", "observations"),
)
METRICS = [*ABS_NAMES.split(), *ACT_NAMES.split()]
frag("tidy", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, strategy, " + (f"CASE WHEN strategy <> 'benchmark' THEN {m} END" if m in ACT_NAMES else m) + " AS v FROM cev" for m in METRICS))
register(
    "a10_common_period_report", lambda s, d: M.performance_report(B.common(s, d), ALL),
    out("(SELECT metric, " + ", ".join(f"max(v) FILTER (strategy = '{n}') AS {n}" for n in ALL) + " FROM tidy GROUP BY 1)", "metric", " ".join(ALL)),
)
frag("yr", "SELECT strategy, year(date) AS year, product(1 + ret) - 1 AS annual_return, count(*) AS n FROM common GROUP BY 1, 2")
register(
    "a11_yearly_returns", lambda s, d: M.calendar_year_returns(B.common(s, d)), out("yr", "strategy", "annual_return", "year"),
)
frag("cyear", "SELECT strategy, year(date) AS year, date, ret FROM common")
path("cyear", "strategy, year")
register(
    "a12_yearly_performance", lambda s, d: M.yearly_performance(B.common(s, d)),
    query(f"""SELECT strategy, CAST(year AS BIGINT) AS year, round(product(1 + ret) - 1, 6) + 0.0 AS "return", round(stddev_samp(ret) * sqrt(12), 6) + 0.0 AS volatility,
      round({ratio('avg(ret)', 'stddev_samp(ret)')} * sqrt(12), 6) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_drawdown, count(*) AS observations
      FROM cyear_dd GROUP BY strategy, year"""),
)
pick = ", ".join(f"max(annual_return) FILTER (strategy = '{n}') AS {n}" for n in ALL)
frag("ywide", f"""SELECT year, {pick}, max(n) AS observations, max(n) < 12 AS partial_year,
  arg_min(strategy, (-annual_return, strategy)) FILTER (strategy <> 'benchmark') AS best_strategy,
  arg_min(strategy, (annual_return, strategy)) FILTER (strategy <> 'benchmark') AS worst_strategy FROM yr GROUP BY 1""")
register(
    "a13_yearly_leaders", lambda s, d: M.yearly_analysis(B.common(s, d), NAMES),
    out("(SELECT *, " + ", ".join(f"{n} - benchmark AS {n}_excess_vs_benchmark" for n in NAMES) + " FROM ywide)",
        "best_strategy worst_strategy partial_year", " ".join(ALL) + " " + " ".join(f"{n}_excess_vs_benchmark" for n in NAMES), "year observations"),
)
DIAG = "average_turnover maximum_turnover total_transaction_cost average_holdings gross_net_growth_difference optimization_fallback_rate"
register(
    "a14_diagnostics", lambda s, d: L.diagnostics(B.suite_ledger(s, d)),
    out("""(SELECT strategy, avg(turnover) AS average_turnover, max(turnover) AS maximum_turnover, sum(transaction_cost) AS total_transaction_cost,
      avg(holdings) AS average_holdings, product(1 + gross_return) - product(1 + net_return) AS gross_net_growth_difference, 0.0 AS optimization_fallback_rate
      FROM pos_led GROUP BY 1)""", "strategy", DIAG),
)
spans = " UNION ALL ".join(f"SELECT '{n}' AS subperiod, DATE '{a}' AS requested_start, DATE '{b}' AS requested_end" for n, a, b in B.SUBPERIODS)
frag("csub", f"SELECT p.*, c.strategy, c.date, c.ret, c.bench FROM cb c JOIN ({spans}) p ON c.date BETWEEN p.requested_start AND p.requested_end")
evaluated("sub0", "csub", "subperiod, requested_start, requested_end, strategy")
frag("sub", "SELECT subperiod, requested_start, requested_end, strategy, start_date, end_date, observations, " + ", ".join(ABS_NAMES.split()) + ", "
     + ", ".join(f"CASE WHEN strategy <> 'benchmark' THEN {m} END AS {m}" for m in ACT_NAMES.split()) + " FROM sub0")
SUB = lambda s, d: M.subperiod_performance(B.common(s, d), B.SUBPERIODS)
register(
    "a15_subperiods", SUB,
    out("sub", "subperiod requested_start requested_end strategy start_date end_date", f"{ABS_NAMES} {ACT_NAMES}", "observations"),
)
STAB = "positive_active_return_ratio best_subperiod_sharpe worst_subperiod_sharpe mean_subperiod_sharpe std_subperiod_sharpe"
STAB_N = "total_subperiods positive_active_return_subperiods benchmark_beating_return_subperiods benchmark_beating_sharpe_subperiods"
frag("substab", """SELECT s.strategy, count(*) AS total_subperiods, count(*) FILTER (s.annual_active_return > 0) AS positive_active_return_subperiods,
  avg(CASE WHEN s.annual_active_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_active_return_ratio,
  count(*) FILTER (s.annual_return > b.annual_return) AS benchmark_beating_return_subperiods,
  count(*) FILTER (s.sharpe > b.sharpe) AS benchmark_beating_sharpe_subperiods, max(s.sharpe) AS best_subperiod_sharpe,
  min(s.sharpe) AS worst_subperiod_sharpe, avg(s.sharpe) AS mean_subperiod_sharpe, stddev_samp(s.sharpe) AS std_subperiod_sharpe
  FROM sub s LEFT JOIN (SELECT * FROM sub WHERE strategy = 'benchmark') b ON s.subperiod = b.subperiod WHERE s.strategy <> 'benchmark' GROUP BY 1""")
register("a16_subperiod_stability", lambda s, d: M.subperiod_stability(SUB(s, d)), out("substab", "strategy", STAB, STAB_N))


def rolling_sql(name: str, n: int) -> str:
    """Rolling metrics as a self join of each window: a different route."""
    frag(f"{name}_i", "SELECT strategy, date, ret, bench, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i FROM cb")
    frag(f"{name}_p", f"""SELECT a.strategy, a.i AS k, a.date AS k2, b.date, b.ret, b.bench FROM {name}_i a JOIN {name}_i b
      ON a.strategy = b.strategy AND b.i BETWEEN a.i - {n - 1} AND a.i WHERE a.i >= {n}""")
    evaluated(f"{name}_e", f"{name}_p", "strategy, k2")
    return f"{name}_e"


rolling_sql("r12", 12)
ROLL = "annualized_return annualized_volatility sharpe_ratio beta tracking_error information_ratio maximum_drawdown"
frag("roll12", """SELECT c.strategy, c.date, e.annual_return AS annualized_return, e.annual_volatility AS annualized_volatility, e.sharpe AS sharpe_ratio, e.beta,
  e.tracking_error, e.information_ratio, e.max_drawdown AS maximum_drawdown FROM cb c LEFT JOIN r12_e e ON e.strategy = c.strategy AND e.k2 = c.date""")
register(
    "a17_rolling_risk", lambda s, d: M.rolling_risk(B.common(s, d), 12).drop("start_date", "complete", "annual_active_return"),
    out("roll12", "strategy date", ROLL),
)
rolling_sql("r24", 24)
frag("roll24", """SELECT strategy, start_date, k2 AS date, observations, annual_return, annual_volatility, sharpe, max_drawdown,
  CASE WHEN strategy <> 'benchmark' THEN annual_active_return END AS annual_active_return, CASE WHEN strategy <> 'benchmark' THEN tracking_error END AS tracking_error,
  CASE WHEN strategy <> 'benchmark' THEN information_ratio END AS information_ratio FROM r24_e""")
ROLL24 = lambda s, d: M.rolling_robustness(B.common(s, d), 24)
register(
    "a18_rolling_24m", ROLL24,
    out("roll24", "strategy start_date date", "annual_return annual_volatility sharpe max_drawdown annual_active_return tracking_error information_ratio", "observations"),
)
frag("roll24s", """SELECT r.strategy, count(*) AS rolling_windows, avg(CASE WHEN r.sharpe > 0 THEN 1.0 ELSE 0 END) AS positive_sharpe_ratio,
  avg(CASE WHEN r.sharpe > b.sharpe THEN 1.0 ELSE 0 END) AS sharpe_above_benchmark_ratio,
  avg(CASE WHEN r.annual_active_return > 0 THEN 1.0 ELSE 0 END) AS positive_active_return_ratio, min(r.sharpe) AS minimum_rolling_sharpe,
  median(r.sharpe) AS median_rolling_sharpe, max(r.sharpe) AS maximum_rolling_sharpe, min(r.information_ratio) AS minimum_rolling_information_ratio
  FROM roll24 r LEFT JOIN roll24 b ON b.strategy = 'benchmark' AND b.date = r.date WHERE r.strategy <> 'benchmark' GROUP BY 1""")
register(
    "a19_rolling_summary", lambda s, d: M.rolling_summary(ROLL24(s, d)),
    out("roll24s", "strategy", "positive_sharpe_ratio sharpe_above_benchmark_ratio positive_active_return_ratio minimum_rolling_sharpe median_rolling_sharpe maximum_rolling_sharpe minimum_rolling_information_ratio", "rolling_windows"),
)
# Episodes by a different route: each under-water row looks back to its last high and ahead to its next one.
frag("cdd", "SELECT strategy, date, dd, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) - 1 AS last FROM cep_dd")
frag("cep", "SELECT strategy, date, ret FROM common")
path("cep", "strategy")
frag("eps", """SELECT u.strategy, u.date, u.dd, u.last, coalesce((SELECT max(h.i) FROM cdd h WHERE h.strategy = u.strategy AND h.i < u.i AND h.dd >= -1e-12), 0) AS s,
  (SELECT min(h.i) FROM cdd h WHERE h.strategy = u.strategy AND h.i > u.i AND h.dd >= -1e-12) AS e FROM cdd u WHERE u.dd < -1e-12""")
frag("ep2", "SELECT strategy, s, e, min(dd) AS depth, arg_min(date, (dd, date)) AS trough, coalesce(e, max(last)) - s AS duration FROM eps GROUP BY 1, 2, 3")
frag("ep3", "SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY depth, s) AS rk, max(duration) OVER (PARTITION BY strategy) AS longest FROM ep2")
register(
    "a20_drawdown_episodes", lambda s, d: M.drawdown_episodes(B.common(s, d)),
    out("""(SELECT k.strategy, coalesce(x.depth, 0) AS maximum_drawdown, a.date AS drawdown_start, x.trough AS trough_date, b.date AS recovery_date,
      coalesce(x.duration, 0) AS drawdown_duration, coalesce(x.longest, 0) AS longest_drawdown_duration FROM (SELECT DISTINCT strategy FROM common) k
      LEFT JOIN ep3 x ON x.strategy = k.strategy AND x.rk = 1 LEFT JOIN cdd a ON a.strategy = x.strategy AND a.i = x.s LEFT JOIN cdd b ON b.strategy = x.strategy AND b.i = x.e)""",
        "strategy drawdown_start trough_date recovery_date", "maximum_drawdown", "drawdown_duration longest_drawdown_duration"),
)

# --- A21-A31: concentration and attribution --------------------------------
ledger("capped")
CAPPED = lambda s, d: S.CAPPED(s, d)
frag("conc", """SELECT strategy, date, max(weight) / sum(weight) AS maximum_weight, sum(weight * weight) / pow(sum(weight), 2) AS hhi,
  pow(sum(weight), 2) / sum(weight * weight) AS effective_holdings FROM capped GROUP BY 1, 2""")
register(
    "a21_concentration", lambda s, d: A.concentration(CAPPED(s, d)), out("conc", "strategy date", "maximum_weight hhi effective_holdings"),
)
CONC = "average_maximum_weight maximum_single_name_weight average_hhi maximum_hhi average_effective_holdings minimum_effective_holdings"
register(
    "a22_concentration_summary", lambda s, d: A.concentration_summary(A.concentration(CAPPED(s, d))),
    out("""(SELECT strategy, avg(maximum_weight) AS average_maximum_weight, max(maximum_weight) AS maximum_single_name_weight, avg(hhi) AS average_hhi,
      max(hhi) AS maximum_hhi, avg(effective_holdings) AS average_effective_holdings, min(effective_holdings) AS minimum_effective_holdings FROM conc GROUP BY 1)""",
        "strategy", CONC),
)
register(
    "a23_attribution", lambda s, d: A.contribution_by_ticker(B.suite_positions(s, d), B.suite_ledger(s, d)),
    out("""(SELECT strategy, ticker, contribution, 'security' AS attribution_type FROM contrib UNION ALL
      SELECT strategy, 'TRANSACTION_COST', -sum(transaction_cost), 'transaction_cost' FROM pos_led GROUP BY 1)""", "strategy ticker attribution_type", "contribution"),
)
register(
    "a23_attribution_periods", lambda s, d: A.period_attribution(B.suite_positions(s, d)).drop("signal_date"),
    out("(SELECT *, weight * asset_return AS contribution FROM pos)", "strategy date ticker", "weight asset_return contribution"),
)
register(
    "a23_attribution_violations",
    # One security's holdings are taken out, so every period that held it must be reported.
    lambda s, d: A.attribution_violations(B.suite_positions(s, d).where("ticker != 'Brand#11'"), B.suite_ledger(s, d)).drop("explained", "gross_return"),
    query("""SELECT strategy, date FROM (SELECT strategy, date, sum(weight * asset_return) AS e FROM pos WHERE ticker <> 'Brand#11' GROUP BY 1, 2) a
      FULL JOIN pos_led l USING (strategy, date) WHERE e IS NULL OR gross_return IS NULL OR abs(e - gross_return) > 1e-10 + 1e-5 * abs(gross_return)"""),
)
frag("cpos", "SELECT * FROM pos WHERE date IN (SELECT date FROM common)")
frag("crank", """SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY c DESC, ticker) AS rank, count(*) OVER (PARTITION BY strategy) AS n,
  sum(greatest(c, 0)) OVER (PARTITION BY strategy) AS pt, sum(c) OVER (PARTITION BY strategy) AS nt
  FROM (SELECT strategy, ticker, sum(weight * asset_return) AS c FROM cpos GROUP BY 1, 2)""")
register(
    "a24_contribution_ranks", lambda s, d: A.contribution_ranks(B.common_positions(s, d)),
    out("""(SELECT strategy, ticker, rank, c AS total_contribution, CASE WHEN c > 0 AND pt > 0 THEN c / pt ELSE 0 END AS share_of_positive_contribution,
      CASE WHEN abs(nt) > 1e-8 THEN c / nt END AS share_of_net_arithmetic_contribution FROM crank)""",
        "strategy ticker", "total_contribution share_of_positive_contribution share_of_net_arithmetic_contribution", "rank"),
)
top = lambda k: f"coalesce(sum(c) FILTER (c > 0 AND rank <= {k}), 0)"
frag("cconc", f"""SELECT strategy, max(nt) AS net_arithmetic_contribution, max(pt) AS positive_contribution_total, arg_min(ticker, rank) AS largest_contributor,
  max(c) AS largest_contributor_contribution, {top(2)} AS top_2_contribution, {top(3)} AS top_3_contribution, {top(5)} AS top_5_contribution,
  arg_max(ticker, rank) AS bottom_contributor, sum(c) FILTER (n - rank < 3) AS bottom_3_contribution,
  CASE WHEN max(pt) > 0 THEN {top(1)} / max(pt) END AS top_1_share, CASE WHEN max(pt) > 0 THEN {top(2)} / max(pt) END AS top_2_share,
  CASE WHEN max(pt) > 0 THEN {top(3)} / max(pt) END AS top_3_share, CASE WHEN max(pt) > 0 THEN {top(5)} / max(pt) END AS top_5_share,
  CASE WHEN max(pt) > 0 THEN sum(pow(c / pt, 2)) FILTER (c > 0) END AS positive_contribution_hhi FROM crank GROUP BY 1""")
register(
    "a24_contribution_concentration", lambda s, d: A.contribution_concentration(B.common_positions(s, d)),
    out("cconc", "strategy largest_contributor bottom_contributor",
        "net_arithmetic_contribution positive_contribution_total largest_contributor_contribution top_2_contribution top_3_contribution top_5_contribution "
        "bottom_3_contribution top_1_share top_2_share top_3_share top_5_share positive_contribution_hhi"),
)
SETS, removal_ledger = B.contributor_sets, B.removal_ledger
frag("rmset", "SELECT strategy, s.scenario, list(ticker) AS removed, sum(c) AS lost, string_agg(ticker, '|' ORDER BY rank) AS names FROM crank CROSS JOIN (SELECT unnest([1, 2, 3]) AS scenario) s WHERE rank <= s.scenario GROUP BY 1, 2")
frag("rmpos", f"""SELECT *, 1.0 / count(*) OVER (PARTITION BY strategy, scenario, signal_date) AS weight FROM (
  SELECT c.strategy, c.signal_date, c.date, c.ticker, c.asset_return, r.scenario, row_number() OVER (PARTITION BY c.strategy, r.scenario, c.signal_date ORDER BY c.rk) AS r2
  FROM cand c JOIN rmset r ON r.strategy = c.strategy WHERE NOT list_contains(r.removed, c.ticker)
  UNION ALL {S.rescored("scenario", "SELECT r.scenario, d.* FROM ds_b d JOIN rmset r ON r.strategy = 'ml' WHERE NOT list_contains(r.removed, d.ticker)")}) WHERE r2 <= 5""")
ledger("rmpos", "strategy, scenario")
register(
    "b8_contributor_removal", lambda s, d: removal_ledger(s, d).select("strategy", "scenario", "signal_date", "date", "gross_return", "turnover", "net_return"),
    out("rmpos_led", "strategy signal_date date", "gross_return turnover net_return", "scenario"),
)
frag("rmret", "SELECT l.strategy, l.scenario, l.date, l.net_return AS ret, b.bench FROM rmpos_led l JOIN br b ON b.date = l.date WHERE l.date IN (SELECT date FROM common)")
evaluated("rmev", "rmret", "strategy, scenario")


def counterfactuals(s, d):
    dates = B.common_dates(s, d)
    rerun = removal_ledger(s, d).join(F.broadcast(dates), "date", "left_semi").withColumn("ret", F.col("net_return"))
    again = M.evaluate(M.with_benchmark(rerun, B.bench(s, d)), ("strategy", "scenario"))
    return A.contribution_counterfactuals(SETS(s, d), again, M.evaluate(with_bench(s, d)))


register(
    "a25_contribution_counterfactuals", counterfactuals,
    out("""(SELECT strategy, scenario, 'attribution_counterfactual' AS counterfactual_type, names AS removed_tickers, NULL AS annual_return, NULL AS sharpe, NULL AS max_drawdown,
      NULL AS information_ratio, -lost AS delta_vs_baseline FROM rmset UNION ALL
      SELECT e.strategy, e.scenario, 'rerun_counterfactual', r.names, e.annual_return, e.sharpe, e.max_drawdown, e.information_ratio, e.sharpe - b.sharpe
      FROM rmev e JOIN rmset r ON r.strategy = e.strategy AND r.scenario = e.scenario JOIN cev b ON b.strategy = e.strategy)""",
        "strategy counterfactual_type removed_tickers", "annual_return sharpe max_drawdown information_ratio delta_vs_baseline", "scenario"),
)
frag("ordn", """SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ret DESC, date DESC) AS bst, row_number() OVER (PARTITION BY strategy ORDER BY ret, date) AS wst FROM common""")
shares = ", ".join(f"sum(ret) FILTER ({c} <= {k}) / sum(ret) AS {side}_{k}_month_arithmetic_share" for side, c in (("best", "bst"), ("worst", "wst")) for k in (1, 3, 5))
SHARES = " ".join(f"{side}_{k}_month_arithmetic_share" for side in ("best", "worst") for k in (1, 3, 5))
frag("outl", f"""SELECT strategy, arg_min(date, (-ret, date)) AS best_month, max(ret) AS best_monthly_return, arg_min(date, (ret, date)) AS worst_month, min(ret) AS worst_monthly_return,
  median(ret) AS median_monthly_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS positive_month_fraction, avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END) AS negative_month_fraction,
  skewness(ret) AS skewness, kurtosis(ret) AS excess_kurtosis, {shares} FROM ordn GROUP BY 1""")
register(
    "a26_outliers", lambda s, d: M.outlier_diagnostics(B.common(s, d)),
    out("outl", "strategy best_month worst_month", "best_monthly_return worst_monthly_return median_monthly_return positive_month_fraction negative_month_fraction skewness excess_kurtosis " + SHARES),
)
cases = " UNION ALL ".join(
    ["SELECT strategy, 'baseline' AS counterfactual, date, ret, true AS keep FROM ordn"]
    + [f"SELECT strategy, 'remove_{side}_{k}_months', date, ret, {c} > {k} FROM ordn" for side, c in (("best", "bst"), ("worst", "wst")) for k in (1, 3, 5)])
frag("outc", cases)
frag("outk", "SELECT strategy, counterfactual, date, ret FROM outc WHERE keep")
evaluated("oute", "outk", "strategy, counterfactual", active=False)
register(
    "a27_outlier_counterfactuals", lambda s, d: M.outlier_counterfactuals(B.common(s, d)),
    out("""(SELECT e.*, coalesce(r.t, '') AS removed_months FROM oute e LEFT JOIN (SELECT strategy, counterfactual, string_agg(strftime(date, '%Y-%m-%d'), '|' ORDER BY ret, date) AS t
      FROM outc WHERE NOT keep GROUP BY 1, 2) r ON r.strategy = e.strategy AND r.counterfactual = e.counterfactual)""",
        "strategy counterfactual removed_months", "annual_return annual_volatility sharpe max_drawdown", "observations"),
)
frag("cseq", "SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY weight DESC, ticker) AS r FROM capped_seq")
frag("cl1", """SELECT coalesce(a.seq, b.seq + 1) AS seq, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS l1 FROM capped_seq a
  FULL OUTER JOIN capped_seq b ON a.ticker = b.ticker AND a.seq = b.seq + 1 GROUP BY 1""")
frag("wst", """SELECT c.strategy, c.date, c.seq, count(*) FILTER (c.weight > 1e-10) AS number_nonzero_holdings, max(c.weight) AS maximum_weight,
  sum(c.weight) FILTER (r <= 2) AS top_2_weight, sum(c.weight) FILTER (r <= 3) AS top_3_weight, sum(c.weight * c.weight) AS hhi, 1 / sum(c.weight * c.weight) AS effective_holdings,
  -sum(c.weight * ln(c.weight)) FILTER (c.weight > 1e-10) AS entropy, CASE WHEN c.seq = 1 THEN 1.0 ELSE max(l.l1) END AS l1_target_weight_change,
  'equal' AS optimization_status, false AS fallback_indicator FROM cseq c JOIN cl1 l ON l.seq = c.seq GROUP BY 1, 2, 3""")
frag("wstt", "SELECT w.*, l.turnover FROM wst w JOIN capped_led l ON l.date = w.date")
STABLE = "maximum_weight top_2_weight top_3_weight hhi effective_holdings entropy l1_target_weight_change turnover"
STABILITY = lambda s, d: A.weight_stability(CAPPED(s, d), L.periods(CAPPED(s, d)))
register(
    "a28_weight_stability", STABILITY, out("wstt", "strategy date optimization_status fallback_indicator", STABLE, "number_nonzero_holdings"),
)
frag("cgrid", """SELECT k.ticker, q.seq, coalesce(c.weight, 0) AS w, q.top, coalesce(c.weight, 0) > 1e-10 AS held FROM (SELECT DISTINCT ticker FROM capped) k
  CROSS JOIN (SELECT seq, max(weight) AS top FROM capped_seq GROUP BY 1) q LEFT JOIN capped_seq c ON c.ticker = k.ticker AND c.seq = q.seq""")
frag("cgl", "SELECT *, lag(held) OVER (PARTITION BY ticker ORDER BY seq) AS was FROM cgrid")
frag("cgr", "SELECT *, sum(CASE WHEN held IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY seq) AS run FROM cgl")
frag("cgs", "SELECT ticker, max(n) AS longest FROM (SELECT ticker, run, count(*) FILTER (held) AS n FROM cgr GROUP BY 1, 2) GROUP BY 1")
frag("tst", """SELECT 'momentum_tilt' AS strategy, g.ticker, avg(CASE WHEN held THEN 1.0 ELSE 0 END) AS held_period_fraction, coalesce(avg(w) FILTER (held), 0) AS average_weight_when_held,
  avg(w) AS unconditional_average_weight, median(w) AS median_weight, max(w) AS maximum_weight, avg(CASE WHEN w = top AND held THEN 1.0 ELSE 0 END) AS largest_position_fraction,
  max(s.longest) AS longest_consecutive_holding_streak, count(*) FILTER (held AND NOT coalesce(was, false)) AS entries, count(*) FILTER (NOT held AND was) AS exits
  FROM cgl g JOIN cgs s ON s.ticker = g.ticker GROUP BY 1, 2""")
register(
    "a29_ticker_stability", lambda s, d: A.ticker_stability(CAPPED(s, d)),
    out("tst", "strategy ticker", "held_period_fraction average_weight_when_held unconditional_average_weight median_weight maximum_weight largest_position_fraction",
        "longest_consecutive_holding_streak entries exits"),
)
register(
    "a30_stability_summary", lambda s, d: A.stability_summary(STABILITY(s, d)),
    out("""(SELECT strategy, count(*) AS rebalance_periods, avg(number_nonzero_holdings) AS average_nonzero_holdings, avg(maximum_weight) AS average_max_weight,
      max(maximum_weight) AS maximum_max_weight, avg(top_3_weight) AS average_top3_weight, avg(hhi) AS average_hhi, avg(effective_holdings) AS average_effective_holdings,
      min(effective_holdings) AS minimum_effective_holdings, avg(turnover) AS average_turnover, median(turnover) AS median_turnover, max(turnover) AS maximum_turnover,
      avg(l1_target_weight_change) AS average_l1_weight_change, 0.0 AS fallback_rate FROM wstt GROUP BY 1)""", "strategy",
        "average_nonzero_holdings average_max_weight maximum_max_weight average_top3_weight average_hhi average_effective_holdings minimum_effective_holdings "
        "average_turnover median_turnover maximum_turnover average_l1_weight_change fallback_rate", "rebalance_periods"),
)
register(
    "a31_correlation_diagnostics", lambda s, d: A.correlation_diagnostics(W.covariance_pairs(S.HIST(s, d), 12)),
    out("""(SELECT strategy, signal_date, avg(correlation) AS average_pairwise_correlation, max(correlation) AS maximum_pairwise_correlation,
      min(correlation) AS minimum_pairwise_correlation, max(observations) AS observations FROM pairs WHERE i < j GROUP BY 1, 2)""",
        "strategy signal_date", "average_pairwise_correlation maximum_pairwise_correlation minimum_pairwise_correlation", "observations"),
)
SPECTRUM = lambda s, d: A.estimator_diagnostics(S.HIST(s, d), 12)
register("a31_estimator_spectrum", SPECTRUM)
register("a31_estimator_summary", lambda s, d: A.estimator_summary(SPECTRUM(s, d)))

# --- A32-A38: robustness ----------------------------------------------------
COSTED = lambda s, d: L.with_costs(B.common_ledger(s, d), S.COSTS)
frag("costr", "SELECT c.*, c.net_return AS ret, b.bench FROM costed c JOIN br b ON b.date = c.date WHERE c.date IN (SELECT date FROM common)")
evaluated("coste", "costr", "strategy, cost_bps", ", avg(turnover) AS average_turnover, sum(transaction_cost) AS total_transaction_cost")
frag("costd", "SELECT e.*, b.sharpe AS benchmark_sharpe FROM coste e CROSS JOIN (SELECT sharpe FROM cev WHERE strategy = 'benchmark') b")
register(
    "a32_cost_sensitivity", lambda s, d: X.cost_sensitivity(COSTED(s, d), B.bench(s, d)),
    out("costd", "strategy start_date end_date", f"{ABS_NAMES} {ACT_NAMES} average_turnover total_transaction_cost benchmark_sharpe", "cost_bps observations"),
)
register(
    "a32_cost_breakpoints", lambda s, d: X.cost_breakpoints(X.cost_sensitivity(COSTED(s, d), B.bench(s, d))),
    query("""SELECT strategy, coalesce(CAST(min(cost_bps) FILTER (annual_active_return <= 0) AS VARCHAR), 'not_reached') AS first_cost_bps_active_return_nonpositive,
      coalesce(CAST(min(cost_bps) FILTER (sharpe <= benchmark_sharpe) AS VARCHAR), 'not_reached') AS first_cost_bps_sharpe_at_or_below_benchmark FROM costd GROUP BY 1"""),
)


def pair(s, d):
    late = L.net_returns(S.DELAYED(s, d))
    same = L.net_returns(B.common_ledger(s, d))
    return X.aligned_pair(same, late, B.bench(s, d))


frag("pair2", """SELECT a.strategy, a.date, a.net_return AS first, l.net_return AS second, b.bench FROM pos_led a JOIN delayed_led l ON l.strategy = a.strategy AND l.date = a.date
  JOIN br b ON b.date = a.date WHERE a.date IN (SELECT date FROM common)""")
register("j7_aligned_pair", pair, out("pair2", "strategy date", "first second bench"))
frag("pairl", "SELECT strategy, 'same_close' AS execution_scenario, date, first AS ret, bench FROM pair2 UNION ALL SELECT strategy, 'one_period_delay', date, second, bench FROM pair2")
evaluated("paire", "pairl", "strategy, execution_scenario")
frag("exec2", """SELECT e.*, e.annual_return - b.annual_return AS annual_return_delta, e.sharpe - b.sharpe AS sharpe_delta, e.information_ratio - b.information_ratio AS information_ratio_delta
  FROM paire e JOIN paire b ON b.strategy = e.strategy AND b.execution_scenario = 'same_close'""")
EXECUTION = lambda s, d: X.execution_sensitivity(pair(s, d))
register(
    "a33_execution_sensitivity", EXECUTION,
    out("exec2", "strategy execution_scenario start_date end_date", f"{ABS_NAMES} {ACT_NAMES} annual_return_delta sharpe_delta information_ratio_delta", "observations"),
)
frag("loor", """SELECT l.strategy, l.removed_ticker, l.date, l.net_return AS ret, p.net_return AS base, b.bench FROM loo_led l JOIN pos_led p ON p.strategy = l.strategy AND p.date = l.date
  JOIN br b ON b.date = l.date WHERE l.date IN (SELECT date FROM common)""")
frag("loob", "SELECT strategy, removed_ticker, date, base AS ret, bench FROM loor")
evaluated("looe", "loor", "strategy, removed_ticker")
evaluated("loobe", "loob", "strategy, removed_ticker")
D4 = ("annual_return", "sharpe", "max_drawdown", "information_ratio")
frag("lood", "SELECT e.*, " + ", ".join(f"b.{m} AS baseline_{m}, e.{m} - b.{m} AS {m}_delta" for m in D4)
     + " FROM looe e JOIN loobe b ON b.strategy = e.strategy AND b.removed_ticker = e.removed_ticker")


@B.shared
def loo_details(s, d):
    dates = F.broadcast(B.common_dates(s, d))
    again = S.LOO(s, d).join(dates, "date", "left_semi").select(*S.LOO_KEYS, "date", F.col("net_return").alias("ret"))
    base = L.net_returns(B.common_ledger(s, d))
    return X.leave_one_out_details(again, base, B.bench(s, d), B.brand(s, d).select("ticker"))


register(
    "a34_leave_one_out", loo_details,
    out("lood", "strategy removed_ticker start_date end_date",
        f"{ABS_NAMES} {ACT_NAMES} " + " ".join(f"baseline_{m} {m}_delta" for m in D4), "observations"),
)
frag("loos", """SELECT strategy, min(baseline_sharpe) AS baseline_sharpe, avg(sharpe) AS mean_leave_one_out_sharpe, stddev_samp(sharpe) AS std_leave_one_out_sharpe,
  min(sharpe) AS minimum_leave_one_out_sharpe, max(sharpe) AS maximum_leave_one_out_sharpe, arg_min(removed_ticker, (round(sharpe, 9), removed_ticker)) AS worst_removed_ticker_by_sharpe,
  arg_min(removed_ticker, (round(-sharpe, 9), removed_ticker)) AS best_removed_ticker_by_sharpe,
  arg_min(removed_ticker, (annual_return_delta, removed_ticker)) AS largest_annual_return_drop_ticker,
  arg_min(removed_ticker, (information_ratio_delta, removed_ticker)) AS largest_information_ratio_drop_ticker FROM lood GROUP BY 1""")
register(
    "a34_leave_one_out_summary", lambda s, d: X.leave_one_out_summary(loo_details(s, d)),
    out("loos", "strategy worst_removed_ticker_by_sharpe best_removed_ticker_by_sharpe largest_annual_return_drop_ticker largest_information_ratio_drop_ticker",
        "baseline_sharpe mean_leave_one_out_sharpe std_leave_one_out_sharpe minimum_leave_one_out_sharpe maximum_leave_one_out_sharpe"),
)
BLOCKS = (3, 6, 12)
frag("hist_b", """SELECT c.strategy, row_number() OVER (PARTITION BY c.strategy ORDER BY c.date) - 1 AS i, count(*) OVER (PARTITION BY c.strategy) AS n, c.ret AS s, b.ret AS b
  FROM common c JOIN common b ON b.strategy = 'benchmark' AND b.date = c.date WHERE c.strategy <> 'benchmark'""")
frag("bkeys", f"""SELECT strategy, n, {SEED} + row_number() OVER (ORDER BY strategy) - 1 AS seed FROM (SELECT DISTINCT strategy, n FROM hist_b)""")
frag("bidx", f"""SELECT k.strategy, k.n, z.block_size, m.sim, p.pos,
  (('0x' || substr(md5(k.seed || ':' || m.sim || ':' || (p.pos // z.block_size)), 1, 8))::BIGINT % k.n + p.pos % z.block_size) % k.n AS idx
  FROM bkeys k CROSS JOIN (SELECT unnest([3, 6, 12]) AS block_size) z CROSS JOIN (SELECT unnest(range({SIMULATIONS})) AS sim) m
  CROSS JOIN (SELECT unnest(range(1000)) AS pos) p WHERE p.pos < k.n""")


def indices(s, d):
    from pyspark.sql import Window

    own = B.common(s, d).where("strategy <> 'benchmark'").groupBy("strategy").agg(F.count("ret").alias("n"))
    seeded = own.withColumn("seed", F.lit(SEED) + F.row_number().over(Window.orderBy("strategy")) - 1)
    sims = seeded.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(SIMULATIONS - 1))))
    drawn = X.moving_block_indices(sims, F.col("n"), F.lit(6), F.col("seed"))
    return drawn.select("strategy", "sim", F.posexplode("indices").alias("pos", "idx"))


register("a35_block_indices", indices, out("bidx", "strategy", "", "sim pos idx", where="block_size = 6"))
frag("bpath", "SELECT x.strategy, x.block_size, x.sim, x.pos AS date, h.s AS ret, h.b AS bench FROM bidx x JOIN hist_b h ON h.strategy = x.strategy AND h.i = x.idx")
evaluated("bev", "bpath", "strategy, block_size, sim", f""", pow(product(1 + bench), 12.0 / count(*)) - 1 AS benchmark_annual_return,
  {ratio('avg(bench)', 'stddev_samp(bench)')} * sqrt(12) AS benchmark_sharpe""")


@B.shared
def bootstrap(s, d):
    """Every simulation of every block size, run once for all reports."""
    return X.bootstrap_paths(B.common(s, d), SIMULATIONS, BLOCKS, SEED)


@B.shared
def observed(s, d):
    return M.evaluate(with_bench(s, d))


PATHS = lambda s, d: bootstrap(s, d).where("block_size = 6")
BOOT = "annual_return annual_volatility sharpe annual_active_return tracking_error information_ratio max_drawdown benchmark_annual_return benchmark_sharpe"
register("a36_block_bootstrap", PATHS, out("bev", "strategy", BOOT, "block_size sim", where="block_size = 6"))
share = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END)"
frag("bsum", f"""SELECT strategy, block_size, count(*) AS simulations, (SELECT sharpe FROM cev WHERE cev.strategy = bev.strategy) AS observed_sharpe, median(sharpe) AS median_sharpe, quantile_cont(sharpe, 0.05) AS sharpe_p5, quantile_cont(sharpe, 0.95) AS sharpe_p95,
  {share('annual_return > benchmark_annual_return')} AS p_annual_return_above_benchmark, {share('annual_active_return > 0')} AS p_active_return_positive,
  {share('sharpe > benchmark_sharpe')} AS p_sharpe_above_benchmark, {share('information_ratio > 0')} AS p_information_ratio_positive, {share('sharpe > 1')} AS p_sharpe_above_1
  FROM bev GROUP BY 1, 2""")
BSUM = "observed_sharpe median_sharpe sharpe_p5 sharpe_p95 p_annual_return_above_benchmark p_active_return_positive p_sharpe_above_benchmark p_information_ratio_positive p_sharpe_above_1"
register("a37_bootstrap_summary", lambda s, d: X.bootstrap_summary(PATHS(s, d), observed(s, d)), out("bsum", "strategy", BSUM, "block_size simulations", where="block_size = 6"))
frag("blong", " UNION ALL ".join(f"SELECT strategy, block_size, '{m}' AS metric, {m} AS x FROM bev WHERE block_size = 6" for m in X.BOOTSTRAP_METRICS))
frag("bobs", " UNION ALL ".join(f"SELECT strategy, '{m}' AS metric, {m} AS observed FROM cev" for m in X.BOOTSTRAP_METRICS))
quants = ", ".join(f"quantile_cont(x, {p}) AS {n}" for p, n in X.PERCENTILES)
register(
    "a37_bootstrap_intervals", lambda s, d: X.bootstrap_intervals(PATHS(s, d), observed(s, d)),
    out(f"""(SELECT l.strategy, l.block_size, l.metric, max(o.observed) AS observed, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std, {quants}
      FROM blong l JOIN bobs o ON o.strategy = l.strategy AND o.metric = l.metric GROUP BY 1, 2, 3)""",
        "strategy metric", "observed mean median std " + " ".join(n for _, n in X.PERCENTILES), "block_size"),
)
register("a38_block_sensitivity", lambda s, d: X.bootstrap_summary(bootstrap(s, d), observed(s, d)), out("bsum", "strategy", BSUM, "block_size simulations"))

# --- J: alignment and scorecard --------------------------------------------
register("j6_common_period", lambda s, d: B.common(s, d), out("common", "strategy date", "ret"))
register(
    "j14_scenario_keys",
    lambda s, d: L.with_costs(B.suite_ledger(s, d), S.COSTS).groupBy("strategy", "cost_bps").agg(F.sum("transaction_cost").alias("total_cost")),
    out("(SELECT strategy, cost_bps, sum(transaction_cost) AS total_cost FROM costed GROUP BY 1, 2)", "strategy", "total_cost", "cost_bps"),
)


def scorecard(s, d):
    c = B.common(s, d)
    base = observed(s, d).where("strategy <> 'benchmark'")
    positions = B.suite_positions(s, d)
    return X.scorecard(
        base, X.leave_one_out_summary(loo_details(s, d)), M.subperiod_stability(SUB(s, d)),
        X.cost_sensitivity(COSTED(s, d), B.bench(s, d)), EXECUTION(s, d), X.bootstrap_summary(PATHS(s, d)),
        A.contribution_concentration(B.common_positions(s, d)), M.outlier_diagnostics(c), M.rolling_summary(ROLL24(s, d)),
        A.stability_summary(A.weight_stability(positions, B.suite_ledger(s, d))),
    )


CARD = ("baseline_sharpe baseline_information_ratio worst_leave_one_out_sharpe leave_one_out_sharpe_std positive_active_subperiod_ratio sharpe_100bps delayed_execution_sharpe "
        "delayed_execution_sharpe_delta bootstrap_p_active_return_positive bootstrap_p_sharpe_above_benchmark bootstrap_sharpe_p5 bootstrap_sharpe_median top1_contribution_share "
        "top3_contribution_share best3_month_arithmetic_share rolling_24m_positive_active_ratio rolling_24m_sharpe_above_benchmark_ratio average_effective_holdings average_max_weight")
frag("card", """SELECT e.strategy, e.sharpe AS baseline_sharpe, e.information_ratio AS baseline_information_ratio, l.minimum_leave_one_out_sharpe AS worst_leave_one_out_sharpe,
  l.std_leave_one_out_sharpe AS leave_one_out_sharpe_std, ss.positive_active_return_ratio AS positive_active_subperiod_ratio, c.sharpe AS sharpe_100bps, x.sharpe AS delayed_execution_sharpe,
  x.sharpe_delta AS delayed_execution_sharpe_delta, b.p_active_return_positive AS bootstrap_p_active_return_positive, b.p_sharpe_above_benchmark AS bootstrap_p_sharpe_above_benchmark,
  b.sharpe_p5 AS bootstrap_sharpe_p5, b.median_sharpe AS bootstrap_sharpe_median, k.top_1_share AS top1_contribution_share, k.top_3_share AS top3_contribution_share,
  o.best_3_month_arithmetic_share AS best3_month_arithmetic_share, r.positive_active_return_ratio AS rolling_24m_positive_active_ratio,
  r.sharpe_above_benchmark_ratio AS rolling_24m_sharpe_above_benchmark_ratio, h.eff AS average_effective_holdings, h.mw AS average_max_weight
  FROM cev e LEFT JOIN loos l ON l.strategy = e.strategy LEFT JOIN substab ss ON ss.strategy = e.strategy LEFT JOIN costd c ON c.strategy = e.strategy AND c.cost_bps = 100
  LEFT JOIN exec2 x ON x.strategy = e.strategy AND x.execution_scenario = 'one_period_delay' LEFT JOIN bsum b ON b.strategy = e.strategy AND b.block_size = 6
  LEFT JOIN cconc k ON k.strategy = e.strategy LEFT JOIN outl o ON o.strategy = e.strategy LEFT JOIN roll24s r ON r.strategy = e.strategy
  LEFT JOIN (SELECT strategy, avg(1 / hhi) AS eff, avg(mw) AS mw FROM (SELECT strategy, signal_date, sum(weight * weight) AS hhi, max(weight) AS mw FROM pos GROUP BY 1, 2) GROUP BY 1) h
  ON h.strategy = e.strategy WHERE e.strategy <> 'benchmark'""")
register("j16_scorecard", scorecard, out("card", "strategy", CARD))

# --- C: cross-section -------------------------------------------------------
frag("sv", "SELECT * FROM sc_s WHERE ml_score IS NOT NULL AND future_return IS NOT NULL")
frag("ark", """SELECT *, rank() OVER (PARTITION BY date ORDER BY ml_score) + (count(*) OVER (PARTITION BY date, ml_score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY date ORDER BY future_return) + (count(*) OVER (PARTITION BY date, future_return) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, ticker) AS rk FROM sv""")
frag("ic", f"SELECT d.date, a.rank_ic, a.pearson_ic, a.realized FROM (SELECT DISTINCT date FROM sc_s) d LEFT JOIN (SELECT date, {pearson('rx', 'ry')} AS rank_ic, {pearson('ml_score', 'future_return')} AS pearson_ic, count(*) AS realized FROM ark GROUP BY 1) a ON a.date = d.date")
SC = B.supplier_scores
register("c1_rank_ic", lambda s, d: C.rank_ic(SC(s, d)), out("ic", "date", "rank_ic pearson_ic", "realized"))
frag("rkall", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, ticker) AS rk FROM sc_s")
frag("bydate", """SELECT date, avg(target) FILTER (rk <= 5) AS top_n_hit_rate, avg(future_return) FILTER (rk <= 5) - avg(future_return) AS top_n_spread
  FROM rkall GROUP BY 1 HAVING count(future_return) > 0""")
register(
    "c2_ranking_summary", lambda s, d: C.ranking_summary(SC(s, d), 5, strict=False),
    out(f"""(SELECT avg(rank_ic) AS mean_rank_ic, {ratio('avg(rank_ic)', 'stddev_samp(rank_ic)')} AS rank_ic_information_ratio, avg(top_n_hit_rate) AS top_n_hit_rate,
      avg(top_n_spread) AS top_n_return_spread, count(top_n_spread) AS evaluated_periods, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) FILTER (rank_ic IS NOT NULL) AS positive_rank_ic_fraction
      FROM ic LEFT JOIN bydate USING (date))""", "", "mean_rank_ic rank_ic_information_ratio top_n_hit_rate top_n_return_spread positive_rank_ic_fraction", "evaluated_periods"),
)
BSC = B.brand_scores
frag("arkb", """SELECT *, rank() OVER (PARTITION BY date ORDER BY ml_score) + (count(*) OVER (PARTITION BY date, ml_score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY date ORDER BY future_return) + (count(*) OVER (PARTITION BY date, future_return) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, ticker) AS rk FROM sc_b WHERE future_return IS NOT NULL""")
frag("tsb", f"""SELECT d.date, a.rank_ic, a.top_n_hit_rate FROM (SELECT DISTINCT date FROM sc_b) d LEFT JOIN (SELECT date, {pearson('rx', 'ry')} AS rank_ic,
  avg(target) FILTER (rk <= 5) AS top_n_hit_rate FROM arkb GROUP BY 1) a ON a.date = d.date""")
register(
    # The last month is cut short: names without an outcome in it are left out of its evaluation.
    "c3_ranking_timeseries", lambda s, d: C.ranking_timeseries(BSC(s, d).where("future_return IS NOT NULL OR target_date IS NULL")),
    out("""(SELECT date, rank_ic, top_n_hit_rate, CASE WHEN count(rank_ic) OVER w = 12 THEN avg(rank_ic) OVER w END AS rolling_mean_rank_ic FROM tsb
      WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""", "date", "rank_ic rolling_mean_rank_ic top_n_hit_rate"),
)
register(
    "c4_diagnostics", lambda s, d: C.diagnostics(SC(s, d), 25),
    out("""(SELECT i.date, rank_ic AS spearman_rank_ic, pearson_ic, rank_ic > 0 AS positive_rank_ic, g.score_dispersion, g.n AS eligible_securities, least(25, g.n) AS selected_securities
      FROM ic i JOIN (SELECT date, stddev_samp(ml_score) AS score_dispersion, count(ml_score) AS n FROM sc_s GROUP BY 1) g ON g.date = i.date)""",
        "date positive_rank_ic", "spearman_rank_ic pearson_ic score_dispersion", "eligible_securities selected_securities"),
)
frag("qret", "SELECT date, " + ", ".join(f"avg(future_return) FILTER (quantile_number = {i}) AS Q{i}" for i in range(1, 6))
     + " FROM q_s WHERE future_return IS NOT NULL GROUP BY 1")
frag("qret5", "SELECT *, Q5 - Q1 AS Q5_minus_Q1 FROM qret")
QRET = lambda s, d: C.quantile_returns(SC(s, d))
register("c5_quantile_returns", QRET, out("qret5", "date", "Q1 Q2 Q3 Q4 Q5 Q5_minus_Q1"))
frag("qlong", " UNION ALL ".join(f"SELECT '{q}' AS portfolio, date, {q} AS ret FROM qret5" for q in (*C.QUANTILES, "Q5_minus_Q1")))
evaluated("qperf", "qlong", "portfolio", active=False)
register("c6_quantile_summary", lambda s, d: C.quantile_summary(QRET(s, d)), out("qperf", "portfolio", ABS_NAMES, "observations"))
AVGQ = ", ".join(f"avg({q}) AS average_{q}" for q in C.QUANTILES)
register(
    "c7_monotonicity", lambda s, d: C.quantile_monotonicity(QRET(s, d)),
    out(f"""(SELECT {share('Q5 > Q1')} AS Q5_gt_Q1_fraction, avg(Q5 - Q1) AS average_Q5_minus_Q1, median(Q5 - Q1) AS median_Q5_minus_Q1,
      {share('Q1 <= Q2 AND Q2 <= Q3 AND Q3 <= Q4 AND Q4 <= Q5')} AS monotonic_period_fraction, {AVGQ} FROM qret5)""", "",
        "Q5_gt_Q1_fraction average_Q5_minus_Q1 median_Q5_minus_Q1 monotonic_period_fraction " + " ".join(f"average_{q}" for q in C.QUANTILES)),
)
register(
    "c8_long_short", lambda s, d: C.long_short(QRET(s, d)),
    out(f"""(SELECT 'research_long_short_spread' AS series, p.annual_return AS annualized_return, p.annual_volatility AS annualized_volatility, p.sharpe, x.* FROM qperf p
      CROSS JOIN (SELECT avg(Q5_minus_Q1) AS mean_monthly_spread, {share('Q5_minus_Q1 > 0')} AS positive_month_fraction,
      avg(Q5_minus_Q1) / (stddev_samp(Q5_minus_Q1) / sqrt(count(Q5_minus_Q1))) AS naive_iid_t_stat FROM qret5) x WHERE p.portfolio = 'Q5_minus_Q1')""",
        "series", "mean_monthly_spread annualized_return annualized_volatility sharpe positive_month_fraction naive_iid_t_stat"),
)
frag("qsec", """SELECT q.*, coalesce(s.sector, 'Unknown') AS sector, row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, q.ticker) AS rk FROM q_s q LEFT JOIN sec_s s ON s.ticker = q.ticker""")
frag("sexp0", """SELECT date, sector, count(*) AS u, count(*) FILTER (rk <= 25) AS t, count(*) FILTER (quantile_number = 5) AS q FROM qsec GROUP BY 1, 2""")
frag("sexp", """SELECT date, sector, u / sum(u) OVER w AS universe_weight, t / sum(t) OVER w AS topn_weight, q / sum(q) OVER w AS q5_weight,
  t / sum(t) OVER w - u / sum(u) OVER w AS active_sector_weight FROM sexp0 WINDOW w AS (PARTITION BY date)""")
SECTORED = lambda s, d: with_sector(SC(s, d), P.supplier_sectors(s, d))
EXPOSURE = lambda s, d: C.sector_exposure(SECTORED(s, d), 25)
register("c9_sector_exposure", EXPOSURE, out("sexp", "date sector", "universe_weight topn_weight q5_weight active_sector_weight"))
frag("hl1", "SELECT date, sum(abs(active_sector_weight)) / 2 AS h FROM sexp GROUP BY 1")
frag("sprd", "SELECT date, avg(future_return) FILTER (rk <= 25) - avg(future_return) AS sp FROM ark GROUP BY 1")
frag("msec", "SELECT sector, avg(active_sector_weight) AS m FROM sexp GROUP BY 1")
register(
    "c10_sector_attribution", lambda s, d: C.sector_attribution(EXPOSURE(s, d), SC(s, d), 25),
    out(f"""(SELECT (SELECT avg(abs(active_sector_weight)) FROM sexp) AS average_absolute_sector_active_exposure, avg(h) AS average_sector_concentration_half_l1,
      {pearson('h', 'sp')} AS concentration_topn_spread_correlation, (SELECT arg_max(sector, (m, sector)) FROM msec) AS most_persistently_overweight_sector,
      (SELECT arg_min(sector, (m, sector)) FROM msec) AS most_persistently_underweight_sector FROM hl1 LEFT JOIN sprd USING (date))""",
        "most_persistently_overweight_sector most_persistently_underweight_sector",
        "average_absolute_sector_active_exposure average_sector_concentration_half_l1 concentration_topn_spread_correlation"),
)


def latest(df):
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi")


register(
    "c11_current_sector_exposure", lambda s, d: C.current_sector_exposure(latest(SC(s, d)), P.supplier_sectors(s, d), 25),
    out("""(SELECT sector, universe_weight AS eligible_equal_weight, q5_weight AS q5_equal_weight, topn_weight AS topn_equal_weight,
      active_sector_weight AS topn_active_equal_weight FROM sexp WHERE date = (SELECT max(date) FROM sexp))""", "sector",
        "eligible_equal_weight q5_equal_weight topn_equal_weight topn_active_equal_weight"),
)
frag("mm", f"""SELECT date, {pearson('rx', 'ry')} AS rank_ic, avg(CASE WHEN future_return > benchmark_return THEN 1.0 ELSE 0 END) FILTER (rk <= 5) AS top_n_hit_rate,
  avg(future_return) FILTER (rk <= 5) - avg(future_return) AS top_n_spread FROM ark GROUP BY 1""")
MONTHLY = lambda s, d: C.monthly_metrics(SC(s, d))
register("c12_monthly_metrics", MONTHLY, out("mm", "date", "rank_ic top_n_hit_rate top_n_spread"))
register(
    "c13_yearly_stability", lambda s, d: C.stability_by_year(MONTHLY(s, d)),
    out(f"""(SELECT year(date) AS year, count(rank_ic) AS observations, avg(rank_ic) AS mean_rank_ic, median(rank_ic) AS median_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
      {share('rank_ic > 0')} AS positive_rank_ic_fraction, avg(top_n_hit_rate) AS top_n_hit_rate, avg(top_n_spread) AS average_top_n_return_spread FROM mm GROUP BY 1)""", "",
        "mean_rank_ic median_rank_ic rank_ic_std positive_rank_ic_fraction top_n_hit_rate average_top_n_return_spread", "year observations"),
)
roll = lambda c, n: f"CASE WHEN count({c}) OVER w = 12 THEN avg({c}) OVER w END AS rolling_12m_{n}"
register(
    "c13_rolling_stability", lambda s, d: C.stability_rolling(MONTHLY(s, d)),
    out(f"""(SELECT date, rank_ic, top_n_hit_rate, top_n_spread, {roll('rank_ic', 'mean_rank_ic')}, {roll('pos_ic', 'positive_ic_fraction')}, {roll('top_n_hit_rate', 'top_n_hit_rate')},
      {roll('top_n_spread', 'top_n_spread')} FROM (SELECT *, CASE WHEN rank_ic > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END AS pos_ic FROM mm)
      WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""", "date",
        "rank_ic top_n_hit_rate top_n_spread rolling_12m_mean_rank_ic rolling_12m_positive_ic_fraction rolling_12m_top_n_hit_rate rolling_12m_top_n_spread"),
)
frag("dec0", """SELECT s.date, s.ticker, s.ml_score, f.horizon, f.horizon_return AS r, b.horizon_benchmark_return AS b FROM sc_s s JOIN fwd f ON f.date = s.date AND f.ticker = s.ticker
  JOIN bfwd b ON b.date = f.date AND b.horizon = f.horizon WHERE f.horizon_return IS NOT NULL""")
frag("dec1", """SELECT *, rank() OVER (PARTITION BY horizon, date ORDER BY ml_score) + (count(*) OVER (PARTITION BY horizon, date, ml_score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY horizon, date ORDER BY r) + (count(*) OVER (PARTITION BY horizon, date, r) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY horizon, date ORDER BY ml_score DESC, ticker) AS rk FROM dec0""")
frag("dec2", f"""SELECT horizon, date, {pearson('rx', 'ry')} AS rank_ic, avg(CASE WHEN r > b THEN 1.0 ELSE 0 END) FILTER (rk <= 5) AS hit, avg(r) FILTER (rk <= 5) - avg(r) AS sp FROM dec1 GROUP BY 1, 2""")
register(
    "c14_signal_decay", lambda s, d: C.signal_decay(SC(s, d), B.closes(B.supplier(s, d)), B.benchmark(s, d)),
    out(f"""(SELECT horizon AS horizon_months, count(rank_ic) AS observations, avg(rank_ic) AS mean_rank_ic, median(rank_ic) AS median_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
      {share('rank_ic > 0')} AS positive_rank_ic_fraction, {ratio('avg(rank_ic)', 'stddev_samp(rank_ic)')} AS rank_ic_ir, avg(sp) AS average_top_n_spread, avg(hit) AS top_n_hit_rate
      FROM dec2 GROUP BY 1)""", "", "mean_rank_ic median_rank_ic rank_ic_std positive_rank_ic_fraction rank_ic_ir average_top_n_spread top_n_hit_rate", "horizon_months observations"),
)
frag("disp", """SELECT g.*, m.rank_ic, m.top_n_hit_rate, m.top_n_spread FROM (SELECT date, avg(ml_score) AS score_mean, stddev_samp(ml_score) AS score_std, min(ml_score) AS score_min,
  max(ml_score) AS score_max, max(ml_score) - min(ml_score) AS score_range, max(ml_score) - median(ml_score) AS top_1_minus_median_score,
  avg(ml_score) FILTER (rk <= 5) - avg(ml_score) AS top_5_average_minus_universe_average, avg(ml_score) FILTER (rk <= 5) AS selected_score_average FROM rkall GROUP BY 1) g
  LEFT JOIN mm m ON m.date = g.date""")
DISP = "score_mean score_std score_min score_max score_range top_1_minus_median_score top_5_average_minus_universe_average selected_score_average rank_ic top_n_hit_rate top_n_spread"
register("c15_score_dispersion", lambda s, d: C.score_dispersion(SC(s, d)), out("disp", "date", DISP))
DM = ("score_std", "score_range", "top_1_minus_median_score", "top_5_average_minus_universe_average")
register(
    "c15_dispersion_correlation", lambda s, d: C.dispersion_correlations(C.score_dispersion(SC(s, d))),
    out("(" + " UNION ALL ".join(
        f"SELECT '{m}' AS dispersion_measure, {pearson(m, 'top_n_spread')} AS correlation_with_top_n_spread, {pearson(m, 'rank_ic')} AS correlation_with_rank_ic FROM disp" for m in DM) + ")",
        "dispersion_measure", "correlation_with_top_n_spread correlation_with_rank_ic"),
)
