"""Bound queries: capacity, live tables and the paper ledger (B10-B18, J9, J12-J13, R4, Q30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators import attribution as A, capacity as K, ledger as L, live as V, ranking as R, timeseries as T
from stratapanel.plans import bindings as B, data_queries as D
from stratapanel.plans.oracle_base import evaluated, frag, ledger, out, query
from stratapanel.plans.registry import register

CONFIG = K.ExecutionConfig(adv_window=3)

# --- capacity ---------------------------------------------------------------
ADV = lambda s, d: T.average_dollar_volume(B.brand(s, d).withColumnRenamed("close", "raw_close"), 3)


@B.shared
def schedule(s, d) -> DataFrame:
    return K.paired_schedule(B.suite_positions(s, d), B.brand(s, d), ADV(s, d), 3)


SCHEDULE = schedule
frag("sch0", "SELECT signal_date, min(date) AS realization_date FROM pos GROUP BY 1 HAVING count(DISTINCT strategy) = 3")
frag("sch", """SELECT s.signal_date, s.realization_date, a.next_date AS next_entry, b.next_date AS next_exit,
  CASE WHEN s.signal_date < (SELECT min(date) FROM (SELECT date FROM adv_b GROUP BY 1 HAVING count(adv) = (SELECT count(*) FROM tick_b))) THEN 'before_complete_liquidity_history'
  WHEN a.next_date IS NULL OR b.next_date IS NULL THEN 'terminal_next_session_unavailable' END AS reason
  FROM sch0 s LEFT JOIN cal_b a ON a.date = s.signal_date LEFT JOIN cal_b b ON b.date = s.realization_date""")
register("j9_paired_schedule", SCHEDULE, query("SELECT signal_date, realization_date, next_entry, next_exit, reason FROM sch"))
register(
    "j9_schedule_violations", lambda s, d: K.schedule_violations(SCHEDULE(s, d).where(F.month("signal_date") != 6)).select("signal_date", "previous_end", "violation"),
    query("""SELECT signal_date, previous_end, 'NONCONTIGUOUS_PAIRED_SCHEDULE' AS violation FROM (SELECT *, lag(realization_date) OVER (ORDER BY signal_date) AS previous_end FROM sch
      WHERE reason IS NULL AND month(signal_date) <> 6) WHERE previous_end <> signal_date"""),
)


@B.shared
def capacity_trades(s, d) -> DataFrame:
    timed = K.timed_positions(B.suite_positions(s, d), SCHEDULE(s, d), B.brand(s, d))
    return K.capacity_trades(timed, ADV(s, d), CONFIG)


frag("tq", "SELECT 'same_close_diagnostic' AS timing, date, ticker, close AS price FROM px_b UNION ALL SELECT 'next_session_open', date, ticker, open FROM px_b")
frag("tsch", """SELECT signal_date, 'same_close_diagnostic' AS timing, signal_date AS a, realization_date AS b FROM sch WHERE reason IS NULL
  UNION ALL SELECT signal_date, 'next_session_open', next_entry, next_exit FROM sch WHERE reason IS NULL""")
frag("tpos", """SELECT p.strategy, t.timing, p.signal_date, t.b AS date, p.ticker, p.weight, y.price / x.price - 1 AS asset_return FROM pos p JOIN tsch t ON t.signal_date = p.signal_date
  JOIN tq x ON x.timing = t.timing AND x.date = t.a AND x.ticker = p.ticker JOIN tq y ON y.timing = t.timing AND y.date = t.b AND y.ticker = p.ticker""")

ledger("tpos", "strategy, timing")
frag("ctr0", """SELECT t.*, v.adv, a.aum, CASE WHEN abs(target_weight - pretrade_weight) <= 1e-12 THEN 0 ELSE target_weight - pretrade_weight END AS trade_weight
  FROM tpos_tr t LEFT JOIN adv_b v ON v.date = t.signal_date AND v.ticker = t.ticker CROSS JOIN (SELECT unnest([1e5, 1e6, 1e7, 5e7, 1e8]) AS aum) a""")
frag("ctr1", "SELECT *, CASE WHEN trade_weight <> 0 THEN aum * abs(trade_weight) / adv ELSE 0 END AS trade_as_pct_adv FROM ctr0")
frag("ctr", """SELECT *, 5 + 10 * sqrt(trade_as_pct_adv / 0.01) AS cost_bps_per_traded_dollar, aum * target_weight AS position_dollars, aum * trade_weight AS trade_dollars,
  aum * abs(trade_weight) * (5 + 10 * sqrt(trade_as_pct_adv / 0.01)) / 10000 AS estimated_cost_dollars FROM ctr1""")
frag("cper0", """SELECT strategy, timing, aum, seq, max(signal_date) AS signal_date, max(date) AS valuation_date, sum(target_weight * asset_return) AS gross_return,
  CASE WHEN seq = 1 THEN 1.0 ELSE sum(abs(target_weight - pretrade_weight)) / 2 END AS turnover, sum(estimated_cost_dollars) / aum AS c FROM ctr GROUP BY 1, 2, 3, 4""")
frag("cper", """SELECT *, gross_return - turnover * 0.001 AS constant_10bps_return, c * 10000 AS estimated_cost_bps, gross_return - c AS diagnostic_net_return, seq = 1 AS initial_deployment FROM cper0""")
DOLLARS = ("position_dollars", "trade_dollars", "estimated_cost_dollars")
register(
    "b14_trade_diagnostics", lambda s, d: capacity_trades(s, d).select(
        "strategy", "timing", "aum", "signal_date", "ticker", "trade_weight", "trade_as_pct_adv", "cost_bps_per_traded_dollar",
        *[F.round(c, 2).alias(c) for c in DOLLARS]),  # whole cents
    out("(SELECT * REPLACE (" + ", ".join(f"round({c}, 2) AS {c}" for c in DOLLARS) + ") FROM ctr)", "strategy timing signal_date ticker",
        "aum trade_weight trade_as_pct_adv cost_bps_per_traded_dollar position_dollars trade_dollars estimated_cost_dollars"),
)
PERIODS = lambda s, d: K.capacity_periods(capacity_trades(s, d))
register(
    "b15_capacity_ledger", PERIODS,
    out("cper", "strategy timing signal_date valuation_date initial_deployment", "aum gross_return turnover constant_10bps_return estimated_cost_bps diagnostic_net_return", "seq"),
)
frag("cnet", "SELECT strategy, timing, aum, valuation_date AS date, diagnostic_net_return AS ret FROM cper")
frag("cflat", "SELECT strategy, timing, aum, valuation_date AS date, constant_10bps_return AS ret FROM cper")
evaluated("cnete", "cnet", "strategy, timing, aum", active=False)
evaluated("cflate", "cflat", "strategy, timing, aum", active=False)
frag("csum", """SELECT p.*, u.median_trade_pct_adv, u.p95_trade_pct_adv, u.max_trade_pct_adv, u.pct_trades_gt_1pct_adv, u.pct_trades_gt_5pct_adv, u.pct_trades_gt_10pct_adv,
  n.sharpe AS diagnostic_sharpe, n.annual_return AS diagnostic_cagr, f.sharpe AS constant_10bps_sharpe,
  CASE WHEN u.max_trade_pct_adv > 0.1 THEN 'above_largest_tested_limit' ELSE 'within_largest_tested_limit_not_execution_assurance' END AS capacity_flag FROM
  (SELECT strategy, timing, aum, count(*) AS observations, min(signal_date) AS first_signal_date, max(valuation_date) AS last_valuation_date, avg(estimated_cost_bps) AS estimated_cost_bps,
   avg(turnover) * 12 AS annualized_turnover FROM cper GROUP BY 1, 2, 3) p
  LEFT JOIN (SELECT strategy, timing, aum, quantile_cont(trade_as_pct_adv, 0.5) AS median_trade_pct_adv, quantile_cont(trade_as_pct_adv, 0.95) AS p95_trade_pct_adv, max(trade_as_pct_adv) AS max_trade_pct_adv,
   avg(CASE WHEN trade_as_pct_adv > 0.01 THEN 1.0 ELSE 0 END) AS pct_trades_gt_1pct_adv, avg(CASE WHEN trade_as_pct_adv > 0.05 THEN 1.0 ELSE 0 END) AS pct_trades_gt_5pct_adv,
   avg(CASE WHEN trade_as_pct_adv > 0.1 THEN 1.0 ELSE 0 END) AS pct_trades_gt_10pct_adv FROM ctr WHERE trade_weight <> 0 GROUP BY 1, 2, 3) u USING (strategy, timing, aum)
  JOIN cnete n USING (strategy, timing, aum) JOIN cflate f USING (strategy, timing, aum)""")
SUMMARY = lambda s, d: K.capacity_summary(capacity_trades(s, d), PERIODS(s, d), CONFIG)
register(
    "b16_capacity_summary", SUMMARY,
    out("csum", "strategy timing first_signal_date last_valuation_date capacity_flag",
        "aum estimated_cost_bps annualized_turnover median_trade_pct_adv p95_trade_pct_adv max_trade_pct_adv pct_trades_gt_1pct_adv pct_trades_gt_5pct_adv pct_trades_gt_10pct_adv "
        "diagnostic_sharpe diagnostic_cagr constant_10bps_sharpe", "observations"),
)
register(
    "b17_capacity_ceilings", lambda s, d: K.capacity_ceilings(capacity_trades(s, d), CONFIG),
    out("""(SELECT strategy, timing, l AS max_participation, min(l * adv / abs(trade_weight)) AS diagnostic_aum_ceiling,
      arg_min(ticker, (l * adv / abs(trade_weight), ticker, signal_date)) AS binding_ticker, arg_min(signal_date, (l * adv / abs(trade_weight), ticker, signal_date)) AS binding_signal_date
      FROM ctr CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS l) WHERE aum = 1e5 AND trade_weight <> 0 GROUP BY 1, 2, 3)""", "strategy timing binding_ticker binding_signal_date",
        "max_participation diagnostic_aum_ceiling"),
)
MS = ("diagnostic_sharpe", "diagnostic_cagr", "constant_10bps_sharpe")
both = ", ".join(f"max({m}) FILTER (timing = '{t}') AS {m}_{t}" for m in MS for t in (K.NEXT_OPEN, K.SAME_CLOSE))
delta = ", ".join(f"{m}_{K.NEXT_OPEN} - {m}_{K.SAME_CLOSE} AS {m}_next_minus_same" for m in MS)
register(
    "b18_timing_comparison", lambda s, d: K.timing_comparison(SUMMARY(s, d)),
    out(f"(SELECT *, {delta} FROM (SELECT strategy, aum, {both} FROM csum GROUP BY 1, 2))", "strategy",
        "aum " + " ".join(f"{m}_{t}" for m in MS for t in (K.NEXT_OPEN, K.SAME_CLOSE)) + " " + " ".join(f"{m}_next_minus_same" for m in MS)),
)

# --- live tables ------------------------------------------------------------
@B.shared
def signals(s, d) -> DataFrame:
    return V.momentum_signals(B.closes(B.brand(s, d)), D.brands(s, d), D.ELIGIBLE(s, d))


SIGNALS = signals
frag("now", """SELECT k.ticker, (SELECT max(date) FROM px_b) AS signal_date, g.momentum_3m, g.momentum_12_1 FROM breq k LEFT JOIN lag_b g ON g.ticker = k.ticker AND g.date = (SELECT max(date) FROM px_b)""")
frag("nowr", """SELECT *, row_number() OVER (ORDER BY momentum_3m DESC NULLS LAST, ticker) AS r3, row_number() OVER (ORDER BY momentum_12_1 DESC NULLS LAST, ticker) AS r12 FROM now""")
frag("sig", f"""SELECT n.ticker, n.signal_date, n.momentum_3m, CASE WHEN n.momentum_3m IS NOT NULL THEN r3 END AS rank_3m, n.momentum_12_1, CASE WHEN n.momentum_12_1 IS NOT NULL THEN r12 END AS rank_12_1,
  n.momentum_3m IS NOT NULL AND n.momentum_12_1 IS NOT NULL AND p.ticker IS NOT NULL AS signal_valid, CASE WHEN p.ticker IS NULL THEN 'missing_ticker'
  WHEN n.momentum_3m IS NULL OR n.momentum_12_1 IS NULL THEN 'missing_momentum_history' END AS invalid_reason FROM nowr n LEFT JOIN tick_b p ON p.ticker = n.ticker""")
register(
    "r4_momentum_signals", SIGNALS, out("sig", "ticker signal_date signal_valid invalid_reason", "momentum_3m momentum_12_1", "rank_3m rank_12_1"),
)

register(
    "j15_replay_signals", lambda s, d: V.replay_signals(B.closes(B.supplier(s, d)), "1998-01-01", "2001-11-30"),
    out("""(SELECT date AS as_of, ticker, momentum_3m, momentum_12_1,
      CASE WHEN momentum_3m IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY momentum_3m DESC NULLS LAST, ticker) END AS rank_3m,
      CASE WHEN momentum_12_1 IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY momentum_12_1 DESC NULLS LAST, ticker) END AS rank_12_1
      FROM lag_s WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-11-30' AND (momentum_3m IS NOT NULL OR momentum_12_1 IS NOT NULL))""",
        "as_of ticker", "momentum_3m momentum_12_1", "rank_3m rank_12_1"),
)


REPLAY = ("1999-01-01", "2001-06-30")


@B.shared
def replay(s, d) -> DataFrame:
    return V.replay_decisions(B.closes(B.supplier(s, d)), B.supplier_scores(s, d), *REPLAY, n=5, stale_days=40)


span = "BETWEEN DATE '{}' AND DATE '{}'".format(*REPLAY)
frag("rep_ok", f"""SELECT DISTINCT c.date AS as_of, p.ticker FROM cal_s c JOIN px_s p ON p.date <= c.date AND date_diff('day', p.date, c.date) <= 40 WHERE c.date {span}""")
frag("rep_sig", f"""SELECT date AS as_of, ticker, momentum_3m, momentum_12_1, row_number() OVER (PARTITION BY date ORDER BY momentum_3m DESC NULLS LAST, ticker) AS r3,
  row_number() OVER (PARTITION BY date ORDER BY momentum_12_1 DESC NULLS LAST, ticker) AS r12 FROM lag_s WHERE date {span} AND (momentum_3m IS NOT NULL OR momentum_12_1 IS NOT NULL)""")
frag("rep_val", "SELECT g.* FROM rep_sig g JOIN rep_ok e ON e.as_of = g.as_of AND e.ticker = g.ticker WHERE momentum_3m IS NOT NULL AND momentum_12_1 IS NOT NULL")
frag("rep_rank", f"""SELECT 'momentum_3m_equal' AS strategy, as_of, ticker, r3 AS rank FROM rep_val UNION ALL SELECT 'momentum_12_1_equal', as_of, ticker, r12 FROM rep_val
  UNION ALL SELECT 'ml', date, c.ticker, row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, c.ticker) FROM sc_s c JOIN rep_ok e ON e.as_of = c.date AND e.ticker = c.ticker WHERE date {span} AND ml_score IS NOT NULL""")
frag("rep_all", f"""SELECT r.strategy, r.as_of, CASE WHEN g.next_date <= DATE '{REPLAY[1]}' THEN g.next_date END AS next_as_of, r.ticker, r.rank, 1.0 / count(*) OVER (PARTITION BY r.strategy, r.as_of) AS target_weight,
  CASE WHEN g.next_date <= DATE '{REPLAY[1]}' THEN g.future_return END AS asset_return, b.n AS eligible_securities FROM (SELECT *, row_number() OVER (PARTITION BY strategy, as_of ORDER BY rank, ticker) AS nth FROM rep_rank) r
  JOIN lag_s g ON g.date = r.as_of AND g.ticker = r.ticker JOIN (SELECT as_of, count(*) AS n FROM rep_ok GROUP BY 1) b ON b.as_of = r.as_of WHERE nth <= 5""")
register(
    "j15_replay_targets", replay,
    out("rep_all", "strategy as_of next_as_of ticker", "target_weight asset_return", "rank eligible_securities"),
)
frag("rep", "SELECT strategy, as_of AS signal_date, next_as_of AS date, ticker, target_weight AS weight, asset_return FROM rep_all WHERE next_as_of IS NOT NULL")
ledger("rep")
register(
    "j15_replay_evaluation", lambda s, d: V.replay_evaluation(replay(s, d), B.benchmark(s, d)),
    out("""(SELECT l.strategy, l.signal_date, l.date AS realization_date, gross_return, transaction_cost, net_return, b.bench AS benchmark_return, net_return - b.bench AS active_return,
      product(1 + net_return) OVER w AS portfolio_value, product(1 + b.bench) OVER w AS benchmark_value FROM rep_led l JOIN br b ON b.date = l.date
      WINDOW w AS (PARTITION BY l.strategy ORDER BY l.date ROWS UNBOUNDED PRECEDING))""",
        "strategy signal_date realization_date", "gross_return transaction_cost net_return benchmark_return active_return portfolio_value benchmark_value"),
)


@B.shared
def predictions(s, d) -> DataFrame:
    now = B.brand_scores(s, d)
    last = now.agg(F.max("date").alias("date"))
    return R.score_order(now.join(F.broadcast(last), "date", "left_semi"), name="ml_rank").select("ticker", "date", "ml_score", "ml_rank")


frag("pred", "SELECT ticker, date, ml_score, row_number() OVER (ORDER BY ml_score DESC, ticker) AS ml_rank FROM sc_b WHERE date = (SELECT max(date) FROM sc_b)")


@B.shared
def targets(s, d) -> DataFrame:
    sig = SIGNALS(s, d).where("signal_valid")
    part = lambda name, rank: sig.select(F.lit(name).alias("strategy"), "signal_date", "ticker", F.col(rank).alias("rank"))
    ml = predictions(s, d).select(F.lit("ml").alias("strategy"), F.col("date").alias("signal_date"), "ticker", F.col("ml_rank").alias("rank"))
    return V.target_portfolios(part("momentum_3m_equal", "rank_3m").unionByName(part("momentum_12_1_equal", "rank_12_1")).unionByName(ml), 5)


frag("tgt", """SELECT strategy, signal_date, ticker, 0.2 AS target_weight, rank AS rank_or_reason, 'equal' AS optimization_status FROM (
  SELECT 'momentum_3m_equal' AS strategy, signal_date, ticker, rank_3m AS rank FROM sig WHERE signal_valid UNION ALL
  SELECT 'momentum_12_1_equal', signal_date, ticker, rank_12_1 FROM sig WHERE signal_valid UNION ALL SELECT 'ml', date, ticker, ml_rank FROM pred) WHERE rank <= 5""")
register("b10_target_portfolios", targets, out("tgt", "strategy signal_date ticker optimization_status", "target_weight", "rank_or_reason"))


@B.shared
def previous(s, d) -> DataFrame:
    """Last evaluated decision of each strategy but one, drifted to the last date."""
    last = B.suite_positions(s, d).where(F.col("strategy") != "ml")
    end = last.agg(F.max("signal_date").alias("signal_date"))
    old = last.join(F.broadcast(end), "signal_date", "left_semi").select("strategy", "signal_date", "ticker", F.col("weight").alias("target_weight"))
    newest = B.brand(s, d).agg(F.max("date")).first()[0]
    return V.pretrade_weights(old, B.brand(s, d), F.lit(newest))


frag("prev", """SELECT strategy, ticker, weight * (1 + asset_return) / sum(weight * (1 + asset_return)) OVER (PARTITION BY strategy) AS pretrade_weight FROM pos
  WHERE strategy <> 'ml' AND asset_return IS NOT NULL AND signal_date = (SELECT max(signal_date) FROM pos WHERE strategy <> 'ml')""")
register("w8_live_pretrade", previous, out("prev", "strategy ticker", "pretrade_weight"))
frag("sides", """SELECT coalesce(t.strategy, p.strategy) AS strategy, coalesce(t.ticker, p.ticker) AS ticker, coalesce(t.target_weight, 0) AS target_weight,
  coalesce(p.pretrade_weight, 0) AS pretrade_weight, p.ticker IS NOT NULL AS o FROM tgt t FULL OUTER JOIN prev p ON p.strategy = t.strategy AND p.ticker = t.ticker""")
frag("psum", """SELECT strategy, count(*) FILTER (target_weight > 1e-10) AS number_holdings, 1 / sum(target_weight * target_weight) AS effective_holdings, max(target_weight) AS max_weight, 0.6 AS top3_weight,
  CASE WHEN bool_or(o) THEN sum(abs(target_weight - pretrade_weight)) / 2 ELSE 1.0 END AS estimated_turnover_vs_previous, CASE WHEN bool_or(o) THEN 'rebalance' ELSE 'initial_deployment' END AS deployment_status,
  'equal' AS optimization_status, CASE WHEN bool_or(o) THEN sum(abs(target_weight - pretrade_weight)) / 2 ELSE 1.0 END * 10 / 10000 AS estimated_transaction_cost FROM sides GROUP BY 1""")
PSUM = lambda s, d: V.portfolio_summary(targets(s, d), previous(s, d))
register(
    "b10_portfolio_summary", PSUM,
    out("psum", "strategy deployment_status optimization_status", "effective_holdings max_weight top3_weight estimated_turnover_vs_previous estimated_transaction_cost", "number_holdings"),
)
LEDGER = lambda s, d: V.trade_ledger(targets(s, d), previous(s, d), PSUM(s, d))
frag("tled", """SELECT s.strategy, s.ticker, s.pretrade_weight, s.target_weight, s.target_weight - s.pretrade_weight AS trade_weight,
  p.estimated_transaction_cost * abs(s.target_weight - s.pretrade_weight) / sum(abs(s.target_weight - s.pretrade_weight)) OVER (PARTITION BY s.strategy) AS estimated_transaction_cost
  FROM sides s JOIN psum p ON p.strategy = s.strategy""")
register("b12_trade_ledger", LEDGER, out("tled", "strategy ticker", "pretrade_weight target_weight trade_weight estimated_transaction_cost"))
register(
    "b12_recommendations", lambda s, d: V.recommendations(targets(s, d), LEDGER(s, d), B.brand(s, d)),
    out("""(SELECT t.strategy, t.signal_date, t.ticker, t.target_weight, p.close AS reference_price, l.estimated_transaction_cost AS estimated_cost, 'research_reference_price_not_execution_fill' AS status
      FROM tgt t JOIN px_b p ON p.ticker = t.ticker AND p.date = t.signal_date JOIN tled l ON l.strategy = t.strategy AND l.ticker = t.ticker)""", "strategy signal_date ticker status",
        "target_weight reference_price estimated_cost"),
)


def frozen(s, d) -> DataFrame:
    led = B.suite_ledger(s, d).select("strategy", "signal_date", (F.col("transaction_cost") / F.col("holdings")).alias("estimated_cost"))
    decisions = B.suite_positions(s, d).join(led, ["strategy", "signal_date"]).select(
        "strategy", "signal_date", "ticker", F.col("weight").alias("target_weight"), "estimated_cost")
    due = B.suite_positions(s, d).select("signal_date", F.col("date").alias("realization_date")).distinct()
    return V.frozen_evaluation(decisions, B.brand(s, d), B.benchmark(s, d), due)


register(
    "b13_frozen_evaluation", frozen,
    out("""(SELECT l.strategy, l.signal_date, l.date AS realization_date, gross_return, transaction_cost, net_return, b.bench AS benchmark_return, net_return - b.bench AS active_return,
      product(1 + net_return) OVER w AS portfolio_value, product(1 + b.bench) OVER w AS benchmark_value FROM pos_led l JOIN br b ON b.date = l.date
      WINDOW w AS (PARTITION BY l.strategy ORDER BY l.date))""", "strategy signal_date realization_date",
        "gross_return transaction_cost net_return benchmark_return active_return portfolio_value benchmark_value"),
)
FLAGS = {"selected_by_3m": "momentum_3m_equal", "selected_by_12_1": "momentum_12_1_equal", "selected_by_ml": "ml"}
WEIGHTS = {"weight_in_ml": "ml"}
register(
    "j12_consensus", lambda s, d: V.consensus(targets(s, d), SIGNALS(s, d), predictions(s, d), FLAGS, WEIGHTS),
    out("""(SELECT k.ticker, coalesce(bool_or(t.strategy = 'momentum_3m_equal'), false) AS selected_by_3m, coalesce(bool_or(t.strategy = 'momentum_12_1_equal'), false) AS selected_by_12_1,
      coalesce(bool_or(t.strategy = 'ml'), false) AS selected_by_ml, coalesce(max(t.target_weight) FILTER (t.strategy = 'ml'), 0) AS weight_in_ml,
      count(DISTINCT t.strategy) AS number_strategies_selecting_or_holding, max(x.m) AS average_normalized_rank FROM breq k LEFT JOIN tgt t ON t.ticker = k.ticker
      LEFT JOIN (SELECT ticker, avg(v) AS m FROM (SELECT ticker, rank_3m / max(rank_3m) OVER () AS v FROM sig UNION ALL SELECT ticker, rank_12_1 / max(rank_12_1) OVER () FROM sig
        UNION ALL SELECT ticker, ml_rank / max(ml_rank) OVER () FROM pred) GROUP BY 1) x ON x.ticker = k.ticker GROUP BY 1)""", "ticker selected_by_3m selected_by_12_1 selected_by_ml",
        "weight_in_ml average_normalized_rank", "number_strategies_selecting_or_holding"),
)
register(
    "j13_cross_summary",
    lambda s, d: V.cross_summary(predictions(s, d), V.momentum_now(B.closes(B.brand(s, d)), B.brand(s, d).select("ticker").distinct()), 5),
    out("""(SELECT p.ticker, p.date, p.ml_score, p.ml_rank, n.momentum_3m, n.r3 AS rank_3m, n.momentum_12_1, n.r12 AS rank_12_1,
      CAST(p.ml_rank <= 5 AS INT) + CAST(n.r3 <= 5 AS INT) + CAST(n.r12 <= 5 AS INT) AS consensus_count FROM pred p LEFT JOIN nowr n ON n.ticker = p.ticker)""",
        "ticker date", "ml_score momentum_3m momentum_12_1", "ml_rank rank_3m rank_12_1 consensus_count"),
)
LIMITS = V.FlagThresholds(high_single_name_weight=0.15, low_effective_holdings=6.0, high_turnover=0.5, model_score_range_low=0.99, historical_top1_contribution_high=0.1)
flag = lambda scope, name, value, limit, source, cond: f"SELECT {scope} AS scope, '{name}' AS flag, {value} AS value, '{limit}' AS threshold FROM {source} WHERE {cond}"
six = lambda c: f"printf('%.6f', {c})"
register(
    "q30_risk_flags",
    lambda s, d: V.risk_flags(PSUM(s, d), D.ELIGIBLE(s, d), SIGNALS(s, d), predictions(s, d), A.contribution_concentration(B.common_positions(s, d)), LIMITS),
    query(" UNION ALL ".join([
        flag("strategy", "HIGH_SINGLE_NAME_WEIGHT", six("max_weight"), 0.15, "psum", "max_weight >= 0.15"),
        flag("strategy", "LOW_EFFECTIVE_HOLDINGS", six("effective_holdings"), 6.0, "psum", "effective_holdings < 6"),
        flag("strategy", "HIGH_TURNOVER", six("estimated_turnover_vs_previous"), 0.5, "psum", "estimated_turnover_vs_previous > 0.5"),
        flag("ticker", "MISSING_SIGNAL", "CAST(NULL AS VARCHAR)", 7, "breq", "ticker NOT IN (SELECT ticker FROM px_b)"),
        flag("ticker", "MISSING_SIGNAL", "invalid_reason", "valid", "sig", "NOT signal_valid"),
        flag("'ml'", "MODEL_SCORE_CONCENTRATION", six("r"), 0.99, "(SELECT max(ml_score) - min(ml_score) AS r FROM pred)", "r < 0.99"),
        flag("strategy", "HIGH_HISTORICAL_CONTRIBUTION_DEPENDENCE", six("top_1_share"), 0.1, "cconc", "top_1_share > 0.1"),
    ])),
)
