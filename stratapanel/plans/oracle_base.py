"""Building blocks of the DuckDB oracles.

A fragment is the body of one CTE.  ``query`` collects the fragments a final
SELECT mentions, in dependency order.  The oracles deliberately take another
route than the Spark plans: dense date x ticker grids, plain lags and self joins.
"""

from __future__ import annotations

import re

from stratapanel.plans.registry import EXACT

FRAGMENTS: dict[str, str] = {}
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def frag(name: str, body: str) -> str:
    FRAGMENTS[name] = body
    return name


def query(final: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in FRAGMENTS and word not in order:
                visit(FRAGMENTS[word])
                if word not in order:
                    order.append(word)

    visit(final)
    head = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in order)
    return (f"WITH {head}\n" if head else "") + final


def out(source: str, plain: str = "", dbl: str = "", big: str = "", where: str = "") -> str:
    """Final SELECT: doubles rounded to 6 places, counts as BIGINT."""
    columns = plain.split()
    columns += [
        f"CAST({c} AS DOUBLE) AS {c}" if c in EXACT else f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in dbl.split()
    ]
    columns += [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
    return query(f"SELECT {', '.join(columns)} FROM {source}" + (f" WHERE {where}" if where else ""))


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN abs({b}) > 1e-8 THEN ({a}) / ({b}) END)"


def pearson(x: str, y: str) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return (
        f"(CASE WHEN stddev_samp({x}) {both} * stddev_samp({y}) {both} > 0 THEN "
        f"covar_samp({x}, {y}) / (stddev_samp({x}) {both} * stddev_samp({y}) {both}) END)"
    )


CENTS = "sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) / 100.0::DOUBLE"
BAR = (
    f"{CENTS} AS value, sum(l_quantity) AS volume, min(l_extendedprice / l_quantity) AS open, "
    f"{CENTS} / sum(l_quantity) AS close"
)
MONTH = "last_day(CAST(l_shipdate AS DATE))"
FEATURES = ("momentum_1m", "momentum_3m", "momentum_6m", "volatility_3m", "drawdown_3m")

frag("px_b", f"SELECT {MONTH} AS date, p_brand AS ticker, {BAR} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
frag("px_s", f"SELECT {MONTH} AS date, CAST(l_suppkey AS VARCHAR) AS ticker, {BAR} FROM lineitem GROUP BY 1, 2")
frag("px_n", f"SELECT CAST(l_shipdate AS DATE) AS date, 'N' || s_nationkey AS ticker, {BAR} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
frag("px_r", f"SELECT CAST(l_shipdate AS DATE) AS date, r_name AS ticker, {BAR} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
frag("bm", f"SELECT {MONTH} AS date, {CENTS} / sum(l_quantity) AS close FROM lineitem GROUP BY 1")
frag("bday", f"SELECT CAST(l_shipdate AS DATE) AS date, {CENTS} / sum(l_quantity) AS close FROM lineitem GROUP BY 1")
frag("br", "SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM bm")
frag("mkt", f"""SELECT CAST(l_shipdate AS DATE) AS date, 'N' || s_nationkey AS canonical_ticker,
  'N' || s_nationkey AS provider_ticker,
  sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT))) / 10000.0::DOUBLE / sum(l_quantity) AS adjusted_close,
  {CENTS} / sum(l_quantity) AS raw_close, sum(l_quantity) AS volume,
  sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_tax * 100 + 0.5) AS BIGINT) ELSE 0 END) / 100.0::DOUBLE AS dividends,
  max(CASE WHEN l_linestatus = 'F' AND l_quantity = 50 THEN 2.0 ELSE 0.0 END) AS stock_splits
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
frag("feed", """SELECT date, canonical_ticker, provider_ticker,
  CASE WHEN volume % 97 = 0 THEN 0 WHEN volume % 89 = 0 THEN -raw_close ELSE adjusted_close END AS adjusted_close,
  CASE WHEN volume % 83 = 0 THEN -1 ELSE raw_close END AS raw_close,
  CASE WHEN volume % 79 = 0 THEN -volume ELSE volume END AS volume, dividends, stock_splits,
  (date_diff('day', DATE '1990-01-01', date) % 7) * 100000 + date_diff('day', DATE '1990-01-01', date) AS ingest_seq
  FROM (SELECT * FROM mkt UNION ALL SELECT * FROM mkt WHERE volume % 73 = 0)""")
frag("ev", "SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS ticker, value, event_id AS version FROM events")
frag("sec_b", "SELECT DISTINCT p_brand AS ticker, r_name AS sector FROM part LEFT JOIN region ON CAST(substr(p_brand, 7) AS INT) % 5 = r_regionkey")
frag("sec_s", "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
frag("mem", """SELECT 'SUPPLIERS' AS index_name, a.ticker, s.sector, a.effective_from,
  CASE WHEN CAST(a.ticker AS BIGINT) % 5 = 0 THEN CAST(a.effective_from + INTERVAL 36 MONTH AS DATE) END AS effective_to,
  CASE WHEN CAST(a.ticker AS BIGINT) % 5 = 0 THEN 'registry-b' ELSE 'registry-a' END AS source,
  a.effective_from AS source_date
  FROM (SELECT ticker, min(date) AS effective_from FROM px_s GROUP BY 1) a LEFT JOIN sec_s s ON a.ticker = s.ticker""")

for x in "bsnr":
    frag(f"cal_{x}", f"SELECT date, row_number() OVER (ORDER BY date) AS t, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM px_{x})")
    frag(f"tick_{x}", f"SELECT DISTINCT ticker FROM px_{x}")
    frag(f"grid_{x}", f"SELECT c.date, c.t, c.next_date, k.ticker, p.open, p.close, p.volume, p.value FROM cal_{x} c CROSS JOIN tick_{x} k LEFT JOIN px_{x} p ON p.date = c.date AND p.ticker = k.ticker")
    frag(f"lag_{x}", f"""SELECT *, close / lag(close) OVER w - 1 AS momentum_1m, close / lag(close, 3) OVER w - 1 AS momentum_3m,
      close / lag(close, 6) OVER w - 1 AS momentum_6m, lag(close) OVER w / lag(close, 12) OVER w - 1 AS momentum_12_1,
      lead(close) OVER w / close - 1 AS future_return FROM grid_{x} WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
    frag(f"feat_{x}", f"""SELECT *, CASE WHEN count(momentum_1m) OVER w = 3 THEN stddev_samp(momentum_1m) OVER w * sqrt(12) END AS volatility_3m,
      CASE WHEN count(close) OVER w = 3 THEN close / max(close) OVER w - 1 END AS drawdown_3m
      FROM lag_{x} WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
    frag(f"ds_{x}", f"""SELECT f.date, f.ticker, {', '.join('f.' + c for c in FEATURES)}, f.future_return, f.next_date AS target_date,
      b.bench AS benchmark_return, CASE WHEN f.future_return IS NOT NULL AND b.bench IS NOT NULL THEN CAST(f.future_return > b.bench AS INT) END AS target
      FROM feat_{x} f LEFT JOIN br b ON b.date = f.next_date WHERE {' AND '.join('f.' + c + ' IS NOT NULL' for c in FEATURES)}""")
    ranks = " + ".join(f"percent_rank() OVER (PARTITION BY date ORDER BY {c})" for c in FEATURES)
    frag(f"sc_{x}", f"SELECT date, target_date, ticker, ({ranks}) / 5 AS ml_score, future_return, benchmark_return, target FROM ds_{x}")


def momentum_pos(name: str, x: str, column: str, n: int = 5) -> str:
    return (
        f"SELECT '{name}' AS strategy, date AS signal_date, next_date AS date, ticker, rk, future_return AS asset_return, "
        f"1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date "
        f"ORDER BY {column} DESC, ticker) AS rk FROM lag_{x} WHERE {column} IS NOT NULL AND next_date IS NOT NULL) WHERE rk <= {n}"
    )


def score_pos(name: str, x: str, n: int = 5) -> str:
    return (
        f"SELECT '{name}' AS strategy, date AS signal_date, target_date AS date, ticker, rk, future_return AS asset_return, "
        f"1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date "
        f"ORDER BY ml_score DESC, ticker) AS rk FROM sc_{x} WHERE date IN (SELECT date FROM sc_{x} WHERE future_return IS NOT NULL)) WHERE rk <= {n}"
    )


frag("pos", " UNION ALL ".join([
    momentum_pos("momentum_3m_equal", "b", "momentum_3m"), momentum_pos("momentum_12_1_equal", "b", "momentum_12_1"),
    score_pos("ml", "b"),
]))


def ledger(p: str, keys: str = "strategy", cost: str = "10") -> str:
    """Fragments ``{p}_tr`` (trades) and ``{p}_led`` (periods)."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    pick = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in ks)
    frag(f"{p}_seq", f"SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY signal_date) AS seq FROM {p}")
    g = f"OVER (PARTITION BY {keys}, seq)"
    frag(f"{p}_dr", f"SELECT *, CASE WHEN count(*) {g} = count(asset_return) {g} THEN weight * (1 + asset_return) / sum(weight * (1 + asset_return)) {g} END AS drift FROM {p}_seq")
    frag(f"{p}_tr0", f"""SELECT {pick}, coalesce(a.seq, b.seq + 1) AS seq, coalesce(a.ticker, b.ticker) AS ticker,
      coalesce(a.weight, 0) AS target_weight, CASE WHEN b.ticker IS NULL THEN 0 ELSE b.drift END AS pretrade_weight, a.asset_return, a.signal_date AS sd, a.date AS dt
      FROM {p}_dr a FULL OUTER JOIN {p}_dr b ON {same} AND a.ticker = b.ticker AND a.seq = b.seq + 1""")
    frag(f"{p}_tr", f"""SELECT * FROM (SELECT *, max(sd) OVER (PARTITION BY {keys}, seq) AS signal_date,
      max(dt) OVER (PARTITION BY {keys}, seq) AS date FROM {p}_tr0) WHERE signal_date IS NOT NULL""")
    frag(f"{p}_led0", f"""SELECT {keys}, seq, max(signal_date) AS signal_date, max(date) AS date, CASE WHEN count(sd) = count(asset_return) THEN sum(target_weight * asset_return) END AS gross_return,
      CASE WHEN seq = 1 THEN 1.0 WHEN count(pretrade_weight) = count(*) THEN sum(abs(target_weight - pretrade_weight)) / 2 END AS turnover, count(sd) AS holdings,
      sum(target_weight * target_weight) AS hhi FROM {p}_tr GROUP BY {keys}, seq""")
    frag(f"{p}_led", f"SELECT *, turnover * {cost} / 10000 AS transaction_cost, gross_return - turnover * {cost} / 10000 AS net_return FROM {p}_led0")
    return f"{p}_led"


def path(r: str, keys: str) -> str:
    """Fragment ``{r}_dd``: wealth and drawdown of ``r(keys, date, ret)``."""
    frag(f"{r}_w", f"SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS wealth FROM {r} WHERE ret IS NOT NULL")
    frag(f"{r}_dd", f"SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY {keys} ORDER BY date)) - 1 AS dd FROM {r}_w")
    return f"{r}_dd"


ABS = f"""CASE WHEN min(ret) <= -1 THEN -1 ELSE pow(product(1 + ret), 12.0 / count(*)) - 1 END AS annual_return,
 stddev_samp(ret) * sqrt(12) AS annual_volatility, {ratio('avg(ret)', 'stddev_samp(ret)')} * sqrt(12) AS sharpe,
 {ratio('avg(ret)', 'sqrt(avg(pow(least(ret, 0), 2)))')} * sqrt(12) AS sortino, min(dd) AS max_drawdown,
 CASE WHEN min(dd) <> 0 THEN (CASE WHEN min(ret) <= -1 THEN -1 ELSE pow(product(1 + ret), 12.0 / count(*)) - 1 END) / abs(min(dd)) END AS calmar"""
BETA = ratio("covar_samp(ret, bench)", "var_samp(bench)")
ACT = f"""avg(ret - bench) * 12 AS annual_active_return, stddev_samp(ret - bench) * sqrt(12) AS tracking_error,
 {ratio('avg(ret - bench)', 'stddev_samp(ret - bench)')} * sqrt(12) AS information_ratio, {BETA} AS beta,
 (avg(ret) - {BETA} * avg(bench)) * 12 AS annual_alpha"""
ABS_NAMES = "annual_return annual_volatility sharpe sortino max_drawdown calmar"
ACT_NAMES = "annual_active_return tracking_error information_ratio beta annual_alpha"


def evaluated(name: str, r: str, keys: str, extra: str = "", active: bool = True) -> str:
    """Fragment ``name``: metrics of ``r(keys, date, ret, bench)``."""
    where = "" if not active else " WHERE ret IS NOT NULL AND bench IS NOT NULL"
    frag(f"{name}_in", f"SELECT * FROM {r}{where}")
    dd = path(f"{name}_in", keys)
    return frag(name, f"SELECT {keys}, min(date) AS start_date, max(date) AS end_date, count(*) AS observations, {ABS}{', ' + ACT if active else ''}{extra} FROM {dd} GROUP BY {keys}")


ledger("pos")
frag("all_ret", "SELECT strategy, date, net_return AS ret FROM pos_led WHERE net_return IS NOT NULL UNION ALL SELECT 'benchmark', date, bench FROM br WHERE bench IS NOT NULL")
frag("common", "SELECT * FROM all_ret WHERE date IN (SELECT date FROM all_ret GROUP BY date HAVING count(DISTINCT strategy) = 4)")
frag("cb", "SELECT c.*, b.ret AS bench FROM common c LEFT JOIN (SELECT date, ret FROM common WHERE strategy = 'benchmark') b ON c.date = b.date")
evaluated("cev", "cb", "strategy")
