"""Bound queries: sources, sinks, quality, universe joins (S, Q, J)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators import capacity as K, ledger as L, quality as Q, timeseries as T, universe as U
from stratapanel.plans import bindings as B
from stratapanel.plans.oracle_base import FEATURES, frag, out, query
from stratapanel.plans.registry import register
from stratapanel.session import shared_folder
from stratapanel.sources import panels as P, sinks as K2, tables as TB

FEATS = " ".join(FEATURES)
LAST = "2001-05-31"
day = lambda text: F.lit(text).cast("date")
BARS = "open close volume"


def scratch(s, name: str) -> str:
    return f"{shared_folder(s)}/stratapanel/{uuid.uuid4().hex}/{name}"


def brands(s, d) -> DataFrame:
    """Brands plus one name the panel lacks."""
    return B.brand(s, d).select("ticker").distinct().select(
        F.explode(F.when(F.col("ticker") == "Brand#1", F.array("ticker", F.lit("Brand#99"))).otherwise(F.array("ticker"))).alias("ticker"))


frag("breq", "SELECT DISTINCT ticker FROM px_b UNION SELECT 'Brand#99'")


def nations(s, d) -> DataFrame:
    return B.market(s, d).select(F.col("canonical_ticker").alias("ticker")).distinct().select(
        F.explode(F.when(F.col("ticker") == "N1", F.array("ticker", F.lit("N99"))).otherwise(F.array("ticker"))).alias("ticker"))


frag("nreq", "SELECT DISTINCT canonical_ticker AS ticker FROM mkt UNION SELECT 'N99'")

# --- S: sources and sinks ---------------------------------------------------


def wide_prices(s, d) -> DataFrame:
    """Wide Parquet file (date x brand) written from the panel, then scanned."""
    names = [f"Brand#{i}" for i in range(1, 26)]
    path = scratch(s, "wide")
    B.brand(s, d).groupBy("date").pivot("ticker", names).agg(F.first("close")).write.parquet(path)
    return TB.load_prices(s, path)


register(
    "s1_price_scan", lambda s, d: wide_prices(s, d).where("close is not null"), out("px_b", "date ticker", "close"),
)


def benchmark_file(s, d) -> DataFrame:
    path = scratch(s, "benchmark")
    P.benchmark_days(s, d).write.parquet(path)
    return TB.load_benchmark(s, path)


register("s2_benchmark_scan", benchmark_file, out("bday", "date", "close"))
register("s3_execution_prices", lambda s, d: K.execution_prices(B.nation_days(s, d)), out("px_n", "date ticker", "close open"))
register(
    "s3_duplicate_prices",
    lambda s, d: K.execution_price_violations(B.feed(s, d).withColumnRenamed("canonical_ticker", "ticker")),
    query("SELECT date, canonical_ticker AS ticker, count(*) AS n FROM feed GROUP BY 1, 2 HAVING count(*) > 1"),
)
register(
    "s4_liquidity_grid",
    lambda s, d: K.liquidity_on_sessions(
        B.market(s, d).withColumnRenamed("canonical_ticker", "ticker"), B.region_days(s, d), nations(s, d)),
    out("""(SELECT c.date, k.ticker, m.raw_close, m.volume FROM cal_r c CROSS JOIN nreq k LEFT JOIN mkt m ON m.date = c.date AND m.canonical_ticker = k.ticker)""",
        "date ticker", "raw_close volume"),
)


def membership_file(s, d) -> DataFrame:
    path = scratch(s, "membership")
    B.membership(s, d).withColumn("company_name", F.concat(F.lit("Company "), "ticker")).withColumn(
        "industry", F.lower("sector")).select(*U.MEMBERSHIP_COLUMNS).write.option("header", True).csv(path)
    return U.load_membership_csv(s, path)


register(
    "s5_membership_csv", membership_file,
    query("SELECT index_name, ticker, 'Company ' || ticker AS company_name, sector, lower(sector) AS industry, effective_from, effective_to, source, source_date FROM mem"),
)
register(
    "s5_membership_violations",
    lambda s, d: U.membership_violations(B.membership(s, d).withColumn(
        "effective_to", F.when(F.col("ticker").cast("bigint") % 10 == 0, F.col("effective_from")).otherwise(F.col("effective_to")))),
    query("SELECT ticker, effective_from, 'inverted' AS violation FROM mem WHERE CAST(ticker AS BIGINT) % 10 = 0"),
)


def current_file(s, d) -> DataFrame:
    path = scratch(s, "current")
    P.supplier_sectors(s, d).select(
        "ticker", F.concat(F.lit("Company "), "ticker").alias("company_name"), "sector", F.lower("sector").alias("industry"),
        F.lit("current-list").alias("source"), day(LAST).alias("source_date")).write.option("header", True).csv(path)
    return U.load_current_membership_csv(s, path)


register(
    "s6_current_membership", current_file,
    query(f"SELECT ticker, 'Company ' || ticker AS company_name, sector, lower(sector) AS industry, 'current-list' AS source, DATE '{LAST}' AS source_date FROM sec_s"),
)
FIELDS = ("adjusted_close", "raw_close", "volume", "dividends", "stock_splits")


def vendor(s, d) -> DataFrame:
    """Five wide field tables; nation N0 arrives without adjusted prices."""
    names = [f"N{i}" for i in range(25)]
    panel = B.market(s, d).withColumn("adjusted_close", F.when(F.col("provider_ticker") != "N0", F.col("adjusted_close")))
    wide = {f: panel.groupBy("date").pivot("provider_ticker", names).agg(F.first(f)) for f in FIELDS}
    return K2.vendor_long(wide)


register(
    "s7_vendor_long", vendor,
    out("(SELECT * REPLACE (CASE WHEN provider_ticker = 'N0' THEN raw_close ELSE adjusted_close END AS adjusted_close) FROM mkt)",
        "date canonical_ticker provider_ticker", " ".join(FIELDS)),
)


def parquet_roundtrip(s, d) -> DataFrame:
    path = scratch(s, "ledger")
    K2.write_parquet(B.suite_ledger(s, d), path, ("strategy",))
    return s.read.parquet(path).select("strategy", "signal_date", "net_return")


register("s8_parquet_sink", parquet_roundtrip, out("pos_led", "strategy signal_date", "net_return"))


def csv_roundtrip(s, d) -> DataFrame:
    path = scratch(s, "report")
    K2.write_csv(B.suite_ledger(s, d).select("signal_date", "strategy", "net_return"), path, "strategy")
    return s.read.schema("strategy string, signal_date date, net_return double").option("header", True).csv(path)


register("s9_csv_sink", csv_roundtrip, out("pos_led", "strategy signal_date", "net_return"))


def versions(s, d) -> DataFrame:
    root = scratch(s, "versions")
    panel = B.brand(s, d).select("date", "ticker", "close")
    K2.write_version(panel.where(F.col("date") < day("2000-01-01")), root, "run_a", "2024-01-01T00:00:00")
    K2.write_version(panel, root, "run_b", "2024-02-01T00:00:00")
    return K2.read_latest(s, root).select("date", "ticker", "close", "run_id")


register("s10_latest_version", versions, out("(SELECT *, 'run_b' AS run_id FROM px_b)", "date ticker run_id", "close"))
register(
    "s11_nested_json",
    lambda s, d: K2.flatten_maps(L.nested_view(B.suite_positions(s, d))).select("strategy", "signal_date", "weights", "holdings"),
    query("""SELECT strategy, signal_date, '{' || string_agg('"' || ticker || '":' || CAST(weight AS DOUBLE), ',' ORDER BY ticker) || '}' AS weights,
      '[' || string_agg('"' || ticker || '"', ',' ORDER BY ticker) || ']' AS holdings FROM pos GROUP BY 1, 2"""),
)


def appended(s, d) -> DataFrame:
    path = scratch(s, "paper")
    rows = B.suite_ledger(s, d).select("strategy", "signal_date", F.col("date").alias("realization_date"), "net_return")
    K2.append_once(rows.where(F.col("signal_date") < day("1999-01-01")), path)
    K2.append_once(rows, path)
    return s.read.parquet(path)


register("s12_append_once", appended, out("(SELECT *, date AS realization_date FROM pos_led)", "strategy signal_date realization_date", "net_return"))
# The close in whole hundred-thousandths: text of a double differs between engines.
register(
    "s13_fingerprint", lambda s, d: U.fingerprint(B.brand(s, d).select("date", "ticker", F.floor(F.col("close") * 100000).cast("bigint").alias("close"))),
    query("""SELECT count(*) AS row_count, sha256(count(*) || ':' || CAST(coalesce(sum(h), 0) AS VARCHAR)) AS fingerprint FROM (
      SELECT CAST(('0x' || substr(sha256(concat_ws('|;', coalesce('=' || CAST(CAST(floor(close * 100000) AS BIGINT) AS VARCHAR), '~'), '=' || CAST(date AS VARCHAR), '=' || replace(ticker, '|', '||'))), 1, 15)) AS BIGINT) AS h FROM px_b)"""),
)
register(
    "s14_ledger_migration",
    lambda s, d: K2.migrate_ledger(B.suite_positions(s, d).select("strategy", "signal_date", "ticker", F.col("weight").alias("target_weight"))),
    out("(SELECT *, weight AS target_weight, 0.0 AS pretrade_weight, weight AS trade_weight FROM pos)", "strategy signal_date ticker", "target_weight pretrade_weight trade_weight"),
)

# --- Q: cleansing and quality ----------------------------------------------


def untyped(s, d) -> DataFrame:
    """Vendor text: lower-case ids, numbers as text, some unreadable."""
    text = lambda c: F.when(F.col("volume") % 31 == 0, F.lit("n/a")).otherwise(F.col(c).cast("string"))
    return B.market(s, d).select(
        F.col("date").cast("string").alias("date"), F.lower("canonical_ticker").alias("canonical_ticker"),
        F.lower("provider_ticker").alias("provider_ticker"), *[text(c).alias(c) for c in FIELDS], F.lit("x").alias("extra"))


register(
    "q1_normalize_panel", lambda s, d: Q.normalize_panel(untyped(s, d)),
    out("(SELECT date, canonical_ticker, provider_ticker, " + ", ".join(f"CASE WHEN volume % 31 <> 0 THEN {c} END AS {c}" for c in FIELDS) + " FROM mkt)",
        "date canonical_ticker provider_ticker", " ".join(FIELDS)),
)


def symbols(s, d) -> DataFrame:
    return TB.read_table(s, d, "part", "p_brand").select(
        F.concat(F.lit(" "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(".")), F.lit(" ")).alias("ticker"))


def overrides(s, d) -> DataFrame:
    return symbols(s, d).select(F.upper(F.trim("ticker")).alias("canonical_ticker")).distinct().where(
        F.col("canonical_ticker").isin("BRAND.1", "BRAND.2")).withColumn("override", F.lit("BRAND-3"))


MAPPING = lambda s, d: Q.ticker_mapping(symbols(s, d), overrides(s, d))
frag("tmap", """SELECT DISTINCT upper(replace(p_brand, '#', '.')) AS canonical_ticker, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'BRAND-3' ELSE upper(replace(p_brand, '#', '-')) END AS provider_ticker FROM part""")
register("q2_ticker_mapping", MAPPING, query("SELECT canonical_ticker, provider_ticker FROM tmap"))
register(
    "q2_mapping_collisions", lambda s, d: Q.mapping_collisions(MAPPING(s, d)),
    query("SELECT provider_ticker, count(*) AS canonicals FROM tmap GROUP BY 1 HAVING count(*) > 1"),
)
register(
    "q2_reverse_lookup",
    lambda s, d: Q.to_canonical(symbols(s, d).select(F.replace("ticker", F.lit("."), F.lit("-")).alias("provider_ticker")), MAPPING(s, d), strict=False).groupBy(
        "provider_ticker", "canonical_ticker").agg(F.count(F.lit(1)).alias("n")),
    query("""SELECT t.provider_ticker, t.canonical_ticker, count(*) AS n FROM part JOIN tmap t ON t.provider_ticker = upper(replace(p_brand, '#', '-'))
      WHERE t.provider_ticker <> 'BRAND-3' GROUP BY 1, 2"""),
)
register(
    "q2_lookup_violations",
    lambda s, d: Q.lookup_violations(symbols(s, d).select(F.replace("ticker", F.lit("."), F.lit("-")).alias("provider_ticker")), MAPPING(s, d)),
    query("""SELECT upper(replace(p_brand, '#', '-')) AS provider_ticker, count(*) AS n FROM part WHERE upper(replace(p_brand, '#', '-')) NOT IN (
      SELECT provider_ticker FROM tmap GROUP BY 1 HAVING count(*) = 1) GROUP BY 1"""),
)
FLAG = "ticker date flag severity"
dup_sql = "SELECT canonical_ticker AS ticker, date, 'DUPLICATE_DATE' AS flag, CAST(NULL AS DOUBLE) AS value, 'error' AS severity FROM feed GROUP BY 1, 2 HAVING count(*) > 1"
mono_sql = """SELECT DISTINCT canonical_ticker AS ticker, CAST(NULL AS DATE) AS date, 'NON_MONOTONIC_DATES' AS flag, CAST(NULL AS DOUBLE) AS value, 'error' AS severity
  FROM (SELECT *, lag(date) OVER (PARTITION BY canonical_ticker ORDER BY ingest_seq) AS p FROM feed) WHERE p > date"""
price_sql = " UNION ALL ".join(
    f"SELECT canonical_ticker AS ticker, date, 'INVALID_{c.upper()}' AS flag, {c} AS value, 'error' AS severity FROM feed WHERE {c} <= 0" for c in ("adjusted_close", "raw_close"))
vol_sql = "SELECT canonical_ticker AS ticker, date, 'INVALID_VOLUME' AS flag, volume AS value, 'error' AS severity FROM feed WHERE volume < 0"
jump_sql = """SELECT canonical_ticker AS ticker, date, 'EXTREME_ADJUSTED_RETURN' AS flag, CASE WHEN p <> 0 THEN adjusted_close / p - 1 END AS value, 'warning' AS severity
  FROM (SELECT *, lag(adjusted_close) OVER (PARTITION BY canonical_ticker ORDER BY date, ingest_seq) AS p FROM feed) WHERE p <> 0 AND abs(adjusted_close / p - 1) > 0.5"""
late_sql = "SELECT canonical_ticker AS ticker, date, 'FUTURE_OBSERVATION' AS flag, CAST(NULL AS DOUBLE) AS value, 'error' AS severity FROM feed WHERE date > DATE '2001-06-30'"
frag("flags_dup", dup_sql)
frag("flags_mono", mono_sql)
frag("flags_price", price_sql)
frag("flags_vol", vol_sql)
frag("flags_jump", jump_sql)
frag("flags_late", late_sql)
ROWS = lambda s, d, *names: Q.row_flags(B.feed(s, d), "2001-06-30").where(F.col("flag").isin(*names))
register("q3_duplicate_dates", lambda s, d: Q.duplicate_date_flags(B.feed(s, d)), out("flags_dup", FLAG, "value"))
register("q4_non_monotonic", lambda s, d: Q.non_monotonic_flags(B.feed(s, d)), out("flags_mono", FLAG, "value"))
register("q5_invalid_prices", lambda s, d: ROWS(s, d, "INVALID_ADJUSTED_CLOSE", "INVALID_RAW_CLOSE"), out("flags_price", FLAG, "value"))
register("q6_invalid_volume", lambda s, d: ROWS(s, d, "INVALID_VOLUME"), out("flags_vol", FLAG, "value"))
register("q7_extreme_returns", lambda s, d: ROWS(s, d, "EXTREME_ADJUSTED_RETURN"), out("flags_jump", FLAG, "value"))
register("q8_future_observations", lambda s, d: ROWS(s, d, "FUTURE_OBSERVATION"), out("flags_late", FLAG, "value"))
register(
    "q9_all_flags", lambda s, d: Q.validate_market_panel(B.feed(s, d), "2001-06-30"),
    out("(" + " UNION ALL ".join(f"SELECT * FROM flags_{x}" for x in ("dup", "mono", "price", "vol", "jump", "late")) + ")", FLAG, "value"),
)
frag("rdy", f"""SELECT k.ticker, count(m.date) AS n, max(m.date) AS latest, bool_or(m.date = DATE '{LAST}') AS cur FROM nreq k
  LEFT JOIN mkt m ON m.canonical_ticker = k.ticker AND m.date <= DATE '{LAST}' AND m.adjusted_close > 0 GROUP BY 1""")
stale = f"date_diff('day', latest, DATE '{LAST}')"
register(
    "q10_security_readiness", lambda s, d: Q.security_readiness(B.market(s, d), nations(s, d), day(LAST), 1430, 0),
    out(f"""(SELECT ticker, latest AS latest_price_date, n AS history_observations, {stale} AS staleness_days,
      nullif(concat_ws('|', CASE WHEN n = 0 THEN 'MISSING_PRICE' END, CASE WHEN n > 0 AND n < 1430 THEN 'INSUFFICIENT_HISTORY' END,
      CASE WHEN n > 0 AND {stale} > 0 THEN 'STALE_PRICE' END, CASE WHEN n > 0 AND NOT cur THEN 'CURRENT_PRICE_UNAVAILABLE' END), '') AS reason,
      n >= 1430 AND {stale} = 0 AS price_ready FROM rdy)""", "ticker price_ready latest_price_date reason", "", "history_observations staleness_days"),
)
register(
    "q11_corporate_actions", lambda s, d: Q.corporate_action_flags(B.market(s, d)),
    out("""(SELECT canonical_ticker AS ticker, date, 'REPORTED_STOCK_SPLIT' AS flag, stock_splits AS value FROM mkt WHERE stock_splits <> 0
      UNION ALL SELECT canonical_ticker, date, 'REPORTED_DIVIDEND', dividends FROM mkt WHERE dividends > 0
      UNION ALL SELECT canonical_ticker, date, 'UNEXPLAINED_ADJUSTMENT_RATIO_CHANGE', r FROM (SELECT *, lag(r) OVER (PARTITION BY canonical_ticker ORDER BY date) AS p
        FROM (SELECT *, adjusted_close / raw_close AS r FROM mkt)) WHERE abs(r / p - 1) > 0.05 AND stock_splits = 0 AND dividends <= 0)""", "ticker date flag", "value"),
)
frag("cov", """SELECT date, count(DISTINCT canonical_ticker) AS covered FROM mkt WHERE date <= DATE '2001-06-15' AND adjusted_close > 0 GROUP BY 1""")
register(
    "q12_common_date",
    lambda s, d: Q.resolve_common_date(B.market(s, d), B.market(s, d).select(F.col("canonical_ticker").alias("ticker")), "2001-06-15", 0.6),
    out("""(SELECT max(date) AS resolved_market_date, arg_max(covered / n, date) AS coverage_on_resolved_date, arg_max(covered, date) AS covered_securities, ceil(0.6 * max(n)) AS required_securities
      FROM cov CROSS JOIN (SELECT count(DISTINCT canonical_ticker) AS n FROM mkt) WHERE covered / n >= 0.6)""", "resolved_market_date", "coverage_on_resolved_date", "covered_securities required_securities"),
)
register(
    "q13_acquisition_status",
    lambda s, d: Q.acquisition_status(B.market(s, d), nations(s, d).select(F.col("ticker").alias("canonical_ticker"), F.col("ticker").alias("provider_ticker")), day("2001-09-15")),
    out("""(SELECT k.ticker AS canonical_ticker, k.ticker AS provider_ticker, min(m.date) AS first_available_date, max(m.date) AS last_available_date, count(m.adjusted_close) AS observation_count,
      1 - count(m.adjusted_close) / (SELECT count(DISTINCT date) FROM mkt) AS missing_ratio,
      CASE WHEN count(m.adjusted_close) = 0 THEN 'failed' WHEN max(m.date) < DATE '2001-09-15' THEN 'partial' ELSE 'successful' END AS status
      FROM nreq k LEFT JOIN mkt m ON m.canonical_ticker = k.ticker GROUP BY 1)""",
        "canonical_ticker provider_ticker first_available_date last_available_date status", "missing_ratio", "observation_count"),
)


def merged(s, d):
    rows = P.event_panel(s, d)  # two interleaved deliveries that together hold every row
    return Q.merge_incremental(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


register(
    "q14_merge_incremental", merged,
    out("(SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY version DESC) AS r FROM ev)", "date ticker", "value", "version", where="r = 1"),
)


def gaps(s, d):
    rows = P.event_panel(s, d)
    cached = rows.where(F.col("date") < day("2024-01-02"))  # users unseen on the first day are missing
    return Q.load_gaps(rows.select("ticker").distinct(), cached, "2023-12-25", "2024-01-31", "2024-01-01", "2024-01-01")


frag("cach", "SELECT ticker, max(date) AS mx FROM ev WHERE date < DATE '2024-01-02' GROUP BY 1")
register(
    "q15_load_gaps", gaps,
    query("""SELECT DISTINCT ticker, 'never_loaded' AS gap, DATE '2023-12-25' AS fetch_from, DATE '2024-01-31' AS fetch_to FROM ev WHERE ticker NOT IN (SELECT ticker FROM cach)
      UNION ALL SELECT ticker, 'earlier_prefix', DATE '2023-12-25', DATE '2023-12-31' FROM cach
      UNION ALL SELECT ticker, 'extension', CAST((SELECT min(mx) FROM cach) + INTERVAL 1 DAY AS DATE), DATE '2024-01-31' FROM cach"""),
)
register(
    "q16_price_contract",
    lambda s, d: Q.price_violations(B.feed(s, d).select("date", F.col("canonical_ticker").alias("ticker"), F.col("adjusted_close").alias("close"))),
    query("""SELECT date, canonical_ticker AS ticker, 'duplicate' AS violation FROM feed GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT date, canonical_ticker, 'non_positive' FROM feed WHERE adjusted_close <= 0"""),
)
register(
    "q17_score_contract",
    lambda s, d: Q.score_violations(P.event_panel(s, d).select("date", "ticker", F.col("value").alias("ml_score"), F.col("value").alias("future_return"))),
    query("SELECT date, ticker, count(*) AS n FROM ev GROUP BY 1, 2 HAVING count(*) > 1"),
)
CUT = "2000-06-15"
register(
    "q18_snapshot", lambda s, d: Q.snapshot(B.closes(B.brand(s, d)), B.benchmark(s, d), CUT),
    out("px_b", "date ticker", "close", where=f"date <= least((SELECT max(date) FROM px_b WHERE date <= DATE '{CUT}'), (SELECT max(date) FROM bm WHERE date <= DATE '{CUT}'))"),
)
register(
    "q19_future_rows", lambda s, d: Q.future_rows(B.closes(B.brand(s, d)), day(CUT)), out("px_b", "date ticker", "close", where=f"date > DATE '{CUT}'"),
)
ELIGIBLE = lambda s, d: Q.snapshot_eligibility(brands(s, d), B.brand(s, d).where(F.col("date") <= day(LAST)), day(LAST))
DAYEND = "2001-10-20"
frag("elig", f"""SELECT k.ticker, true AS requested, max(p.date) AS latest_price_date, date_diff('day', max(p.date), DATE '{DAYEND}') AS staleness_days,
  CASE WHEN max(p.date) IS NULL THEN 'missing_ticker' WHEN date_diff('day', max(p.date), DATE '{DAYEND}') > 7 THEN 'stale_price' END AS reason
  FROM nreq k LEFT JOIN px_n p ON p.ticker = k.ticker AND p.date <= DATE '{DAYEND}' GROUP BY 1""")
register(
    "q20_snapshot_eligibility",
    lambda s, d: Q.snapshot_eligibility(nations(s, d), B.nation_days(s, d).where(F.col("date") <= day(DAYEND)), day(DAYEND)),
    out("(SELECT *, reason IS NULL AS eligible, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'ineligible' END AS status FROM elig)",
        "ticker requested eligible latest_price_date status reason", "", "staleness_days"),
)
SCREEN = lambda s, d: Q.screen_investability(
    B.membership(s, d).select("ticker"), B.supplier(s, d), B.supplier_dataset(s, d).where(F.col("date") == day(LAST)), day(LAST), 72, 7)
frag("scr0", f"""SELECT k.ticker, count(p.close) AS n, max(p.date) AS latest, max(CASE WHEN f.ticker IS NOT NULL THEN 1 ELSE 0 END) = 1 AS feature_ready FROM mem k
  LEFT JOIN px_s p ON p.ticker = k.ticker AND p.date <= DATE '{LAST}' LEFT JOIN ds_s f ON f.ticker = k.ticker AND f.date = DATE '{LAST}' GROUP BY 1""")
frag("scr", f"""SELECT ticker, true AS index_member, latest AS latest_price_date, n AS history_observations, {stale} AS staleness_days, feature_ready,
  nullif(concat_ws('|', CASE WHEN n = 0 THEN 'HAS_PRICE_HISTORY|MISSING_PRICE' END, CASE WHEN n > 0 AND n < 72 THEN 'SUFFICIENT_HISTORY|INSUFFICIENT_LOOKBACK' END,
  CASE WHEN n > 0 AND {stale} > 7 THEN 'CURRENT_PRICE_AVAILABLE|STALE_PRICE' END, CASE WHEN NOT feature_ready THEN 'FEATURES_AVAILABLE' END), '') AS reason FROM scr0""")
register(
    "q21_investability", SCREEN,
    out("(SELECT *, reason IS NULL AS eligible FROM scr)", "ticker index_member eligible latest_price_date feature_ready reason", "", "history_observations staleness_days"),
)
register(
    "q22_latest_features", lambda s, d: Q.latest_features(T.feature_panel(B.closes(B.supplier(s, d))), day("2000-12-15")),
    out("(SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM feat_s WHERE close IS NOT NULL AND date <= DATE '2000-12-15')", "ticker date", FEATS, where="r = 1"),
)
register(
    "q23_current_features", lambda s, d: Q.current_features(brands(s, d), B.brand_dataset(s, d), ELIGIBLE(s, d)),
    out(f"""(SELECT k.ticker, (SELECT max(date) FROM ds_b) AS signal_date, {', '.join('f.' + c for c in FEATURES)}, f.ticker IS NOT NULL AND p.ticker IS NOT NULL AS feature_valid,
      CASE WHEN f.ticker IS NULL OR p.ticker IS NULL THEN CASE WHEN p.ticker IS NULL THEN 'missing_ticker' ELSE 'insufficient_or_missing_feature_history' END END AS invalid_reason
      FROM breq k LEFT JOIN ds_b f ON f.ticker = k.ticker AND f.date = (SELECT max(date) FROM ds_b) LEFT JOIN (SELECT DISTINCT ticker FROM px_b WHERE date = DATE '{LAST}') p ON p.ticker = k.ticker)""",
        "ticker signal_date feature_valid invalid_reason", FEATS),
)
frag("fm", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS valid_count, count(*) - count({c}) AS missing_count, count({c}) / count(*) AS coverage_pct FROM fm0" for c in FEATURES))
frag("fm0", f"SELECT k.ticker, {', '.join('f.' + c for c in FEATURES)} FROM mem k LEFT JOIN feat_s f ON f.ticker = k.ticker AND f.close IS NOT NULL AND f.date = DATE '1995-11-30'")
register(
    "q24_feature_missingness",
    lambda s, d: Q.feature_missingness(T.feature_panel(B.closes(B.supplier(s, d))), B.membership(s, d), day("1995-11-30")),
    out("fm", "feature", "coverage_pct", "valid_count missing_count"),
)
frag("cmp", "SELECT date, count(DISTINCT ticker) AS c FROM ds_s GROUP BY 1")
COVER = "universe_members eligible_members feature_complete feature_missing prediction_eligible"
register(
    "q25_feature_coverage", lambda s, d: Q.feature_coverage(B.supplier_dataset(s, d), B.membership(s, d), B.supplier(s, d)),
    out("""(SELECT a.date, (SELECT count(*) FROM mem) AS universe_members, a.n AS eligible_members, coalesce(c.c, 0) AS feature_complete, greatest(0, a.n - coalesce(c.c, 0)) AS feature_missing,
      coalesce(c.c, 0) AS prediction_eligible FROM (SELECT date, count(*) AS n FROM px_s GROUP BY 1) a LEFT JOIN cmp c ON c.date = a.date)""", "date", "", COVER),
)
register(
    "q26_ticker_coverage", lambda s, d: Q.ticker_feature_diagnostics(B.supplier_dataset(s, d), B.membership(s, d), B.supplier(s, d)),
    out("""(SELECT k.ticker, coalesce(p.n, 0) AS price_observations, coalesce(f.n, 0) AS feature_complete_rows,
      greatest(0, (SELECT count(DISTINCT date) FROM ds_s) - coalesce(f.n, 0)) AS missing_feature_rows_vs_panel FROM mem k
      LEFT JOIN (SELECT ticker, count(close) AS n FROM px_s GROUP BY 1) p ON p.ticker = k.ticker LEFT JOIN (SELECT ticker, count(*) AS n FROM ds_s GROUP BY 1) f ON f.ticker = k.ticker)""",
        "ticker", "", "price_observations feature_complete_rows missing_feature_rows_vs_panel"),
)
register(
    "q27_point_in_time_coverage", lambda s, d: Q.point_in_time_coverage(B.supplier_dataset(s, d), B.membership(s, d), B.supplier(s, d)),
    out("""(SELECT c.date, count(DISTINCT m.ticker) AS universe_members, count(p.close) AS eligible_members, coalesce(max(k.c), 0) AS feature_complete,
      greatest(0, count(p.close) - coalesce(max(k.c), 0)) AS feature_missing, coalesce(max(k.c), 0) AS prediction_eligible FROM cal_s c
      JOIN mem m ON m.effective_from <= c.date AND (m.effective_to IS NULL OR m.effective_to > c.date) LEFT JOIN px_s p ON p.date = c.date AND p.ticker = m.ticker
      LEFT JOIN cmp k ON k.date = c.date GROUP BY 1)""", "date", "", COVER),
)
register(
    "q28_dataset_summary", lambda s, d: Q.dataset_summary(B.supplier_dataset(s, d), B.supplier_scores(s, d)),
    out("""(SELECT sum(n) AS total_rows, min(date) AS start_date, max(date) AS end_date, avg(n) AS average_rows_per_date, min(n) AS minimum_rows_per_date, max(n) AS maximum_rows_per_date,
      (SELECT count(DISTINCT ticker) FROM ds_s) AS number_of_securities, (SELECT avg(target) FROM ds_s) AS positive_target_fraction, 0.0 AS missing_feature_rate,
      (SELECT count(*) FROM sc_s) AS prediction_rows, (SELECT count(DISTINCT date) FROM sc_s) AS prediction_dates FROM (SELECT date, count(*) AS n FROM ds_s GROUP BY 1))""",
        "start_date end_date", "average_rows_per_date positive_target_fraction missing_feature_rate",
        "total_rows minimum_rows_per_date maximum_rows_per_date number_of_securities prediction_rows prediction_dates"),
)
register(
    "q29_readiness_funnel",
    lambda s, d: Q.readiness_funnel(SCREEN(s, d), B.supplier_scores(s, d).where(F.col("date") == day(LAST))),
    out(f"""(SELECT *, prediction_ready / universe_members AS coverage_pct FROM (SELECT count(*) AS universe_members, count(*) FILTER (coalesce(replace(reason, 'FEATURES_AVAILABLE', ''), '') = '') AS price_ready,
      count(*) FILTER (coalesce(replace(reason, 'FEATURES_AVAILABLE', ''), '') = '' AND feature_ready) AS feature_ready, count(reason) AS rejected FROM scr)
      CROSS JOIN (SELECT count(*) AS prediction_ready FROM sc_s WHERE date = DATE '{LAST}'))""", "", "coverage_pct", "universe_members price_ready feature_ready rejected prediction_ready"),
)

# --- J: universe and calendar joins ----------------------------------------
active = "effective_from <= {0} AND (effective_to IS NULL OR effective_to > {0})"
register(
    "j1_interval_join", lambda s, d: U.interval_join(B.closes(B.supplier(s, d)), B.membership(s, d), "sector"),
    out(f"(SELECT p.date, p.ticker, p.close, m.sector FROM px_s p JOIN mem m ON m.ticker = p.ticker AND {active.format('p.date')})", "date ticker sector", "close"),
)
frag("memx", "SELECT ticker, effective_from, effective_to FROM mem UNION ALL SELECT ticker, CAST(effective_to - INTERVAL 1 MONTH AS DATE), NULL FROM mem WHERE effective_to IS NOT NULL")


def overlapping(s, d):
    m = B.membership(s, d).select("ticker", "effective_from", "effective_to")
    again = m.where("effective_to is not null").select("ticker", F.add_months("effective_to", -1).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return U.overlap_violations(B.closes(B.supplier(s, d)), m.unionByName(again))


register(
    "j1_overlap_violations", overlapping,
    query(f"SELECT p.date, p.ticker, count(*) AS n FROM px_s p JOIN memx m ON m.ticker = p.ticker AND {active.format('p.date')} GROUP BY 1, 2 HAVING count(*) > 1"),
)
register(
    "j2_members_at", lambda s, d: U.point_in_time_members(B.membership(s, d), "1999-03-31").select("ticker", "sector", "verified"),
    query(f"SELECT ticker, sector, true AS verified FROM mem WHERE " + active.format("DATE '1999-03-31'")),
)
ASKED = ("1990-01-31", "1996-01-31", "1999-03-31")
register(
    "j3_snapshot_decision", lambda s, d: U.snapshot_decision(B.membership(s, d), list(ASKED)),
    out("""(SELECT r.requested_date, count(m.ticker) > 0 AS verified, count(DISTINCT m.ticker) AS members, string_agg(DISTINCT m.source, ';' ORDER BY m.source) AS source, max(m.source_date) AS latest_source_date
      FROM (SELECT unnest([DATE '1990-01-31', DATE '1996-01-31', DATE '1999-03-31']) AS requested_date) r LEFT JOIN mem m ON """ + active.format("r.requested_date") + " GROUP BY 1)",
        "requested_date verified source latest_source_date", "", "members"),
)
register(
    "j4_benchmark_map",
    lambda s, d: T.simple_returns(B.closes(B.supplier(s, d))).select("date", "ticker", "ret").join(F.broadcast(B.bench(s, d)), "date", "left"),
    out("(SELECT g.date, g.ticker, g.momentum_1m AS ret, b.bench FROM lag_s g LEFT JOIN br b ON b.date = g.date WHERE g.close IS NOT NULL)", "date ticker", "ret bench"),
)
register(
    "j5_calendar_agreement",
    lambda s, d: T.calendar_violations(B.nation_days(s, d), P.benchmark_days(s, d)),
    query("""SELECT coalesce(a.ticker, k.ticker) AS ticker, a.d AS panel_date, k.d AS benchmark_date FROM (SELECT ticker, date_trunc('month', date) AS m, max(date) AS d FROM px_n WHERE close IS NOT NULL GROUP BY 1, 2) a
      FULL OUTER JOIN (SELECT t.ticker, b.m, b.d FROM tick_n t CROSS JOIN (SELECT date_trunc('month', date) AS m, max(date) AS d FROM bday GROUP BY 1) b) k ON a.m = k.m AND a.ticker = k.ticker
      WHERE a.d IS DISTINCT FROM k.d"""),
)
register(
    "j8_next_session",
    lambda s, d: U.next_session(B.benchmark(s, d).select("date"), B.nation_days(s, d)),
    query("SELECT b.date, (SELECT min(date) FROM px_n p WHERE p.date > b.date) AS next_session FROM bm b"),
)
CUTS = ("1998-06-30", "1999-06-30", "2000-06-30", "2001-05-31")
cuts = ", ".join(f"DATE '{c}'" for c in CUTS)
register(
    "j10_embargo", lambda s, d: U.embargoed_training(B.supplier_dataset(s, d), list(CUTS)).select("cutoff", "date", "ticker", "target_date", "target"),
    out(f"(SELECT c.cutoff, f.* FROM ds_s f JOIN (SELECT unnest([{cuts}]) AS cutoff) c ON f.target_date < c.cutoff WHERE f.target IS NOT NULL)", "cutoff date ticker target_date", "", "target"),
)
register(
    "j11_sector_join", lambda s, d: U.with_sector(B.brand_scores(s, d), P.brand_sectors(s, d).where("sector <> 'ASIA'")).select("date", "ticker", "sector"),
    query("SELECT c.date, c.ticker, coalesce(s.sector, 'Unknown') AS sector FROM sc_b c LEFT JOIN (SELECT * FROM sec_b WHERE sector <> 'ASIA') s ON s.ticker = c.ticker"),
)
register(
    "j11_dated_sector", lambda s, d: U.with_dated_sector(B.supplier_scores(s, d), B.membership(s, d)).select("date", "ticker", "sector"),
    query(f"SELECT c.date, c.ticker, coalesce(m.sector, 'Unknown') AS sector FROM sc_s c JOIN mem m ON m.ticker = c.ticker AND {active.format('c.date')}"),
)
register(
    "j15_replay", lambda s, d: U.replay_snapshots(B.nation_days(s, d), "1999-01-01", "2000-12-31"),
    out("""(SELECT a.as_of, count(DISTINCT p.date) AS sessions, count(*) AS rows_visible, count(DISTINCT p.ticker) AS securities_seen FROM (SELECT max(date) AS as_of FROM px_n GROUP BY date_trunc('month', date)) a
      JOIN px_n p ON p.date <= a.as_of WHERE a.as_of BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1)""", "as_of", "", "sessions rows_visible securities_seen"),
)
register(
    "j17_semi_join", lambda s, d: U.restrict(B.closes(B.supplier(s, d)), U.members_at(B.membership(s, d), "1999-03-31"), "ticker"),
    out("px_s", "date ticker", "close", where="ticker IN (SELECT ticker FROM mem WHERE " + active.format("DATE '1999-03-31'") + ")"),
)
register(
    "j18_anti_join", lambda s, d: U.exclude(nations(s, d), B.nation_days(s, d).where(F.col("date") == day(DAYEND)), "ticker"),
    query(f"SELECT ticker FROM nreq WHERE ticker NOT IN (SELECT ticker FROM px_n WHERE date = DATE '{DAYEND}')"),
)
register(
    "u4_keep_first", lambda s, d: Q.keep_first(P.event_panel(s, d), ("ticker", "date"), "version"),
    out("(SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY version) AS r FROM ev)", "date ticker", "value", "version", where="r = 1"),
)

# --- M1, M2: training accounting -------------------------------------------
register(
    "m1_training_rows", lambda s, d: U.training_counts(B.supplier_dataset(s, d)),
    out("""(SELECT p.date AS prediction_date, (SELECT count(*) FROM ds_s f WHERE f.target IS NOT NULL AND f.target_date < p.date) AS training_rows, p.n AS prediction_rows
      FROM (SELECT date, count(*) AS n FROM ds_s GROUP BY 1) p)""", "prediction_date", "", "training_rows prediction_rows"),
)
register(
    "m2_cutoff_eligibility", lambda s, d: U.cutoff_eligibility(B.supplier_dataset(s, d), 36),
    out("""(SELECT *, train_months >= 36 AND classes = 2 AS eligible FROM (SELECT p.date AS prediction_date, p.n AS prediction_rows, count(DISTINCT f.date) AS train_months, count(f.ticker) AS training_rows,
      count(DISTINCT f.target) AS classes FROM (SELECT date, count(*) AS n FROM ds_s GROUP BY 1) p LEFT JOIN ds_s f ON f.target IS NOT NULL AND f.target_date < p.date GROUP BY 1, 2))""",
        "prediction_date eligible", "", "prediction_rows train_months training_rows"),
)
