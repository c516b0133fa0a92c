import datetime as dt

import numpy as np
import pytest
from conftest import month_ends
from pyspark.sql import functions as F

from stratapanel.operators import capacity as K, crosssection as C, live as V, quality as Q, universe as U
from stratapanel.session import shared_folder
from stratapanel.sources import sinks, tables
from stratapanel.streaming.merge import compact, read_merged, start_merge

D = dt.date


@pytest.fixture(scope="module")
def market(spark):
    def build(rows):
        full = [(d, t, t, adj, raw, vol, 0.0, 0.0, i) for i, (d, t, adj, raw, vol) in enumerate(rows)]
        return spark.createDataFrame(
            full, "date date, canonical_ticker string, provider_ticker string, adjusted_close double, raw_close double,"
            " volume double, dividends double, stock_splits double, ingest_seq bigint")
    return build


def test_all_flag_kinds(market):
    rows = [(D(2024, 1, 4), "A", 10.0, 10.0, 1.0), (D(2024, 1, 3), "A", 0.0, 10.0, 1.0), (D(2024, 1, 2), "A", 10.0, -1.0, 1.0),
            (D(2024, 1, 2), "A", 10.0, 10.0, -5.0)]
    kinds = {r["flag"] for r in Q.validate_market_panel(market(rows), "2024-01-03").collect()}
    assert kinds == {"DUPLICATE_DATE", "NON_MONOTONIC_DATES", "INVALID_ADJUSTED_CLOSE", "INVALID_RAW_CLOSE", "INVALID_VOLUME",
                     "EXTREME_ADJUSTED_RETURN", "FUTURE_OBSERVATION"}


def test_readiness(market, spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    rows = [(d, "OK", 1.0, 1.0, 1.0) for d in days] + [(days[-1], "SHORT", 1.0, 1.0, 1.0)] + [(d, "STALE", 1.0, 1.0, 1.0) for d in days[:5]]
    names = spark.createDataFrame([("OK",), ("SHORT",), ("STALE",), ("MISSING",)], "ticker string")
    out = {r["ticker"]: r["reason"] for r in Q.security_readiness(market(rows), names, F.lit(D(2024, 1, 10)), 5).collect()}
    assert out == {"OK": None, "SHORT": "INSUFFICIENT_HISTORY", "STALE": "STALE_PRICE|CURRENT_PRICE_UNAVAILABLE", "MISSING": "MISSING_PRICE"}


def test_common_date_ignores_isolated_row(market, spark):
    rows = [(D(2024, 1, d), t, 1.0, 1.0, 1.0) for d in (4, 5) for t in "ABCD"] + [(D(2024, 1, 8), "A", 1.0, 1.0, 1.0)]
    names = spark.createDataFrame([(t,) for t in "ABCD"], "ticker string")
    r = Q.resolve_common_date(market(rows), names, "2024-01-31").collect()[0]
    assert (r["resolved_market_date"], r["covered_securities"], r["required_securities"]) == (D(2024, 1, 5), 4, 4)
    assert Q.resolve_common_date(market(rows[-1:]), names, "2024-01-31").count() == 0


def test_merge_keeps_last(spark):
    schema = "date date, ticker string, value double, version bigint"
    old = spark.createDataFrame([(D(2024, 1, i), "A", 1.0, i) for i in range(1, 6)], schema)
    new = spark.createDataFrame([(D(2024, 1, i), "A", 2.0, 10 + i) for i in range(4, 7)], schema)
    out = {r["date"].day: r["value"] for r in Q.merge_incremental(old, new).collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 1.0, 4: 2.0, 5: 2.0, 6: 2.0}


def test_ticker_mapping(spark):
    names = spark.createDataFrame([(" brk.b",), ("BF.B",), ("ABC-D",)], "ticker string")
    out = {r[0]: r[1] for r in Q.ticker_mapping(names).collect()}
    assert out == {"BRK.B": "BRK-B", "BF.B": "BF-B", "ABC-D": "ABC-D"}
    assert Q.mapping_collisions(Q.ticker_mapping(spark.createDataFrame([("A.B",), ("A-B",)], "ticker string"))).count() == 1


def test_contracts_raise(spark, panel):
    with pytest.raises(ValueError, match="Missing columns"):
        Q.require_columns(panel({"A": [1]}), "volume")
    with pytest.raises(ValueError):
        Q.require(Q.price_violations(panel({"A": [1, -1]})), "bad prices")
    with pytest.raises(ValueError):
        Q.assert_no_label_columns(spark.createDataFrame([(1,)], "target int"))


@pytest.fixture(scope="module")
def membership(spark):
    return spark.createDataFrame(
        [("I", "OLD", "s", D(2019, 1, 1), D(2020, 1, 1), "a", D(2019, 1, 1)), ("I", "NEW", "s", D(2020, 1, 1), None, "b", D(2020, 1, 1))],
        "index_name string, ticker string, sector string, effective_from date, effective_to date, source string, source_date date")


def test_half_open_intervals(spark, membership):
    rows = spark.createDataFrame([(d, t) for d in (D(2019, 12, 31), D(2020, 1, 1)) for t in ("OLD", "NEW")], "date date, ticker string")
    assert sorted(tuple(r) for r in U.interval_join(rows, membership).select("date", "ticker").collect()) == [
        (D(2019, 12, 31), "OLD"), (D(2020, 1, 1), "NEW")]
    with pytest.raises(ValueError, match="POINT_IN_TIME"):
        U.point_in_time_members(membership, "2010-01-01", required=True)
    current = membership.select("ticker", "source_date")
    with pytest.raises(ValueError, match="cannot represent"):
        U.point_in_time_members(membership.where("ticker = 'NEW'"), "2019-06-30", current)


def test_next_session(spark, panel):
    sessions = panel({"A": [1, 2]}, [D(2024, 3, 28), D(2024, 4, 1)])
    asked = spark.createDataFrame([(D(2024, 3, 29),), (D(2024, 3, 28),), (D(2024, 4, 1),)], "date date")
    assert {r[0]: r[1] for r in U.next_session(asked, sessions).collect()} == {
        D(2024, 3, 29): D(2024, 4, 1), D(2024, 3, 28): D(2024, 4, 1), D(2024, 4, 1): None}


def test_trade_diagnostics(spark):
    moves = spark.createDataFrame([("A", 0.5, 0.8, 1e6), ("B", 0.0, 0.2, 2e6), ("C", 0.5, 0.0, 1e6), ("D", 0.5, 0.5 + 1e-16, None)],
                                  "ticker string, target_weight double, pretrade_weight double, adv double")
    out = {r["ticker"]: r for r in K.trade_diagnostics(moves, F.lit(100_000.0), F.col("adv")).collect()}
    assert [out[t]["trade_dollars"] for t in "ABC"] == pytest.approx([-30_000, -20_000, 50_000])
    assert [out[t]["trade_as_pct_adv"] for t in "ABC"] == pytest.approx([0.03, 0.01, 0.05])
    assert out["A"]["estimated_cost_dollars"] == pytest.approx(30_000 * (5 + 10 * np.sqrt(3)) / 10_000)
    assert out["D"]["trade_weight"] == 0 and out["D"]["estimated_cost_dollars"] == 0
    with pytest.raises(Exception, match="INVALID_ADV"):
        K.trade_diagnostics(moves.withColumn("adv", F.lit(0.0)), F.lit(1e5), F.col("adv")).collect()
    with pytest.raises(ValueError):
        K.ExecutionConfig(limits=(0.5, 2.0))


def test_noncontiguous_schedule(spark):
    d = month_ends(4)
    rows = [(d[0], d[1], None), (d[2], d[3], None)]
    s = spark.createDataFrame(rows, "signal_date date, realization_date date, reason string")
    assert K.schedule_violations(s).count() == 1


def test_rank_ic(spark):
    d = month_ends(3)
    rows = [(x, t, s, r, 1) for x in d for t, s, r in (("A", 0.9, 0.1), ("B", 0.1, 0.0))]
    scores = spark.createDataFrame(rows, "date date, ticker string, ml_score double, future_return double, target int")
    out = C.ranking_timeseries(scores, 1, 2).orderBy("date").collect()
    assert [r["rank_ic"] for r in out] == pytest.approx([1, 1, 1])
    assert [r["rolling_mean_rank_ic"] for r in out] == [None, pytest.approx(1), pytest.approx(1)]
    flat = scores.withColumn("future_return", F.lit(0.0))
    assert all(r["rank_ic"] is None for r in C.rank_ic(flat).collect())
    with pytest.raises(Exception, match="Partially missing"):
        C.ranking_summary(scores.withColumn("target", F.when(F.col("ticker") == "A", 1)), 1).collect()


def test_rank_ic_matches_average_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [("d", f"t{i}", float(round(x, 1)), float(y)) for i, (x, y) in enumerate(zip(rng.normal(size=150), rng.normal(size=150)))]
    scores = spark.createDataFrame(rows, "date string, ticker string, ml_score double, future_return double")
    a = C.rank_ic(scores).collect()[0]["rank_ic"]
    import pandas as pd

    assert a == pytest.approx(pd.Series([r[2] for r in rows]).rank().corr(pd.Series([r[3] for r in rows]).rank()))


def test_sector_weights_sum_to_one(spark):
    rows = [("d", f"t{i}", float(i)) for i in range(10)]
    meta = spark.createDataFrame([(f"t{i}", "X" if i % 2 else "") for i in range(9)], "ticker string, sector string")
    scores = spark.createDataFrame(rows, "date string, ticker string, ml_score double")
    out = C.sector_exposure(U.with_sector(scores, meta), 4).collect()
    assert sum(r["topn_weight"] for r in out) == pytest.approx(1) and "Unknown" in {r["sector"] for r in out}
    assert sum(r["active_sector_weight"] for r in out) == pytest.approx(0)


def test_paper_trades(spark):
    t = spark.createDataFrame([("s", "A", 0.5), ("s", "C", 0.5)], "strategy string, ticker string, target_weight double")
    p = spark.createDataFrame([("s", "A", 0.8), ("s", "B", 0.2)], "strategy string, ticker string, pretrade_weight double")
    cost = spark.createDataFrame([("s", 0.002)], "strategy string, estimated_transaction_cost double")
    out = {r["ticker"]: r for r in V.trade_ledger(t, p, cost).collect()}
    assert [out[x]["trade_weight"] for x in "ABC"] == pytest.approx([-0.3, -0.2, 0.5])
    assert sum(r["estimated_transaction_cost"] for r in out.values()) == pytest.approx(0.002)


def test_frozen_evaluation(spark, panel):
    p = panel({"A": [100, 110], "B": [100, 80]})
    d = month_ends(2)
    book = spark.createDataFrame([("s", d[0], "A", 0.75, 0.0), ("s", d[0], "B", 0.25, 0.0)],
                                 "strategy string, signal_date date, ticker string, target_weight double, estimated_cost double")
    due = spark.createDataFrame([(d[0], d[1])], "signal_date date, realization_date date")
    bench = p.where("ticker = 'A'").select("date", "close")
    r = V.frozen_evaluation(book, p, bench, due).collect()[0]
    assert r["gross_return"] == pytest.approx(0.025) and r["benchmark_return"] == pytest.approx(0.1)
    w = {x["ticker"]: x["pretrade_weight"] for x in V.pretrade_weights(book, p, F.lit(d[1])).collect()}
    assert w["A"] == pytest.approx(0.825 / 1.025)


def test_wide_price_file_is_unpivoted(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.createDataFrame([(D(2024, 1, 1), 1.0, float("nan"))], "date date, A double, B double").write.parquet(path)
    assert sorted(tuple(r) for r in tables.load_prices(spark, path).collect()) == [(D(2024, 1, 1), "A", 1.0), (D(2024, 1, 1), "B", None)]


def test_vendor_fallback_to_raw(spark):
    d = D(2024, 1, 1)
    wide = lambda a, b: spark.createDataFrame([(d, a, b)], "date date, A double, B double")
    out = {r["provider_ticker"]: r for r in sinks.vendor_long({"adjusted_close": wide(1.0, None), "raw_close": wide(2.0, 3.0)}).collect()}
    assert out["A"]["adjusted_close"] == 1.0 and out["B"]["adjusted_close"] == 3.0 and out["B"]["dividends"] == 0.0


def test_append_once_and_versions(spark, tmp_path):
    d = month_ends(2)
    row = spark.createDataFrame([("s", d[0], d[1], 0.1)], "strategy string, signal_date date, realization_date date, net_return double")
    path = str(tmp_path / "ledger")
    sinks.append_once(row, path)
    sinks.append_once(row, path)
    assert spark.read.parquet(path).count() == 1
    root = str(tmp_path / "v")
    sinks.write_version(row, root, "a", "2024-01-02")
    sinks.write_version(row.withColumn("net_return", F.lit(9.0)), root, "b", "2024-01-01")
    assert sinks.read_latest(spark, root).collect()[0]["net_return"] == 0.1


def test_fingerprint_ignores_order(panel):
    p = panel({"A": [1, 2], "B": [3, 4]})
    a, b = U.fingerprint(p).collect()[0], U.fingerprint(p.orderBy(F.desc("close")).repartition(3)).collect()[0]
    assert a == b and a != U.fingerprint(p.where("close > 1")).collect()[0]


def test_stream_merge_is_exactly_once(spark, tmp_path):
    schema = "date date, ticker string, value double, version bigint"
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    d = D(2024, 1, 1)
    for batch in ([(d, "A", 1.0, 1), (d, "A", 2.0, 3)], [(d, "A", 9.0, 2), (d, "B", 5.0, 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        start_merge(spark.readStream.schema(schema).parquet(source), root).awaitTermination()
    want = {("A", 2.0), ("B", 5.0)}
    assert {(r["ticker"], r["value"]) for r in read_merged(spark, root).collect()} == want
    compact(spark, root, str(tmp_path / "compact"))
    assert {(r["ticker"], r["value"]) for r in read_merged(spark, str(tmp_path / "compact")).collect()} == want


def test_streaming_merge_touches_its_months_only_and_expires_old_keys(spark, tmp_path):
    schema = "date date, ticker string, value double, version long"
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    files = lambda month: sorted((tmp_path / "root" / "table" / f"month={month}").glob("*.parquet"))

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        start_merge(spark.readStream.schema(schema).parquet(source), root, expiry="60 days").awaitTermination()
        return {(r["ticker"], r["date"], r["value"]) for r in read_merged(spark, root).collect()}

    batch([(D(2024, 1, 5), "A", 1.0, 1), (D(2024, 2, 5), "A", 2.0, 1)])
    old = files("2024-01-01")
    got = batch([(D(2024, 2, 5), "A", 3.0, 2), (D(2024, 2, 6), "B", 4.0, 1)])
    assert got == {("A", D(2024, 1, 5), 1.0), ("A", D(2024, 2, 5), 3.0), ("B", D(2024, 2, 6), 4.0)}
    assert files("2024-01-01") == old
    # A late version inside the expiry is compared with the state of earlier batches.
    got = batch([(D(2024, 2, 5), "A", 9.0, 1), (D(2024, 9, 5), "A", 5.0, 1)])
    assert ("A", D(2024, 2, 5), 3.0) in got and ("A", D(2024, 9, 5), 5.0) in got
    # The next batch sees the watermark of the one before: a key that old is closed.
    got = batch([(D(2024, 1, 5), "A", 7.0, 9), (D(2024, 9, 6), "B", 6.0, 1)])
    assert ("A", D(2024, 1, 5), 1.0) in got and ("B", D(2024, 9, 6), 6.0) in got
    # A new checkpoint replays every file onto the same table.
    import shutil

    shutil.copytree(root + "/table", str(tmp_path / "again" / "table"))
    start_merge(spark.readStream.schema(schema).parquet(source), str(tmp_path / "again")).awaitTermination()
    rows = {(r["ticker"], r["date"], r["value"]) for r in read_merged(spark, str(tmp_path / "again")).collect()}
    assert ("A", D(2024, 1, 5), 7.0) in rows and ("A", D(2024, 2, 5), 3.0) in rows and len(rows) == 5


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_overlapping_membership_fails_the_join(spark):
    import datetime as dt

    from stratapanel.operators import universe as U

    d = dt.date
    rows = spark.createDataFrame([(d(2020, 5, 31), "A")], "date date, ticker string")
    spans = lambda end: spark.createDataFrame([("A", d(2020, 1, 1), end), ("A", d(2020, 4, 1), None)], "ticker string, effective_from date, effective_to date")
    assert U.interval_join(rows, spans(d(2020, 4, 1))).count() == 1
    with pytest.raises(Exception, match="Overlapping membership of A"):
        U.interval_join(rows, spans(None)).collect()
    assert U.overlap_violations(rows, spans(None)).count() == 1


def test_membership_file_refuses_repeated_and_inverted_records(spark, tmp_path):
    from stratapanel.operators import universe as U

    head = ",".join(U.MEMBERSHIP_COLUMNS)
    for name, lines in (("twice", ["I,A,n,s,i,2020-01-01,,x,2020-01-01"] * 2), ("inverted", ["I,A,n,s,i,2020-01-01,2020-01-01,x,2020-01-01"])):
        (tmp_path / name).write_text("\n".join([head, *lines]))
        with pytest.raises(Exception, match="Repeated or inverted membership of A"):
            U.load_membership_csv(spark, str(tmp_path / name)).collect()
    (tmp_path / "good").write_text("\n".join([head, "I,A,n,s,i,2020-01-01,,x,2020-01-01"]))
    assert U.load_membership_csv(spark, str(tmp_path / "good")).count() == 1


def test_intervals_by_calendar_buckets_against_all_pairs(spark):
    """A hot ticker with many intervals, long and open ones, edges on bucket bounds, and a date before the epoch."""
    rng = np.random.default_rng(3)
    day = lambda k: dt.date(1970, 1, 1) + dt.timedelta(days=int(k))
    spans = [("hot", day(k * 7), day(k * 7 + 5), k) for k in range(600)]
    spans += [("long", day(-5000), day(9000), -1), ("open", day(255), None, -2), ("edge", day(4096), day(8192), -3), ("one", day(16), day(17), -4), ("none", day(40), day(40), -5)]
    rows = [(t, day(k)) for t in ("hot", "long", "open", "edge", "one", "none") for k in {*rng.integers(-6000, 10_000, 150).tolist(), 15, 16, 17, 254, 255, 256, 4095, 4096, 8191, 8192}]
    members = spark.createDataFrame(spans, "ticker string, effective_from date, effective_to date, mark int")
    dataset = spark.createDataFrame(rows, "ticker string, date date")
    got = sorted(tuple(r) for r in U.interval_join(dataset, members, "mark").select("ticker", "date", "mark").collect())
    assert got == sorted((t, d, m) for t, d in rows for s, a, b, m in spans if s == t and a <= d and (b is None or d < b))
    again = members.unionByName(members.where("mark < 0"))
    assert U.interval_join(dataset, again, "mark", strict=False).where("mark = -1").count() == 2 * sum(m == -1 for _, _, m in got)
    assert U.interval_join(dataset.limit(0), members).count() == 0 and U.interval_join(dataset, members.limit(0)).count() == 0
