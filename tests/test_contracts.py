"""Table-wide contracts fail inside the job that reads the result, also where the result is empty."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratapanel.functions.columns import checked
from stratapanel.operators import capacity as K, ledger as L, quality as Q, timeseries as T


def test_a_checked_result_fails_also_when_it_is_empty(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    bad, none = rows.where("k = 1"), rows.where("k = 2")
    assert [tuple(r) for r in checked(rows, none, "no").collect()] == [(1, "a")]
    assert checked(none, none, "no").count() == 0
    for df in (rows, none):
        with pytest.raises(Exception, match="broken here"):
            checked(df, bad, "broken here").collect()


def test_reverse_lookup_fails_on_absent_and_ambiguous_symbols(spark):
    names = spark.createDataFrame([("brk.b",), ("A",), ("B",)], "ticker string")
    shared = spark.createDataFrame([("A", "X"), ("B", "X")], "canonical_ticker string, override string")
    seen = lambda *s: spark.createDataFrame([(x,) for x in s], "provider_ticker string")
    plain, mapped = Q.ticker_mapping(names), Q.ticker_mapping(names, shared)
    assert [r["canonical_ticker"] for r in Q.to_canonical(seen(" brk-b "), plain).collect()] == ["BRK.B"]
    for observations, mapping in ((seen("A", "ZZZ"), plain), (seen("X"), mapped)):
        with pytest.raises(Exception, match="absent or ambiguous"):
            Q.to_canonical(observations, mapping).collect()
    assert {tuple(r) for r in Q.lookup_violations(seen("A", "zzz", "ZZZ", "X"), mapped).collect()} == {("A", 1), ("ZZZ", 2), ("X", 1)}
    assert [r["canonical_ticker"] for r in Q.to_canonical(seen("A", "ZZZ", "BRK-B"), mapped, strict=False).collect()] == ["BRK.B"]


@pytest.fixture(scope="module")
def bars(panel):
    return panel({f"T{i}": [100.0 + i + k for k in range(9)] for i in range(3)}).withColumn("open", F.col("close")).withColumn("volume", F.lit(10.0)).cache()


def schedule_of(bars, positions, **options):
    adv = T.average_dollar_volume(bars.withColumnRenamed("close", "raw_close"), 2)
    return K.paired_schedule(positions, bars, adv, 1, **options)


def test_paired_schedule_must_be_contiguous_and_long_enough(bars):
    positions = L.momentum_positions(bars.select("date", "ticker", "close"), 1, 0, 2, max_weight=0.5).cache()
    kept = schedule_of(bars, positions).where("reason IS NULL").orderBy("signal_date").collect()
    assert len(kept) > 3
    hole = positions.where(F.col("signal_date") != F.lit(kept[1]["signal_date"]))
    with pytest.raises(Exception, match="NONCONTIGUOUS_PAIRED_SCHEDULE"):
        schedule_of(bars, hole).collect()
    assert schedule_of(bars, hole, strict=False).where("reason IS NULL").count() == len(kept) - 1
    one = positions.where(F.col("signal_date") == F.lit(kept[1]["signal_date"]))
    none = positions.where(F.lit(False))
    for few in (one, none):
        with pytest.raises(Exception, match="INSUFFICIENT_PAIRED_EXECUTION_PERIODS"):
            schedule_of(bars, few).collect()
    thin = bars.withColumn("volume", F.when(F.col("ticker") != "T1", F.col("volume")))
    with pytest.raises(Exception, match="INSUFFICIENT_LIQUIDITY_HISTORY"):
        schedule_of(thin, positions).collect()


def test_calendars_are_compared_for_every_security(spark):
    d = lambda *x: dt.date(*x)
    rows = [("A", d(2020, 1, 31), 1.0), ("A", d(2020, 2, 28), 1.0), ("B", d(2020, 1, 30), 1.0), ("B", d(2020, 1, 31), None), ("C", d(2020, 1, 31), 1.0), ("C", d(2020, 2, 28), 1.0), ("C", d(2020, 3, 2), 1.0)]
    panel = spark.createDataFrame(rows, "ticker string, date date, close double")
    bench = spark.createDataFrame([(d(2020, 1, 15), 1.0), (d(2020, 1, 31), 1.0), (d(2020, 2, 28), 1.0)], "date date, close double")
    got = {tuple(r) for r in T.calendar_violations(panel, bench).collect()}
    assert got == {("B", d(2020, 1, 30), d(2020, 1, 31)), ("B", None, d(2020, 2, 28)), ("C", d(2020, 3, 2), None)}
