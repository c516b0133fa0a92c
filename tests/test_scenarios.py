"""Removals against re-running every reduced universe from its prices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import ledger as L, ranking as R, scenarios as N, timeseries as T

KEYS = ("strategy", "removed_ticker")


@pytest.fixture(scope="module")
def prices(panel):
    """Equal values (ties in ranks and scores), gaps, and a name that starts late."""
    rng = np.random.default_rng(12)
    wide = {f"T{i}": [float(round(x, 1)) for x in 100 * np.cumprod(1 + rng.normal(0.01, 0.05, 16))] for i in range(9)}
    wide["T8"] = wide["T7"]
    wide["T5"][9] = None
    wide["T2"][:5] = [None] * 5
    return panel(wide)


def benchmark(prices):
    return prices.groupBy("date").agg(F.avg("close").alias("close"))


def suite(prices, base):
    dataset = T.labelled_dataset(prices, base)
    positions = L.momentum_positions(prices, 3, 0, 3, "m").unionByName(L.score_positions(R.baseline_score(dataset), 3, "ml"))
    return dataset, positions


def rows(ledger):
    cols = ("strategy", "signal_date", "date", "gross_return", "turnover", "net_return")
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in ledger.collect())


def test_single_removals_equal_reruns(prices):
    base = benchmark(prices)
    dataset, positions = suite(prices, base)
    removals = N.single_removals(("m", "ml"), prices)
    again = N.rerun_ledger(positions, L.momentum_selection(prices, 3, 0, 4, "m"), dataset, removals, "removed_ticker", 3, 1)
    got = N.every_ledger(again, L.periods(positions, strict=False), removals, "removed_ticker").cache()
    assert got.select(*KEYS).distinct().count() == 2 * 9
    for ticker in ("T2", "T7"):
        reduced = prices.where(F.col("ticker") != ticker)
        want = L.periods(suite(reduced, base)[1], strict=False)
        assert rows(got.where(F.col("removed_ticker") == ticker)) == rows(want)


def test_sets_of_several_names_equal_reruns(spark, prices):
    base = benchmark(prices)
    dataset, positions = suite(prices, base)
    sets = spark.createDataFrame(
        [("m", 1, ["T0"]), ("ml", 1, ["T7"]), ("m", 2, ["T1", "T2"]), ("ml", 2, ["T5", "T8"]), ("ml", 3, ["T0", "T3", "T6"])], "strategy string, scenario int, removed array<string>")
    again = N.rerun_ledger(positions, L.momentum_selection(prices, 3, 0, 6, "m"), dataset, sets, "scenario", 3, 3)
    got = N.every_ledger(again, L.periods(positions, strict=False), sets, "scenario").cache()
    for strategy, scenario, removed in [("m", 2, ("T1", "T2")), ("ml", 3, ("T0", "T3", "T6"))]:
        reduced = prices.where(~F.col("ticker").isin(*removed))
        want = L.periods(suite(reduced, base)[1], strict=False).where(F.col("strategy") == strategy)
        assert rows(got.where((F.col("strategy") == strategy) & (F.col("scenario") == scenario))) == rows(want)


def test_a_name_never_selected_keeps_the_baseline(panel):
    p = panel({f"T{i}": [100.0 * (1 + 0.01 * (9 - i)) ** k for k in range(14)] for i in range(9)})
    base = benchmark(p)
    dataset, positions = suite(p, base)
    again = N.rerun_ledger(positions, L.momentum_selection(p, 3, 0, 4, "m"), dataset, N.single_removals(("m",), p), "removed_ticker", 3, 1)
    assert {r[0] for r in again.select("removed_ticker").distinct().collect()} == {"T0", "T1", "T2"}
