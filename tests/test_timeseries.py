import datetime as dt

import pytest
from conftest import month_ends

from stratapanel.operators import ranking as R, timeseries as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_month_end_keeps_missing_cell(panel):
    dates = [dt.date(2020, 1, 30), dt.date(2020, 1, 31)]
    out = T.last_observation_by_month(panel({"A": [100, None], "B": [100, 101]}, dates))
    assert rows(out.select("date", "ticker", "close"), "ticker") == [(dt.date(2020, 1, 31), "B", 101.0)]


def test_gap_is_not_a_longer_return(panel):
    out = T.simple_returns(panel({"A": [100, None, 121], "B": [10, 11, 12]}))
    got = {(r["ticker"], r["t"]): r["ret"] for r in out.collect()}
    assert got[("A", 3)] is None
    assert got[("B", 3)] == pytest.approx(12 / 11 - 1)


def test_momentum_with_skip_ignores_recent_and_survives_missing_today(panel):
    base = [100 + i for i in range(14)]
    out = {r["t"]: r for r in T.momentum(panel({"A": base, "B": base}), 12, 1).where("ticker = 'A'").collect()}
    assert out[13]["momentum"] == pytest.approx(base[11] / base[0] - 1)
    later = base[:12] + [v * 100 for v in base[12:]]
    changed = {r["t"]: r for r in T.momentum(panel({"A": later, "B": base}), 12, 1).where("ticker = 'A'").collect()}
    assert changed[13]["momentum"] == pytest.approx(out[13]["momentum"])
    hole = base[:12] + [None] + base[13:]
    kept = {r["t"]: r for r in T.momentum(panel({"A": hole, "B": base}), 12, 1).where("ticker = 'A'").collect()}
    assert kept[13]["momentum"] == pytest.approx(base[11] / base[0] - 1)
    assert kept[13]["asset_return"] is None
    with pytest.raises(ValueError):
        T.momentum(panel({"A": base}), 3, 3)


def test_full_window_guard(panel):
    dense = T.rolling_drawdown(panel({"A": [4, 3, 2, 4], "B": [1, 1, 1, 1]}), 3).where("ticker = 'A'").orderBy("t").collect()
    assert [r["drawdown"] for r in dense] == [None, None, pytest.approx(-0.5), pytest.approx(0.0)]
    holes = T.rolling_drawdown(panel({"A": [4, None, 2, 4], "B": [1, 1, 1, 1]}), 3).where("ticker = 'A'").collect()
    assert all(r["drawdown"] is None for r in holes)


def test_adv_ends_before_the_row(spark):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(23)]
    data = [(d, "A", 10.0 + i, 100.0) for i, d in enumerate(dates)]
    frame = spark.createDataFrame(data, "date date, ticker string, raw_close double, volume double")
    out = {r["t"]: r["adv"] for r in T.average_dollar_volume(frame, 20).collect()}
    assert min(out) == 21
    assert out[21] == pytest.approx(sum(10.0 + i for i in range(20)) / 20 * 100)
    bad = spark.createDataFrame([(d, t, p, 0.0 if i == 5 else v) for i, (d, t, p, v) in enumerate(data)], frame.schema)
    assert min(r["t"] for r in T.average_dollar_volume(bad, 15).collect()) == 22


def test_terminal_cross_section_is_kept(panel):
    p = panel({"A": [100 * 1.01**i for i in range(10)], "B": [100 * 1.02**i for i in range(10)]})
    bench = p.where("ticker = 'A'").select("date", "close")
    out = T.labelled_dataset(p, bench)
    last = out.where(out.date == month_ends(10)[-1]).collect()
    assert len(last) == 2
    assert all(r["target"] is None and r["future_return"] is None and r["target_date"] is None for r in last)
    known = out.where("target is not null and ticker = 'B'").collect()
    assert known and all(r["target"] == 1 for r in known)


def test_calendar_mismatch_is_reported(panel):
    p = panel({"A": [1, 2]})
    bench = panel({"X": [1, 2]}, [month_ends(2)[0], dt.date(2020, 2, 28)]).select("date", "close")
    bad = T.calendar_violations(p, bench).collect()
    assert [(r["panel_date"], r["benchmark_date"]) for r in bad] == [(dt.date(2020, 2, 29), dt.date(2020, 2, 28))]


def test_drawdown_starts_from_initial_capital(returns):
    out = T.wealth_path(returns({"s": [-0.2, 0.1]})).orderBy("date").collect()
    assert [round(r["drawdown"], 9) for r in out] == [-0.2, -0.12]


def test_grid_shows_missing_cells(panel):
    p = panel({"A": [1, None], "B": [1, 2]})
    assert T.session_grid(p, p).count() == 4


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_order_nan_infinities_and_repeated_values(spark, descending):
    values = [float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 0.0, None, None, 0.25, 0.25, 0.25]
    df = spark.createDataFrame([("d", f"t{i:02d}", v) for i, v in enumerate(values)], "date string, ticker string, x double")
    rows = {m: {r["ticker"]: r["r"] for r in R.ranked(df, ("date",), "x", "r", m, descending, size="n").collect()} for m in ("row", "min", "average")}
    up = [2, 4, 5, 8, 9, 10, 3, 1, 0]  # NaN stands above +inf
    down = [0, 1, 3, 8, 9, 10, 5, 4, 2]
    order = [f"t{i:02d}" for i in (down if descending else up)] + ["t06", "t07"]
    assert [rows["row"][t] for t in order] == list(range(1, 12))
    at = order.index("t08") + 1
    assert [rows["min"][f"t{i:02d}"] for i in (8, 9, 10)] == [at] * 3
    assert [rows["average"][f"t{i:02d}"] for i in (8, 9, 10)] == [at + 1.0] * 3


def test_quantiles_use_floor_formula(spark):
    df = spark.createDataFrame([("d", f"t{i}", float(i)) for i in range(7)], "date string, ticker string, ml_score double")
    sizes = {r["quantile"]: r["count"] for r in R.quantiles(df).groupBy("quantile").count().collect()}
    assert sizes == {"Q1": 2, "Q2": 1, "Q3": 2, "Q4": 1, "Q5": 1}
