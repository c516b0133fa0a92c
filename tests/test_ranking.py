"""Ranks of wide dates against window functions: ties, NaN, infinities, NULL, and a date over many tasks."""

import pytest
from pyspark.sql import Window as W, functions as F

from stratapanel.operators import ranking as R, timeseries as T

VALUES = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, 1.5, -2.0]


@pytest.fixture(scope="module")
def wide(spark):
    """One date of 5,000 names, a third of them of one value; a few small dates; a NULL date."""
    rows = [("big", f"T{i:05d}", 7.0 if i % 3 == 0 else float((i * 7919) % 1000) / 8) for i in range(5000)]
    rows += [(d, f"T{i}", v) for d in ("a", "b", None) for i, v in enumerate(VALUES)]
    rows += [("one", "T0", 3.0), ("none", "T0", None)]
    return spark.createDataFrame(rows, "date string, ticker string, v double").repartition(7).withColumn("w", -F.col("v")).cache()


def by_window(df, value, method, descending):
    col = F.col(value)
    order = col.desc_nulls_last() if descending else col.asc_nulls_last()
    w = W.partitionBy("date")
    if method == "row":
        rank = F.row_number().over(w.orderBy(order, "ticker"))
    else:
        rank = F.rank().over(w.orderBy(order))
        if method == "average":
            rank = rank + (F.count(F.lit(1)).over(W.partitionBy("date", value)) - 1) / 2.0
    return {(r["date"], r["ticker"]): (r["k"], r["n"]) for r in df.select("date", "ticker", rank.alias("k"), F.count(col).over(w).alias("n")).collect()}


@pytest.mark.parametrize("method, descending", [("row", False), ("row", True), ("min", False), ("average", False)])
def test_ranks_equal_windows(wide, method, descending):
    got = R.ranked(wide, ("date",), "v", "k", method, descending, size="n")
    assert set(got.columns) == {"date", "ticker", "v", "w", "n", "k"}
    assert {(r["date"], r["ticker"]): (r["k"], r["n"]) for r in got.collect()} == by_window(wide, "v", method, descending)


def test_a_wide_date_lies_on_many_tasks(spark, wide):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        rows = R.numbered(wide, ("date",), [F.col("v").asc_nulls_last(), F.col("ticker")], F.col("v").isNotNull(), "row", "n")
        spread = wide.repartitionByRange(6, "date", "v", "ticker").where("date = 'big'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert spread >= 4
        got = {r["ticker"]: r["row"] for r in rows.where("date = 'big'").collect()}
        assert sorted(got.values()) == list(range(1, 5001))
        assert got == {t: k[0] for (d, t), k in by_window(wide, "v", "row", False).items() if d == "big"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_values_ranked_together(wide):
    for method in ("min", "average"):
        got = R.ranked_together(wide, ("date",), {"v": "rv", "w": "rw"}, method)
        assert got.columns == ["date", "ticker", "v", "w", "rv", "rv_size", "rw", "rw_size"]
        rows = got.collect()
        for value, name in (("v", "rv"), ("w", "rw")):
            assert {(r["date"], r["ticker"]): (r[name], r[f"{name}_size"]) for r in rows} == by_window(wide, value, method, False)


def test_medians(wide):
    clean = wide.where(~F.isnan("v") & (F.abs("v") != float("inf")))
    want = {r["date"]: r["m"] for r in clean.groupBy("date").agg(F.median("v").alias("m")).collect()}
    assert {r["date"]: r["m"] for r in R.medians(clean, ("date",), "v", "m").collect()} == pytest.approx(want)


def test_quantiles_of_equal_counts(wide):
    got = R.quantiles(wide, score="v", buckets=5).where("date = 'big'").groupBy("quantile_number").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(k, 1000) for k in range(1, 6)]


def test_baseline_score_is_the_mean_percentile(spark):
    rows = [("d", f"T{i}", *[float((i * p) % 11) for p in (1, 3, 5, 7, 9)], 0.1, 0.0, 1) for i in range(8)]
    names = ", ".join(f"{f} double" for f in T.FEATURES)
    df = spark.createDataFrame(rows, f"date string, ticker string, {names}, future_return double, benchmark_return double, target int").withColumn("target_date", F.lit("e"))
    w = W.partitionBy("date")
    total = sum((F.percent_rank().over(w.orderBy(f)) for f in T.FEATURES[1:]), F.percent_rank().over(w.orderBy(T.FEATURES[0])))
    want = {r["ticker"]: r["s"] for r in df.select("ticker", (total / 5.0).alias("s")).collect()}
    assert {r["ticker"]: r["ml_score"] for r in R.baseline_score(df).collect()} == want
    assert R.baseline_score(df.limit(0)).count() == 0


@pytest.mark.parametrize("method, descending", [("min", False), ("min", True), ("average", False), ("average", True)])
def test_shared_ranks_over_many_cells(wide, monkeypatch, method, descending):
    """Bounds between and upon repeated values, NULL, NaN and infinities."""
    monkeypatch.setattr(R, "CELL_ROWS", 40)
    monkeypatch.setattr(R, "CELL_SAMPLES", 8)
    got = R.ranked(wide, ("date",), "v", "k", method, descending, size="n")
    assert {(r["date"], r["ticker"]): (r["k"], r["n"]) for r in got.collect()} == by_window(wide, "v", method, descending)


def test_shared_ranks_move_rows_twice(spark, wide):
    """To their cells and back together; the tables of counts are joined without a shuffle."""
    rows = wide.where("date IS NOT NULL").select("date", "ticker", "v", "w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = R.ranked_together(rows, ("date",), {"v": "a", "w": "b"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan and "Exchange rangepartitioning" not in plan
