from pyspark.sql import functions as F

from stratapanel.operators import live as V, timeseries as T
from stratapanel.session import stored


def test_replay_reads_one_sort_and_keeps_signals_of_missing_names(spark, panel):
    """A name without a price at the date keeps its 12-1 signal; only the chosen names' outcomes are worked out."""
    columns = {f"T{i}": [100.0 + (i * 37 + 11 * t * t) % 29 + t for t in range(20)] for i in range(9)}
    columns["T3"][16] = columns["T5"][13] = columns["T7"][19] = None
    months = stored(panel(columns), "months")
    days = [r[0] for r in months.select("date").distinct().orderBy("date").collect()]
    start, end = str(days[14]), str(days[18])
    three, twelve = (T.momentum(months, *x).where(F.col("date").between(days[14], days[18])).collect() for x in ((3, 0, "m"), (12, 1, "m")))
    want = {(r["date"], r["ticker"]): [r["m"], None] for r in three}
    for r in twelve:
        want.setdefault((r["date"], r["ticker"]), [None, None])[1] = r["m"]
    got = V.replay_signals(months, start, end).collect()
    assert {(r["as_of"], r["ticker"]): [r["momentum_3m"], r["momentum_12_1"]] for r in got} == want
    assert want[days[16], "T3"][0] is None and want[days[16], "T3"][1] is not None
    scores = stored(months.select("date", "ticker", F.col("close").alias("ml_score")), "scores")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.replay_decisions(months, scores, start, end, 2, 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "FullOuter" not in plan and "BroadcastHashJoin [ticker" in plan and "LeftSemi" in plan
