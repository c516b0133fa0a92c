"""Re-runs of a strategy suite on universes that lack some securities, scores included.

A scenario is ``(strategy, <key>, removed)`` with a short array of tickers.  Two
closed forms replace re-running whole universes:

* Momentum of a name does not depend on the others, so a removal only moves the
  ranks behind it: a date changes where a removed name was selected, and the
  next ranked names move up.
* The percentile score does depend on them, by a *rank delta*: a removed name
  takes one from the ranks of those above it, feature by feature, and one from
  the count.  Only names whose rank sum reaches that of the (n + removed)-th
  best, less what a removal can take, can be selected, so a date's few
  candidates answer every removal: rows are universe x periods x candidates, not
  universe squared.

Dates on which the selection stays as it was keep the baseline's positions, and
scenarios that change no date take the baseline's ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.operators.ledger import periods
from stratapanel.operators.ranking import ranked_together
from stratapanel.operators.timeseries import FEATURES


def rank_sums(dataset: DataFrame) -> DataFrame:
    """``dataset`` with each feature's rank less one, their sum, and the date's count."""
    out = ranked_together(dataset, ("date",), {f: f"_r_{f}" for f in FEATURES}).withColumn("_n", F.col(f"_r_{FEATURES[0]}_size"))
    out = out.withColumns({f"_r_{f}": F.col(f"_r_{f}") - 1 for f in FEATURES}).drop(*[f"_r_{f}_size" for f in FEATURES])
    return out.withColumn("_sum", reduce(lambda a, b: a + b, [F.col(f"_r_{f}") for f in FEATURES]))


def date_candidates(ranks: DataFrame, n: int, most: int) -> DataFrame:
    """One row per date: its count, labelled count, and the names a removal of up to ``most`` others can select."""
    w = Window.partitionBy("date")
    nth = F.row_number().over(w.orderBy(F.desc("_sum"), "ticker"))
    # One more than a removal can take off a sum of ranks, so that rounding never decides who is looked at.
    reach = F.min(F.when(F.col("_nth") <= n + most, F.col("_sum"))).over(w) - len(FEATURES) * most - 1
    near = ranks.withColumn("_nth", nth).withColumn("_reach", reach)
    fields = F.struct("ticker", "future_return", "target_date", *[F.col(f) for f in FEATURES], *[F.col(f"_r_{f}") for f in FEATURES])
    return near.groupBy("date").agg(
        F.max("_n").alias("count"), F.count("future_return").alias("labelled"),
        F.collect_list(F.when(F.col("_sum") >= F.col("_reach"), fields)).alias("near"))


def _rescored(candidate: Column, gone: Column, count: Column) -> Column:
    """The percentile score of a candidate in a universe without ``gone``."""
    def percentile(f: str) -> Column:
        below = F.size(F.filter(gone, lambda x: x[f] < candidate[f]))
        return F.coalesce(F.try_divide(candidate[f"_r_{f}"] - below, count - 1), F.lit(0.0))

    return reduce(lambda a, b: a + b, [percentile(f) for f in FEATURES]) / 5.0


def rescored_picks(dataset: DataFrame, scenarios: DataFrame, key: str, n: int, most: int, strategy: str = "ml") -> DataFrame:
    """(strategy, key, signal_date, date, ticker, asset_return, weight) of every date that a scenario touches."""
    ranks = rank_sums(dataset)
    names = scenarios.select(key, "removed", F.explode("removed").alias("ticker"))
    values = F.struct(*[F.col(f) for f in FEATURES])
    gone = ranks.join(names, "ticker").groupBy(key, "date").agg(
        F.collect_list(values).alias("gone"), F.count("future_return").alias("_lost"), F.collect_list("ticker").alias("_names"))
    met = gone.join(date_candidates(ranks, n, most), "date").where(F.col("labelled") > F.col("_lost"))
    left = F.filter("near", lambda c: ~F.array_contains("_names", c["ticker"]))
    rest = F.col("count") - F.size("gone")
    order = F.transform(left, lambda c: F.struct((-_rescored(c, F.col("gone"), rest)).alias("o"), c["ticker"].alias("ticker"), c["future_return"].alias("asset_return"), c["target_date"].alias("date")))
    picked = F.slice(F.array_sort(order), 1, n)
    rows = met.select(F.lit(strategy).alias("strategy"), key, F.col("date").alias("signal_date"), F.inline(picked)).drop("o")
    return _equal(rows, key)


def shifted_picks(candidates: DataFrame, scenarios: DataFrame, key: str, n: int) -> DataFrame:
    """The same for rankings that do not depend on the other names: ``candidates`` reach rank ``n`` + the largest set."""
    names = scenarios.select("strategy", key, F.explode("removed").alias("ticker"))
    touched = candidates.where(F.col("rank") <= n).join(names, ["strategy", "ticker"]).groupBy("strategy", key, "signal_date").agg(F.max("rank").alias("_t"))
    sets = scenarios.select("strategy", key, "removed")
    kept = touched.join(sets, ["strategy", key]).join(candidates, ["strategy", "signal_date"]).where(~F.array_contains("removed", F.col("ticker")))
    w = Window.partitionBy("strategy", key, "signal_date").orderBy("rank")
    chosen = kept.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n)
    return _equal(chosen.select("strategy", key, "signal_date", "ticker", "asset_return", "date"), key)


def _equal(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy("strategy", key, "signal_date")
    return rows.withColumn("date", F.max("date").over(w)).withColumn("weight", 1.0 / F.count(F.lit(1)).over(w)).select(
        "strategy", key, "signal_date", "date", "ticker", "asset_return", "weight")


def changed_picks(picks: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Those picks whose date selects other names than the baseline."""
    held = F.sort_array(F.collect_list("ticker"))
    own = picks.groupBy("strategy", key, "signal_date").agg(held.alias("_own"))
    was = baseline.groupBy("strategy", "signal_date").agg(held.alias("_was"))
    other = own.join(was, ["strategy", "signal_date"], "left").where(~F.col("_own").eqNullSafe(F.col("_was"))).select("strategy", key, "signal_date")
    return picks.join(other, ["strategy", key, "signal_date"], "left_semi")


def affected_positions(changed: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """All positions of the scenarios that change a date: the changed dates, and the baseline's on the others."""
    dates = baseline.groupBy("strategy").agg(F.sort_array(F.collect_set("signal_date")).alias("_dates"))  # one row a strategy
    touched = changed.select("strategy", key, "signal_date").distinct()
    whole = touched.select("strategy", key).distinct().join(F.broadcast(dates), "strategy").select("strategy", key, F.explode("_dates").alias("signal_date"))
    same = whole.join(touched, ["strategy", key, "signal_date"], "left_anti").join(baseline, ["strategy", "signal_date"])
    return changed.unionByName(same.select(*changed.columns))


def rerun_ledger(
    baseline: DataFrame, candidates: DataFrame, dataset: DataFrame, scenarios: DataFrame, key: str, n: int, most: int, scored: str = "ml", strict: bool = False,
) -> DataFrame:
    """Ledgers of the scenarios that change something.

    ``baseline``: positions of all strategies; ``candidates``: ranked rows of the
    strategies whose signals stand alone; ``dataset``: features and outcomes of
    the ``scored`` one.
    """
    alone = shifted_picks(candidates.where(F.col("strategy") != scored), scenarios, key, n)
    again = rescored_picks(dataset, scenarios.where(F.col("strategy") == scored), key, n, most, scored)
    base = baseline.select("strategy", "signal_date", "date", "ticker", "asset_return", "weight")
    changed = changed_picks(alone.unionByName(again), base, key)
    return periods(affected_positions(changed, base, key), ("strategy", key), strict=strict)


def every_ledger(reruns: DataFrame, baseline: DataFrame, scenarios: DataFrame, key: str) -> DataFrame:
    """``reruns`` with the baseline's ledger for every scenario that changes nothing."""
    columns = [c for c in reruns.columns if c != key]
    still = scenarios.select("strategy", key).join(reruns.select("strategy", key).distinct(), ["strategy", key], "left_anti")
    dates = baseline.groupBy("strategy").agg(F.collect_list("signal_date").alias("_dates"))  # one row a strategy
    grid = still.join(F.broadcast(dates), "strategy").select("strategy", key, F.explode("_dates").alias("signal_date"))
    return reruns.unionByName(grid.join(baseline.select(*columns), ["strategy", "signal_date"]).select(*reruns.columns))


def single_removals(strategies: tuple[str, ...], tickers: DataFrame) -> DataFrame:
    """(strategy, removed_ticker, removed): every universe that lacks exactly one name."""
    names = tickers.select(F.col("ticker").alias("removed_ticker")).distinct()
    return names.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies]))).select(
        "strategy", "removed_ticker", F.array("removed_ticker").alias("removed"))
