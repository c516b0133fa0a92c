"""Cross-sectional ranks, top-N and equal-count quantiles.

A row number is a place in a global order.  Rows are range-partitioned and sorted
by (keys, value, ticker), which spreads one wide date over as many tasks as it
needs, and are written once with their partition and place.  Counts per
partition and key, summed over the partitions before, turn the place into a row
number.

Ranks that equal values share need no place.  A group's values are cut into cells
by bounds from a few of its rows; counts per cell give the rows before each, and
a cell is ranked by itself.  Rows equal to a bound are a cell of their own that
needs no sort, so neither a wide date nor a value that very many rows share lies
in one task.  Bounds only say where a row is ranked, never its rank.  Several
values (the five features) are ranked in one pass, with the value's number as a
leading key.  The tables of counts are stored, so the optimizer knows how small
they are and moves no rows to join them.  Top-N needs no such sort: only N rows
per date and map task travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.operators.timeseries import FEATURES
from stratapanel.scale import even_width
from stratapanel.session import kept, stored

#: Rows that a cell has about, sampled rows between two bounds, and bounds of a group at most (its cells grow beyond that).
CELL_ROWS, CELL_SAMPLES, MOST_BOUNDS = 100_000, 50, 64


def _null_safe(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on equal or both NULL ``on``; the right side's copies are dropped."""
    other = right.withColumnsRenamed({c: f"_j_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_j_{c}" for c in on])


def numbered(df: DataFrame, keys: tuple[str, ...], order: list[Column], present: Column, row: str, size: str) -> DataFrame:
    """``df`` with the row number in ``order`` within ``keys`` and the number of rows where ``present``, sorted by range."""
    by = [*[F.col(k) for k in keys], *order]
    placed = stored(
        df.repartitionByRange(even_width(df), *by).sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    # One row per partition and key: at most as many as keys and partitions together.
    counts = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.count(F.when(present, 1)).alias("_known"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", *keys, "_first", before.alias("_before"), F.sum("_known").over(group).alias(size))
    joined = _null_safe(placed, stored(offsets, "offsets"), ("_part", *keys))
    return joined.withColumn(row, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def _tied(df: DataFrame, group: tuple[str, ...], value: str, name: str, size: str, average: bool, descending: bool) -> DataFrame:
    """``df``, a stored table or a projection of one, with ranks that equal values share; NULL is last, a value like others."""
    v, by = F.col(value), [F.col(g) for g in group]
    every = max(1, CELL_ROWS // CELL_SAMPLES)
    tie = [F.col("ticker")] if "ticker" in df.columns else []
    sample = df.where(v.isNotNull() & (F.pmod(F.xxhash64(*by, *tie, v), F.lit(every)) == 0)).select(*group, v.alias("_v"))
    # A few rows per cell: at most one in ``every`` is gathered, by group.
    line = sample.groupBy(*group).agg(F.sort_array(F.collect_list("_v"), not descending).alias("_s"))
    step = F.greatest(F.lit(CELL_SAMPLES), F.ceil(F.size("_s") / F.lit(MOST_BOUNDS))).cast("int")
    cut = F.array_distinct(F.filter("_s", lambda x, i: (i + 1) % step == 0))
    bounds = stored(line.select(*group, cut.alias("_bounds")).where(F.size("_bounds") > 0), "bounds")
    rows = _null_safe(df, bounds, group, "left").withColumn("_bounds", F.coalesce("_bounds", F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")))
    before = F.size(F.filter("_bounds", (lambda x: x > v) if descending else (lambda x: x < v)))
    # Even cells lie between bounds, odd ones hold a single value: a bound's, or NULL.
    cell = F.when(v.isNull(), 2 * F.size("_bounds") + 1).otherwise(2 * before + F.coalesce(F.get("_bounds", before) == v, F.lit(False)).cast("int"))
    rows = rows.withColumn("_cell", cell).drop("_bounds")
    counts = rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_rows"), F.count(v).alias("_known"))
    line = Window.partitionBy(*group)
    less = F.coalesce(F.sum("_rows").over(line.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = stored(counts.select(*group, "_cell", "_rows", less.alias("_less"), F.sum("_known").over(line).alias(size)), "cells")
    own = Window.partitionBy(*group, "_cell")
    order = v.desc() if descending else v.asc()
    between = rows.where("_cell % 2 = 0").withColumn("_at", F.rank().over(own.orderBy(order)).cast("bigint"))
    if average:
        between = between.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*group, "_cell", value)))
    single = rows.where("_cell % 2 = 1").withColumn("_at", F.lit(1).cast("bigint"))
    if average:
        single = single.withColumn("_same", F.lit(None).cast("bigint"))
    out = _null_safe(between.unionByName(single), cells, (*group, "_cell"))
    rank = F.col("_less") + F.col("_at")
    if average:
        rank = rank + (F.coalesce("_same", "_rows") - 1) / F.lit(2.0)
    return out.select(*df.columns, rank.alias(name), size)


def ranked(
    df: DataFrame,
    keys: tuple[str, ...],
    value: str,
    name: str,
    method: str = "row",
    descending: bool = False,
    tie: tuple[str, ...] = ("ticker",),
    size: str | None = None,
) -> DataFrame:
    """Rank of ``value`` within ``keys``; NULL values rank last, NaN above every number.

    ``method``: ``row`` (ties broken by ``tie``), ``min`` or ``average`` (ties
    share a rank).  ``size`` also attaches the number of non-NULL values.
    """
    col = F.col(value)
    if method != "row":
        out = _tied(kept(df, "ranked"), tuple(keys), value, name, size or "_size", method == "average", descending)
        return out if size else out.drop("_size")
    order = [col.desc_nulls_last() if descending else col.asc_nulls_last(), *[F.col(t) for t in tie if t in df.columns]]
    out = numbered(df, tuple(keys), order, col.isNotNull(), name, "_size")
    return out.withColumnRenamed("_size", size) if size else out.drop("_size")


def ranked_together(
    df: DataFrame, keys: tuple[str, ...], values: dict[str, str], method: str = "min", size: str = "{}_size", descending: bool = False,
) -> DataFrame:
    """Ranks of several values in one sort; ``values``: column -> name of its rank.

    Rows are told apart by ``keys`` and ``ticker``; ``size`` names the count of a value's non-NULL rows.
    """
    ids = [*keys, "ticker"]
    rest = [c for c in df.columns if c not in ids]
    df = kept(df, "ranked")
    parts = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(v).cast("double").alias("_value")) for i, v in enumerate(values)])
    long = df.select(*ids, F.inline(parts))
    if method == "row":
        order = [F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last(), F.col("ticker")]
        out = numbered(long, ("_which", *keys), order, F.col("_value").isNotNull(), "_rank", "_n")
    else:
        out = _tied(long, ("_which", *keys), "_value", "_rank", "_n", method == "average", descending)
    out = out.select(*ids, "_which", "_rank", "_n")
    picked = []
    for i, (value, name) in enumerate(values.items()):
        own = F.col("_which") == i
        picked += [F.max(F.when(own, F.col("_rank"))).alias(name), F.max(F.when(own, F.col("_n"))).alias(size.format(name))]
    # The other columns meet the ranks here. Dealt first, then grouped in place: no half-empty sums travel.
    both = out.unionByName(df.select(*ids, F.struct(*rest).alias("_rest")), allowMissingColumns=True)
    wide = both.repartition(*ids).groupBy(*ids).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *picked)
    names = [x for name in values.values() for x in (name, size.format(name))]
    return wide.select(*ids, "_rest.*", *names).select(*df.columns, *names)


def top_n(df: DataFrame, keys: tuple[str, ...], score: str, n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` best rows per group, ticker ascending on ties, NULL dropped.

    The row-number filter becomes a per-partition group limit before the
    shuffle, so at most ``n`` rows per group and map task travel.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "ticker")
    return (
        df.where(F.col(score).isNotNull())
        .withColumn(rank, F.row_number().over(w))
        .where(F.col(rank) <= n)
    )


def bottom_n(df: DataFrame, keys: tuple[str, ...], score: str, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.asc(score), "ticker")
    return (
        df.where(F.col(score).isNotNull())
        .withColumn(rank, F.row_number().over(w))
        .where(F.col(rank) <= n)
    )


def extremes(df: DataFrame, keys: tuple[str, ...], score: str, n: int) -> DataFrame:
    """First and last ``n`` rows per group, each row once."""
    high = top_n(df, keys, score, n, "_r").drop("_r")
    low = bottom_n(df, keys, score, n, "_r").drop("_r")
    w = Window.partitionBy(*keys, "ticker").orderBy(F.desc(score))
    return high.unionByName(low).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def quantiles(scores: DataFrame, keys=("date",), score: str = "ml_score", buckets: int = 5) -> DataFrame:
    """Equal-count assignment ``floor((rank-1) * buckets / n) + 1``, worst first."""
    out = ranked(
        scores.where(F.col(score).isNotNull()), keys, score, "_row", size="_n"
    )
    number = (F.floor((F.col("_row") - 1) * buckets / F.col("_n")) + 1).cast("int")
    return out.withColumn("quantile_number", number).withColumn(
        "quantile", F.concat(F.lit("Q"), F.col("quantile_number").cast("string"))
    ).drop("_row", "_n")


def score_order(scores: DataFrame, keys=("date",), score: str = "ml_score", name: str = "rank") -> DataFrame:
    """Rank 1 = best score, ticker ascending on ties."""
    return ranked(scores, keys, score, name, descending=True)


def medians(df: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
    """(keys, name): exact median of the non-NULL values, picked by row number; no group is gathered."""
    rows = ranked(df.where(F.col(value).isNotNull()), keys, value, "_row", size="_n")
    middle = (F.col("_row") == F.expr("(_n + 1) div 2")) | (F.col("_row") == F.expr("_n div 2 + 1"))
    return rows.where(middle).groupBy(*keys).agg(F.avg(value).alias(name))


def percent_rank(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    out = ranked(df, keys, value, "_rank", method="min", size="_n")
    return out.withColumn(name, _percent("_rank", "_n")).drop("_rank", "_n")


def _percent(rank: str, size: str) -> Column:
    return F.coalesce(F.try_divide(F.col(rank) - 1, F.col(size) - 1), F.lit(0.0))


def baseline_score(dataset: DataFrame) -> DataFrame:
    """``ml_score`` = mean percentile of the five features on each date.

    A transparent stand-in for the trained ranker wherever only the *use* of a
    score matters.
    """
    out = ranked_together(dataset, ("date",), {f: f"_r_{f}" for f in FEATURES})
    parts = [_percent(f"_r_{f}", f"_r_{f}_size") for f in FEATURES]
    total = sum(parts[1:], parts[0])
    return out.withColumn("ml_score", total / 5.0).select(
        "date", "target_date", "ticker", "ml_score", "future_return", "benchmark_return", "target"
    )
