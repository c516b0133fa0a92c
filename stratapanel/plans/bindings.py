"""Frames the queries share: panels, datasets, scores and the strategy suite.

A panel is the one reduction of the big scan; reports then read it many times.
So each shared frame is computed once per session and state of the folder, written as a
Parquet table to the cluster's shared folder and read back.  That cuts the
lineage (short plans, nothing to recompute when an executor is lost) and gives
the optimizer exact sizes, column pruning and pushdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.operators import attribution as A, ledger as L, metrics as M, ranking as R, scenarios as N, timeseries as T
from stratapanel.session import stored
from stratapanel.sources import panels as P

STRATEGIES = ("momentum_3m_equal", "momentum_12_1_equal", "ml")
SUBPERIODS = [
    ("period_1", "1995-01-01", "1996-12-31"), ("period_2", "1997-01-01", "1998-12-31"),
    ("period_3", "1999-01-01", "1999-12-31"), ("period_4", "2000-01-01", "2001-12-31"),
]
_SHARED: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, folder: str) -> int:
    """Changes when a file of the folder does: names, sizes and times of what lies in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    return hash(tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))


def shared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Compute the frame on first use in a session and keep it as a table."""
    def get(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder.rstrip("/"), stamp(spark, folder), f"{build.__module__}.{build.__name__}")
        if key not in _SHARED:
            _SHARED[key] = stored(build(spark, folder), build.__name__)
        return _SHARED[key]

    get.__name__, get.__doc__ = build.__name__, build.__doc__
    return get


def release(spark: SparkSession) -> None:
    """Forget every frame shared in this session; the next use recomputes it."""
    for key in [k for k in _SHARED if k[0] == spark.sparkContext.applicationId]:
        del _SHARED[key]


def closes(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", "close")


@shared
def brand(s: SparkSession, d: str) -> DataFrame:
    return P.brand_months(s, d)


@shared
def supplier(s: SparkSession, d: str) -> DataFrame:
    return P.supplier_months(s, d)


@shared
def nation_days(s: SparkSession, d: str) -> DataFrame:
    return P.nation_days(s, d)


@shared
def region_days(s: SparkSession, d: str) -> DataFrame:
    return P.region_days(s, d)


@shared
def market(s: SparkSession, d: str) -> DataFrame:
    return P.market_panel(s, d)


@shared
def benchmark(s: SparkSession, d: str) -> DataFrame:
    return P.benchmark_months(s, d)


@shared
def membership(s: SparkSession, d: str) -> DataFrame:
    return P.supplier_membership(s, d, supplier(s, d))


def feed(s: SparkSession, d: str) -> DataFrame:
    return P.vendor_feed(market(s, d))


@shared
def brand_dataset(s, d) -> DataFrame:
    return T.labelled_dataset(closes(brand(s, d)), benchmark(s, d))


@shared
def supplier_dataset(s, d) -> DataFrame:
    return T.labelled_dataset(closes(supplier(s, d)), benchmark(s, d))


@shared
def brand_scores(s, d) -> DataFrame:
    return R.baseline_score(brand_dataset(s, d))


@shared
def supplier_scores(s, d) -> DataFrame:
    return R.baseline_score(supplier_dataset(s, d))


@shared
def suite_positions(s, d) -> DataFrame:
    months = closes(brand(s, d))
    return (
        L.momentum_positions(months, 3, 0, 5, "momentum_3m_equal")
        .unionByName(L.momentum_positions(months, 12, 1, 5, "momentum_12_1_equal"))
        .unionByName(L.score_positions(brand_scores(s, d), 5, "ml"))
    )


def suite_candidates(s, d, depth: int) -> DataFrame:
    """Names of the momentum rankings down to ``depth`` per signal, with outcomes; the score is re-ranked, not shifted."""
    months = closes(brand(s, d))
    return L.momentum_selection(months, 3, 0, depth, "momentum_3m_equal").unionByName(
        L.momentum_selection(months, 12, 1, depth, "momentum_12_1_equal"))


@shared
def suite_ledger(s, d) -> DataFrame:
    # The last month is cut short: a name that does not trade in it leaves its period NULL.
    return L.periods(suite_positions(s, d), strict=False)


@shared
def bench(s, d) -> DataFrame:
    return T.benchmark_returns(benchmark(s, d))


def returns(s, d) -> DataFrame:
    own = L.net_returns(suite_ledger(s, d)).where(F.col("ret").isNotNull())
    base = bench(s, d).where(F.col("bench").isNotNull()).select(
        F.lit("benchmark").alias("strategy"), "date", F.col("bench").alias("ret")
    )
    return own.unionByName(base)


@shared
def common(s, d) -> DataFrame:
    return M.common_period(returns(s, d), len(STRATEGIES) + 1)


def common_dates(s, d) -> DataFrame:
    return common(s, d).select("date").distinct()


def common_positions(s, d) -> DataFrame:
    return suite_positions(s, d).join(F.broadcast(common_dates(s, d)), "date", "left_semi")


def common_ledger(s, d) -> DataFrame:
    return suite_ledger(s, d).join(F.broadcast(common_dates(s, d)), "date", "left_semi")


def removals(s, d) -> DataFrame:
    return N.single_removals(STRATEGIES, brand(s, d))


@shared
def leave_one_out_ledger(s, d) -> DataFrame:
    """Ledgers of the removals that change a date, the score re-ranked in each reduced universe."""
    return N.rerun_ledger(suite_positions(s, d), suite_candidates(s, d, 6), brand_dataset(s, d), removals(s, d), "removed_ticker", 5, 1)


def contributor_sets(s, d) -> DataFrame:
    """The top one, two and three contributors of each strategy."""
    return A.removal_sets(A.contribution_ranks(common_positions(s, d)))


@shared
def removal_ledger(s, d) -> DataFrame:
    sets = contributor_sets(s, d).select("strategy", "scenario", "removed")
    again = N.rerun_ledger(suite_positions(s, d), suite_candidates(s, d, 8), brand_dataset(s, d), sets, "scenario", 5, 3)
    return N.every_ledger(again, suite_ledger(s, d), sets, "scenario")


@shared
def delayed_ledger(s, d) -> DataFrame:
    moved = L.delayed_positions(suite_positions(s, d), closes(brand(s, d)))
    return L.periods(moved.drop("execution_date"), strict=False)
