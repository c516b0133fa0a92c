"""Robustness studies: every what-if is a key column of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import annual_ratio, attach, share_if
from stratapanel.operators.metrics import evaluate
from stratapanel.scale import even_width

BOOTSTRAP_METRICS = (
    "annual_return", "annual_volatility", "sharpe", "annual_active_return",
    "tracking_error", "information_ratio", "max_drawdown",
)
PERCENTILES = ((0.025, "p2_5"), (0.05, "p5"), (0.25, "p25"), (0.75, "p75"), (0.95, "p95"), (0.975, "p97_5"))


def cost_sensitivity(costed: DataFrame, bench: DataFrame) -> DataFrame:
    """Metrics per (strategy, cost level) plus the benchmark's own Sharpe."""
    paired = costed.withColumn("ret", F.col("net_return")).join(F.broadcast(bench), "date")
    own = bench.where(F.col("bench").isNotNull()).join(
        F.broadcast(paired.select("date").distinct()), "date", "left_semi"
    ).agg(annual_ratio(F.avg("bench"), F.stddev_samp("bench")).alias("benchmark_sharpe"))
    extra = {
        "average_turnover": F.avg("turnover"), "total_transaction_cost": F.sum("transaction_cost"),
    }
    return attach(evaluate(paired, ("strategy", "cost_bps"), extra=extra), own)


def cost_breakpoints(details: DataFrame) -> DataFrame:
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("cost_bps"))).cast("string"), F.lit("not_reached"))
    return details.groupBy("strategy").agg(
        first(F.col("annual_active_return") <= 0).alias("first_cost_bps_active_return_nonpositive"),
        first(F.col("sharpe") <= F.col("benchmark_sharpe")).alias("first_cost_bps_sharpe_at_or_below_benchmark"),
    )


def aligned_pair(first: DataFrame, second: DataFrame, bench: DataFrame) -> DataFrame:
    """(strategy, date, first, second, bench) where all three exist."""
    a = first.select("strategy", "date", F.col("ret").alias("first"))
    b = second.select("strategy", "date", F.col("ret").alias("second"))
    return a.join(b, ["strategy", "date"]).join(F.broadcast(bench.select("date", "bench")), "date").dropna(
        subset=["first", "second", "bench"]
    )


def execution_sensitivity(pairs: DataFrame) -> DataFrame:
    """Same close against one-period delay on identical dates, with deltas."""
    long = pairs.select("strategy", "date", "bench", F.inline(F.array(
        F.struct(F.lit("same_close").alias("execution_scenario"), F.col("first").alias("ret")),
        F.struct(F.lit("one_period_delay").alias("execution_scenario"), F.col("second").alias("ret")),
    )))
    m = evaluate(long, ("strategy", "execution_scenario"))
    names = ("annual_return", "sharpe", "information_ratio")
    base = m.where(F.col("execution_scenario") == "same_close").select(
        "strategy", *[F.col(n).alias(f"_{n}") for n in names]
    )
    return m.join(F.broadcast(base), "strategy").select(
        *m.columns, *[(F.col(n) - F.col(f"_{n}")).alias(f"{n}_delta") for n in names]
    )


def leave_one_out_details(reruns: DataFrame, baseline: DataFrame, bench: DataFrame, tickers: DataFrame) -> DataFrame:
    """Metrics per (strategy, removed ticker) with deltas to the baseline.

    ``reruns`` holds the re-run scenarios only; a removal that changes nothing
    takes the baseline metrics, so work does not grow with universe squared.
    """
    b = baseline.select("strategy", "date", F.col("ret").alias("_base"))
    rows = reruns.join(b, ["strategy", "date"]).join(F.broadcast(bench), "date").dropna(subset=["ret", "_base", "bench"])
    names = ("annual_return", "sharpe", "max_drawdown", "information_ratio")
    # A re-run is compared with the baseline on its own dates: both paths of a
    # scenario go through one aggregation.
    both = evaluate(
        rows.select("strategy", "removed_ticker", "date", "bench", F.inline(F.array(
            F.struct(F.lit(True).alias("_new"), F.col("ret")), F.struct(F.lit(False).alias("_new"), F.col("_base").alias("ret")),
        ))), ("strategy", "removed_ticker", "_new"),
    )
    keep = [c for c in both.columns if c not in ("strategy", "removed_ticker", "_new")]
    own = lambda n, new: F.max(F.when(F.col("_new") == new, F.col(n)))
    again = both.groupBy("strategy", "removed_ticker").agg(
        *[own(n, True).alias(n) for n in keep], *[own(n, False).alias(f"_pair_{n}") for n in names],
    )
    same = evaluate(baseline.join(F.broadcast(bench), "date"), ("strategy",))
    base = same.select("strategy", *[F.col(n).alias(f"_own_{n}") for n in keep])
    grid = _strategy_tickers(base, tickers)
    out = grid.join(again.withColumn("_hit", F.lit(True)), ["strategy", "removed_ticker"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    value = {n: F.when(hit, F.col(n)).otherwise(F.col(f"_own_{n}")) for n in keep}
    before = {n: F.when(hit, F.col(f"_pair_{n}")).otherwise(F.col(f"_own_{n}")) for n in names}
    return out.select(
        "strategy", "removed_ticker", *[v.alias(n) for n, v in value.items()],
        *[v.alias(f"baseline_{n}") for n, v in before.items()],
        *[(value[n] - before[n]).alias(f"{n}_delta") for n in names],
    )


def _strategy_tickers(base: DataFrame, tickers: DataFrame) -> DataFrame:
    """Every ticker with each strategy's baseline row: one short array exploded."""
    rows = base.agg(F.collect_list(F.struct(*base.columns))).scalar()
    return tickers.select(F.col("ticker").alias("removed_ticker")).distinct().withColumn("_b", rows).select(
        "removed_ticker", F.inline("_b")
    )


def leave_one_out_summary(details: DataFrame) -> DataFrame:
    who = lambda c: F.struct(c, "removed_ticker")
    return details.groupBy("strategy").agg(
        F.min_by("baseline_sharpe", "removed_ticker").alias("baseline_sharpe"),
        F.avg("sharpe").alias("mean_leave_one_out_sharpe"), F.stddev_samp("sharpe").alias("std_leave_one_out_sharpe"),
        F.min("sharpe").alias("minimum_leave_one_out_sharpe"), F.max("sharpe").alias("maximum_leave_one_out_sharpe"),
        F.min_by("removed_ticker", who("sharpe")).alias("worst_removed_ticker_by_sharpe"),
        F.min_by("removed_ticker", F.struct(-F.col("sharpe"), "removed_ticker")).alias("best_removed_ticker_by_sharpe"),
        F.min_by("removed_ticker", who("annual_return_delta")).alias("largest_annual_return_drop_ticker"),
        F.min_by("removed_ticker", who("information_ratio_delta")).alias("largest_information_ratio_drop_ticker"),
    )


def block_start(seed: Column, sim: Column, block: Column, n: Column) -> Column:
    """Uniform start index from a hash of (seed, simulation, block)."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), sim.cast("string"), block.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), n)


def moving_block_indices(sims: DataFrame, n: Column, block_size: Column, seed: Column) -> DataFrame:
    """Adds ``indices``: circular moving blocks cut to exactly ``n`` entries.

    ``sims`` has one row per simulation with columns ``sim`` and what ``n``,
    ``block_size`` and ``seed`` refer to; arrays hold ``n`` (the calendar) items.
    """
    blocks = F.sequence(F.lit(0), F.ceil(n / block_size).cast("int") - 1)
    offsets = F.sequence(F.lit(0), block_size.cast("int") - 1)
    starts = F.transform(blocks, lambda b: block_start(seed, F.col("sim"), b, n))
    whole = F.flatten(F.transform(F.col("_starts"), lambda s: F.transform(offsets, lambda o: F.pmod(s + o, n))))
    return sims.withColumn("_starts", starts).withColumn("indices", F.slice(whole, 1, n.cast("int"))).drop("_starts")


def bootstrap_paths(common: DataFrame, simulations: int = 5000, block_sizes=(6,), seed: int = 42, benchmark="benchmark") -> DataFrame:
    """Metrics per (strategy, block size, simulation) in one map-only pass.

    Each strategy's history is one row of two arrays (calendar-bounded).  Every
    simulation is a row carrying them, folded in place: nothing is shuffled
    after the explode, and rows scale out with simulations x strategies.
    """
    bench = common.where(F.col("strategy") == benchmark).select("date", F.col("ret").alias("b"))
    own = common.where(F.col("strategy") != benchmark).join(F.broadcast(bench), "date").dropna(subset=["ret", "b"])
    history = own.groupBy("strategy").agg(
        F.sort_array(F.collect_list(F.struct("date", F.col("ret").alias("s"), "b"))).alias("_h"),
        F.count(F.lit(1)).alias("n"),
    )
    # Each strategy has its own stream, in name order.
    offset = F.row_number().over(Window.orderBy("strategy")) - 1
    # Small in, much work: a fixed width keeps the simulations spread out.
    width = max(even_width(common), common.sparkSession.sparkContext.defaultParallelism)
    chunks = max(1, min(simulations, 4096) // 64)
    rows = (
        history.withColumn("seed", F.lit(seed) + offset)
        .withColumn("block_size", F.explode(F.array(*[F.lit(b) for b in block_sizes])))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .repartition(width, "strategy", "block_size", "_chunk")
        .withColumn("sim", F.explode(F.filter(
            F.sequence(F.lit(0), F.lit(-(-simulations // chunks) - 1)),
            lambda i: i * chunks + F.col("_chunk") < simulations,
        )))
        .withColumn("sim", F.col("sim") * chunks + F.col("_chunk"))
    )
    drawn = moving_block_indices(rows, F.col("n"), F.col("block_size"), F.col("seed"))
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(k) for k in ("s", "ss", "b", "bb", "a", "aa")],
                     F.lit(1.0).alias("w"), F.lit(1.0).alias("bw"), F.lit(1.0).alias("p"), zero.alias("d"))

    def step(acc, i):
        x = F.element_at(F.col("_h"), (i + 1).cast("int"))
        s, b = x["s"], x["b"]
        w = acc["w"] * (1.0 + s)
        p = F.greatest(acc["p"], w)
        return F.struct(
            (acc["s"] + s).alias("s"), (acc["ss"] + s * s).alias("ss"), (acc["b"] + b).alias("b"),
            (acc["bb"] + b * b).alias("bb"), (acc["a"] + (s - b)).alias("a"),
            (acc["aa"] + (s - b) * (s - b)).alias("aa"), w.alias("w"), (acc["bw"] * (1.0 + b)).alias("bw"),
            p.alias("p"), F.least(acc["d"], w / p - 1.0).alias("d"),
        )

    folded = drawn.select(
        "strategy", "block_size", "sim", "n", F.aggregate("indices", start, step).alias("f")
    )
    n = F.col("n")

    def std(total, squares):
        return F.sqrt(F.greatest(zero, (F.col(squares) - F.col(total) * F.col(total) / n) / (n - 1)))

    s_std, b_std, a_std = std("f.s", "f.ss"), std("f.b", "f.bb"), std("f.a", "f.aa")
    root = 12**0.5
    return folded.select(
        "strategy", "block_size", "sim",
        (F.pow("f.w", F.lit(12.0) / n) - 1.0).alias("annual_return"), (s_std * root).alias("annual_volatility"),
        annual_ratio(F.col("f.s") / n, s_std).alias("sharpe"), (F.col("f.a") / n * 12).alias("annual_active_return"),
        (a_std * root).alias("tracking_error"), annual_ratio(F.col("f.a") / n, a_std).alias("information_ratio"),
        F.col("f.d").alias("max_drawdown"), (F.pow("f.bw", F.lit(12.0) / n) - 1.0).alias("benchmark_annual_return"),
        annual_ratio(F.col("f.b") / n, b_std).alias("benchmark_sharpe"),
    )


def bootstrap_summary(paths: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Distribution of the simulated metrics; with ``observed`` (strategy, sharpe) also the realised Sharpe beside it."""
    q = lambda p: F.percentile("sharpe", F.lit(p))
    out = paths.groupBy("strategy", "block_size").agg(
        F.count(F.lit(1)).alias("simulations"), F.median("sharpe").alias("median_sharpe"),
        q(0.05).alias("sharpe_p5"), q(0.95).alias("sharpe_p95"),
        share_if(F.col("annual_return") > F.col("benchmark_annual_return")).alias("p_annual_return_above_benchmark"),
        share_if(F.col("annual_active_return") > 0).alias("p_active_return_positive"),
        share_if(F.col("sharpe") > F.col("benchmark_sharpe")).alias("p_sharpe_above_benchmark"),
        share_if(F.col("information_ratio") > 0).alias("p_information_ratio_positive"),
        share_if(F.col("sharpe") > 1).alias("p_sharpe_above_1"),
    )
    if observed is None:
        return out
    return out.join(F.broadcast(observed.select("strategy", F.col("sharpe").alias("observed_sharpe"))), "strategy", "left")


def bootstrap_intervals(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """Percentile intervals per (strategy, metric) beside the observed value."""
    long = paths.unpivot(["strategy", "block_size"], list(BOOTSTRAP_METRICS), "metric", "x")
    agg = long.groupBy("strategy", "block_size", "metric").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.percentile("x", F.array(F.lit(0.5), *[F.lit(p) for p, _ in PERCENTILES])).alias("_q"),
    )
    seen = observed.select("strategy", *BOOTSTRAP_METRICS).unpivot(
        "strategy", list(BOOTSTRAP_METRICS), "metric", "observed"
    )
    return agg.join(F.broadcast(seen), ["strategy", "metric"]).select(
        "strategy", "block_size", "metric", "observed", "mean", F.col("_q")[0].alias("median"), "std",
        *[F.col("_q")[i].alias(name) for i, (_, name) in enumerate(PERCENTILES, 1)],
    )


def scorecard(
    baseline: DataFrame, loo: DataFrame, subperiod: DataFrame, costs: DataFrame, execution: DataFrame,
    bootstrap: DataFrame, contribution: DataFrame, outliers: DataFrame, rolling: DataFrame, optimizer: DataFrame,
) -> DataFrame:
    """One row per strategy from nine summaries (a few rows each)."""
    def part(df, **names):
        return df.select("strategy", *[F.col(c).alias(n) for n, c in names.items()])

    parts = [
        part(loo, worst_leave_one_out_sharpe="minimum_leave_one_out_sharpe", leave_one_out_sharpe_std="std_leave_one_out_sharpe"),
        part(subperiod, positive_active_subperiod_ratio="positive_active_return_ratio"),
        part(costs.where(F.col("cost_bps") == 100), sharpe_100bps="sharpe"),
        part(execution.where(F.col("execution_scenario") == "one_period_delay"),
             delayed_execution_sharpe="sharpe", delayed_execution_sharpe_delta="sharpe_delta"),
        part(bootstrap, bootstrap_p_active_return_positive="p_active_return_positive",
             bootstrap_p_sharpe_above_benchmark="p_sharpe_above_benchmark",
             bootstrap_sharpe_p5="sharpe_p5", bootstrap_sharpe_median="median_sharpe"),
        part(contribution, top1_contribution_share="top_1_share", top3_contribution_share="top_3_share"),
        part(outliers, best3_month_arithmetic_share="best_3_month_arithmetic_share"),
        part(rolling, rolling_24m_positive_active_ratio="positive_active_return_ratio",
             rolling_24m_sharpe_above_benchmark_ratio="sharpe_above_benchmark_ratio"),
        part(optimizer, average_effective_holdings="average_effective_holdings", average_max_weight="average_max_weight"),
    ]
    out = part(baseline, baseline_sharpe="sharpe", baseline_information_ratio="information_ratio")
    for p in parts:
        out = out.join(F.broadcast(p), "strategy", "left")
    return out
