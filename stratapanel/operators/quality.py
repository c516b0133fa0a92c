"""Cleansing, contract checks and data-quality flags.

Checks return the offending rows; ``require`` turns a non-empty result into an
error for strict callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import attach, checked, joined, reasons
from stratapanel.operators.timeseries import FEATURES

PANEL_COLUMNS = (
    "date", "canonical_ticker", "provider_ticker", "adjusted_close", "raw_close",
    "volume", "dividends", "stock_splits",
)
NUMERIC = PANEL_COLUMNS[3:]
FORBIDDEN_LIVE_COLUMNS = ("target", "target_date", "future_return", "benchmark_return")
# Fixed reason codes that mean "price not ready".
PRICE_FAILURE_CODES = (
    "HAS_PRICE_HISTORY", "MISSING_PRICE", "SUFFICIENT_HISTORY",
    "INSUFFICIENT_LOOKBACK", "CURRENT_PRICE_AVAILABLE", "STALE_PRICE",
)
INF = float("inf")


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def require(violations: DataFrame, message: str) -> None:
    """Raise when any offending row exists (one row is fetched)."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def normalize_panel(panel: DataFrame) -> DataFrame:
    """Contract columns, dates, upper-case ids, numbers (unreadable -> NULL)."""
    require_columns(panel, *PANEL_COLUMNS)
    return panel.select(
        F.to_date("date").alias("date"),
        F.upper(F.col("canonical_ticker").cast("string")).alias("canonical_ticker"),
        F.upper(F.col("provider_ticker").cast("string")).alias("provider_ticker"),
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in NUMERIC],
    )


def provider_symbol(canonical: Column, override: Column | None = None) -> Column:
    plain = F.replace(F.upper(F.trim(canonical)), F.lit("."), F.lit("-"))
    return F.coalesce(override, plain) if override is not None else plain


def ticker_mapping(tickers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(canonical_ticker, provider_ticker); overrides win over the dot rule."""
    base = tickers.select(F.upper(F.trim("ticker")).alias("canonical_ticker")).distinct()
    if overrides is None:
        return base.withColumn("provider_ticker", provider_symbol(F.col("canonical_ticker")))
    return base.join(overrides, "canonical_ticker", "left").select(
        "canonical_ticker", provider_symbol(F.col("canonical_ticker"), F.col("override")).alias("provider_ticker")
    )


def mapping_collisions(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("provider_ticker").agg(
        F.count_distinct("canonical_ticker").alias("canonicals")
    ).where("canonicals > 1")


def _known(mapping: DataFrame) -> DataFrame:
    return mapping.join(mapping_collisions(mapping), "provider_ticker", "left_anti")


def lookup_violations(observations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(provider_ticker, n): symbols that the mapping lacks or gives to several canonical tickers."""
    symbols = observations.select(F.upper(F.trim("provider_ticker")).alias("provider_ticker"))
    return symbols.join(_known(mapping), "provider_ticker", "left_anti").groupBy("provider_ticker").agg(F.count(F.lit(1)).alias("n"))


def to_canonical(observations: DataFrame, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """Reverse lookup on the provider symbol.

    ``strict`` fails the job on an absent or ambiguous symbol; otherwise such
    rows are left out (``lookup_violations`` lists them).
    """
    found = observations.withColumn("provider_ticker", F.upper(F.trim("provider_ticker"))).join(_known(mapping), "provider_ticker")
    return checked(found, lookup_violations(observations, mapping), "Provider ticker is absent or ambiguous") if strict else found


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_date_flags(panel: DataFrame) -> DataFrame:
    return _flag(duplicates(panel, "canonical_ticker", "date"), F.col("date"), "DUPLICATE_DATE", None, "error")


def non_monotonic_flags(panel: DataFrame) -> DataFrame:
    """Tickers whose dates go backwards in arrival order."""
    w = Window.partitionBy("canonical_ticker").orderBy("ingest_seq")
    bad = panel.withColumn("_p", F.lag("date").over(w)).where(F.col("_p") > F.col("date"))
    return _flag(
        bad.select("canonical_ticker").distinct(), F.lit(None).cast("date"), "NON_MONOTONIC_DATES", None, "error"
    )


def _flag(df: DataFrame, date: Column, name: str, value: Column | None, severity: str) -> DataFrame:
    return df.select(
        F.col("canonical_ticker").alias("ticker"), date.alias("date"), F.lit(name).alias("flag"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        F.lit(severity).alias("severity"),
    )


def _bad_price(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & (F.isnan(c) | (F.abs(c) == INF) | (c <= 0))


def row_flags(panel: DataFrame, requested_date: str | None = None, extreme: float = 0.50) -> DataFrame:
    """All row-level flags in one pass: price, volume, jump and future checks."""
    w = Window.partitionBy("canonical_ticker").orderBy("date", "ingest_seq")
    jump = F.try_divide(F.col("adjusted_close"), F.lag("adjusted_close").over(w)) - 1.0
    volume = F.col("volume")
    bad_volume = volume.isNotNull() & (F.isnan(volume) | (F.abs(volume) == INF) | (volume < 0))
    checks = [
        (_bad_price("adjusted_close"), "INVALID_ADJUSTED_CLOSE", F.col("adjusted_close"), "error"),
        (_bad_price("raw_close"), "INVALID_RAW_CLOSE", F.col("raw_close"), "error"),
        (bad_volume, "INVALID_VOLUME", volume, "error"),
        (F.abs("_jump") > extreme, "EXTREME_ADJUSTED_RETURN", F.col("_jump"), "warning"),
    ]
    if requested_date is not None:
        late = F.col("date") > F.lit(requested_date).cast("date")
        checks.append((late, "FUTURE_OBSERVATION", F.lit(None).cast("double"), "error"))
    options = [
        F.when(c, F.struct(F.lit(name).alias("flag"), v.alias("value"), F.lit(s).alias("severity")))
        for c, name, v, s in checks
    ]
    return panel.withColumn("_jump", jump).select(
        F.col("canonical_ticker").alias("ticker"), "date",
        F.inline(F.filter(F.array(*options), lambda x: x.isNotNull())),
    )


def validate_market_panel(panel: DataFrame, requested_date: str | None = None, extreme: float = 0.50) -> DataFrame:
    """Union of every flag: (ticker, date, flag, value, severity)."""
    return (
        row_flags(panel, requested_date, extreme)
        .unionByName(duplicate_date_flags(panel))
        .unionByName(non_monotonic_flags(panel))
    )


def security_readiness(panel: DataFrame, tickers: DataFrame, resolved: Column, minimum: int = 252, stale_days: int = 3) -> DataFrame:
    c = F.col("adjusted_close")
    valid = panel.where((c > 0) & (c < INF) & (F.col("date") <= resolved))
    agg = valid.groupBy(F.col("canonical_ticker").alias("ticker")).agg(
        F.count(F.lit(1)).alias("history_observations"), F.max("date").alias("latest_price_date"),
        F.bool_or(F.col("date") == resolved).alias("_current"),
    )
    n = F.coalesce("history_observations", F.lit(0).cast("bigint"))
    stale = F.datediff(resolved, F.col("latest_price_date"))
    why = reasons(
        (n == 0, "MISSING_PRICE"), ((n > 0) & (n < minimum), "INSUFFICIENT_HISTORY"),
        ((n > 0) & (stale > stale_days), "STALE_PRICE"), ((n > 0) & ~F.col("_current"), "CURRENT_PRICE_UNAVAILABLE"),
    )
    return tickers.select("ticker").join(agg, "ticker", "left").select(
        "ticker", (F.size(why) == 0).alias("price_ready"), "latest_price_date",
        n.alias("history_observations"), stale.alias("staleness_days"), joined(why).alias("reason"),
    )


def corporate_action_flags(panel: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Reported splits and dividends, and unexplained adjustment jumps."""
    w = Window.partitionBy("canonical_ticker").orderBy("date")
    split, dividend = F.coalesce("stock_splits", F.lit(0.0)), F.coalesce("dividends", F.lit(0.0))
    jump = F.abs(F.try_divide(F.col("_ratio"), F.lag("_ratio").over(w)) - 1.0) > threshold
    options = F.array(
        F.when(split != 0, F.struct(F.lit("REPORTED_STOCK_SPLIT").alias("flag"), split.alias("value"))),
        F.when(dividend > 0, F.struct(F.lit("REPORTED_DIVIDEND").alias("flag"), dividend.alias("value"))),
        F.when(
            F.col("_jump") & (split == 0) & (dividend <= 0),
            F.struct(F.lit("UNEXPLAINED_ADJUSTMENT_RATIO_CHANGE").alias("flag"), F.col("_ratio").alias("value")),
        ),
    )
    return panel.withColumn("_ratio", F.try_divide("adjusted_close", "raw_close")).withColumn("_jump", jump).select(
        F.col("canonical_ticker").alias("ticker"), "date", F.inline(F.filter(options, lambda x: x.isNotNull()))
    )


def date_coverage(panel: DataFrame, tickers: DataFrame, requested: str) -> DataFrame:
    """(date, covered, members): distinct validly priced members per session."""
    members = tickers.agg(F.count_distinct("ticker").alias("members"))
    covered = (
        panel.where((F.col("date") <= F.lit(requested).cast("date")) & (F.col("adjusted_close") > 0))
        .join(tickers.select(F.col("ticker").alias("canonical_ticker")), "canonical_ticker", "left_semi")
        .groupBy("date").agg(F.count_distinct("canonical_ticker").alias("covered"))
    )
    return attach(covered, members)


def resolve_common_date(panel: DataFrame, tickers: DataFrame, requested: str, minimum: float = 0.95) -> DataFrame:
    """Latest session whose coverage meets ``minimum``: one row, or none."""
    if not 0 < minimum <= 1:
        raise ValueError("minimum coverage must be in (0, 1].")
    c = date_coverage(panel, tickers, requested).withColumn("_share", F.col("covered") / F.col("members"))
    return c.where(F.col("_share") >= minimum).groupBy().agg(
        F.max("date").alias("resolved_market_date"), F.max_by("_share", "date").alias("coverage_on_resolved_date"),
        F.max_by("covered", "date").alias("covered_securities"),
        F.ceil(minimum * F.max("members")).alias("required_securities"),
    ).where(F.col("resolved_market_date").isNotNull())


def acquisition_status(panel: DataFrame, mapping: DataFrame, resolved: Column | None = None) -> DataFrame:
    expected = panel.agg(F.count_distinct("date").alias("_expected"))
    agg = panel.groupBy("canonical_ticker").agg(
        F.min("date").alias("first_available_date"),
        F.max(F.when(F.col("adjusted_close").isNotNull(), F.col("date"))).alias("last_available_date"),
        F.count("adjusted_close").alias("observation_count"),
    )
    n = F.coalesce("observation_count", F.lit(0).cast("bigint"))
    late = F.lit(False) if resolved is None else F.coalesce(F.col("last_available_date") < resolved, F.lit(False))
    return attach(mapping.join(agg, "canonical_ticker", "left"), expected).select(
        "canonical_ticker", "provider_ticker", "first_available_date", "last_available_date",
        n.alias("observation_count"),
        F.coalesce(1.0 - F.try_divide(n, F.col("_expected")), F.lit(1.0)).alias("missing_ratio"),
        F.when(n == 0, "failed").when(late, "partial").otherwise("successful").alias("status"),
    )


_FIXED_WIDTH = {"double", "float", "long", "integer", "short", "byte", "boolean", "date", "timestamp", "timestamp_ntz"}


def _pick(df: DataFrame, keys: tuple[str, ...], version: str, choose) -> DataFrame:
    """One row per key by extreme version; versions are unique within a key.

    Copies of a hot key collapse in the map-side combine.  Fixed-width columns
    are picked one by one, which keeps the hash aggregation; a struct (needed
    for text) would sort every map partition first.
    """
    rest = [f for f in df.schema.fields if f.name not in keys]
    if all(f.dataType.typeName() in _FIXED_WIDTH for f in rest):
        return df.groupBy(*keys).agg(*[choose(f.name, F.col(version)).alias(f.name) for f in rest])
    names = [f.name for f in rest]
    return df.groupBy(*keys).agg(choose(F.struct(*names), F.col(version)).alias("_r")).select(*keys, "_r.*")


def keep_last(df: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Newest version per key."""
    return _pick(df, keys, version, F.max_by)


def keep_first(df: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Oldest version per key."""
    return _pick(df, keys, version, F.min_by)


def merge_incremental(existing: DataFrame, additions: DataFrame, keys=("ticker", "date"), version="version") -> DataFrame:
    return keep_last(existing.unionByName(additions), keys, version)


def load_gaps(
    requested: DataFrame, cached: DataFrame, start: str, end: str, prior_start: str | None,
    prior_end: str | None, refresh: bool = False, overlap_days: int = 10,
) -> DataFrame:
    """(ticker, gap, fetch_from, fetch_to): ranges still to be loaded."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    present = cached.groupBy("ticker").agg(F.max("date").alias("_max"), F.min("date").alias("_min"))
    known = requested.join(present, "ticker")

    def row(df, gap, a, b):
        return df.select("ticker", F.lit(gap).alias("gap"), a.alias("fetch_from"), b.alias("fetch_to"))

    parts = [row(requested.join(present, "ticker", "left_anti"), "never_loaded", lo, hi)]
    bounds = known.agg(F.min("_min").alias("_first"), F.min("_max").alias("_extend"), F.max("_max").alias("_last"))
    known = attach(known.select("ticker"), bounds)
    if prior_start is None or start < prior_start:
        stop = F.date_sub(F.col("_first") if prior_start is None else F.lit(prior_start).cast("date"), 1)
        parts.append(row(known, "earlier_prefix", lo, stop))
    if refresh:
        parts.append(row(known, "refresh", F.greatest(lo, F.date_sub("_last", overlap_days)), hi))
    elif prior_end is None or prior_end < end:
        parts.append(row(known, "extension", F.date_add("_extend", 1), hi))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("fetch_from") <= F.col("fetch_to"))


def price_violations(prices: DataFrame) -> DataFrame:
    """(date, ticker, violation) for duplicates and non-positive prices."""
    twice = duplicates(prices, "date", "ticker").select("date", "ticker", F.lit("duplicate").alias("violation"))
    low = prices.where(F.col("close") <= 0).select("date", "ticker", F.lit("non_positive").alias("violation"))
    return twice.unionByName(low)


def score_violations(scores: DataFrame) -> DataFrame:
    require_columns(scores, "date", "ticker", "ml_score", "future_return")
    return duplicates(scores, "date", "ticker")


def snapshot_bounds(panel: DataFrame, benchmark: DataFrame, cutoff: str | None = None) -> DataFrame:
    """One row ``as_of``: last date common to panel and benchmark by the cutoff."""
    def latest(df, name):
        inside = df if cutoff is None else df.where(F.col("date") <= F.lit(cutoff).cast("date"))
        return inside.agg(F.max("date").alias(name))

    return attach(latest(panel, "_p"), latest(benchmark, "_b")).select(
        F.least("_p", "_b").alias("as_of")
    )


def snapshot(panel: DataFrame, benchmark: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Panel truncated once, at the snapshot boundary."""
    bound = snapshot_bounds(panel, benchmark, cutoff).scalar()
    out = panel if cutoff is None else panel.where(F.col("date") <= F.lit(cutoff).cast("date"))
    return out.where(F.col("date") <= bound)


def future_rows(df: DataFrame, cutoff: Column, column: str = "date") -> DataFrame:
    return df.where(F.col(column) > cutoff)


def assert_no_label_columns(features: DataFrame) -> None:
    found = sorted(set(FORBIDDEN_LIVE_COLUMNS) & set(features.columns))
    if found:
        raise ValueError(f"Evaluation-only columns in live features: {found}")


def snapshot_eligibility(requested: DataFrame, panel: DataFrame, cutoff: Column, stale_days: int = 7) -> DataFrame:
    """Eligibility with reason missing_ticker, missing_price or stale_price."""
    agg = panel.groupBy("ticker").agg(F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("latest_price_date"))
    stale = F.datediff(cutoff, F.col("latest_price_date"))
    reason = (
        F.when(F.col("_seen").isNull(), "missing_ticker")
        .when(F.col("latest_price_date").isNull(), "missing_price")
        .when(stale > stale_days, "stale_price")
    )
    return requested.select("ticker").join(agg.withColumn("_seen", F.lit(True)), "ticker", "left").select(
        "ticker", F.lit(True).alias("requested"), reason.isNull().alias("eligible"), "latest_price_date",
        stale.alias("staleness_days"),
        F.when(reason.isNull(), "eligible").otherwise("ineligible").alias("status"), reason.alias("reason"),
    )


def latest_features(features: DataFrame, as_of: Column) -> DataFrame:
    """Last feature row per ticker at or before a date."""
    return keep_last(features.where(F.col("date") <= as_of), ("ticker",), "date")


def screen_investability(
    members: DataFrame, panel: DataFrame, features: DataFrame | None, cutoff: Column,
    minimum: int = 126, stale_days: int = 7, required=FEATURES,
) -> DataFrame:
    history = panel.where((F.col("date") <= cutoff) & F.col("close").isNotNull()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"), F.max("date").alias("latest_price_date")
    )
    out = members.select("ticker").join(history, "ticker", "left")
    if features is None:
        ready = F.lit(True)
    else:
        complete = F.lit(True)
        for f in required:
            complete = complete & F.col(f).isNotNull()
        out = out.join(latest_features(features, cutoff).select("ticker", complete.alias("_ready")), "ticker", "left")
        ready = F.coalesce("_ready", F.lit(False))
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    stale = F.datediff(cutoff, F.col("latest_price_date"))
    old = (n > 0) & (stale > stale_days)
    why = reasons(
        (n == 0, "HAS_PRICE_HISTORY"), (n == 0, "MISSING_PRICE"),
        ((n > 0) & (n < minimum), "SUFFICIENT_HISTORY"), ((n > 0) & (n < minimum), "INSUFFICIENT_LOOKBACK"),
        (old, "CURRENT_PRICE_AVAILABLE"), (old, "STALE_PRICE"), (~ready, "FEATURES_AVAILABLE"),
    )
    return out.select(
        "ticker", F.lit(True).alias("index_member"), (F.size(why) == 0).alias("eligible"), "latest_price_date",
        n.alias("history_observations"), stale.alias("staleness_days"), ready.alias("feature_ready"),
        joined(why).alias("reason"),
    )


def current_features(requested: DataFrame, dataset: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Feature row at the last signal date with validity and reason."""
    last = dataset.agg(F.max("date").alias("signal_date"))
    current = dataset.where(F.col("date") == last.scalar()).select("ticker", *FEATURES)
    complete = F.lit(True)
    for f in FEATURES:
        complete = complete & F.col(f).isNotNull()
    valid = F.coalesce("eligible", F.lit(False)) & complete
    known = requested.select("ticker").join(current, "ticker", "left").join(
        eligibility.select("ticker", "eligible", "reason"), "ticker", "left"
    )
    return (
        attach(known, last)
        .select(
            "ticker", "signal_date", *FEATURES, valid.alias("feature_valid"),
            F.when(~valid, F.coalesce("reason", F.lit("insufficient_or_missing_feature_history"))).alias("invalid_reason"),
        )
    )


def feature_missingness(features: DataFrame, tickers: DataFrame, signal_date: Column) -> DataFrame:
    """Valid and missing members per feature at a date."""
    at = tickers.select("ticker").join(features.where(F.col("date") == signal_date), "ticker", "left")
    total = F.count(F.lit(1))
    options = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.count(f).alias("valid_count"), (total - F.count(f)).alias("missing_count"),
                 (F.count(f) / total).alias("coverage_pct"))
        for f in FEATURES
    ])
    return at.agg(options.alias("_r")).select(F.inline("_r"))


def feature_coverage(dataset: DataFrame, members: DataFrame, monthly: DataFrame) -> DataFrame:
    """Per month: members with a price and with complete features."""
    total = members.agg(F.count_distinct("ticker").alias("universe_members"))
    priced = monthly.where(F.col("close").isNotNull()).join(members.select("ticker"), "ticker", "left_semi")
    counts = priced.groupBy("date").agg(F.count(F.lit(1)).alias("_a"))
    return attach(_coverage(monthly.select("date").distinct(), counts, dataset), total).select(
        "date", "universe_members", "eligible_members", "feature_complete", "feature_missing", "prediction_eligible"
    )


def _coverage(dates: DataFrame, available: DataFrame, dataset: DataFrame) -> DataFrame:
    complete = dataset.groupBy("date").agg(F.count_distinct("ticker").alias("_c"))
    zero = F.lit(0).cast("bigint")
    a, c = F.coalesce("_a", zero), F.coalesce("_c", zero)
    return dates.join(available, "date", "left").join(complete, "date", "left").select(
        "date", a.alias("eligible_members"), c.alias("feature_complete"),
        F.greatest(zero, a - c).alias("feature_missing"), c.alias("prediction_eligible"),
        *[x for x in available.columns if x not in ("date", "_a")],
    )


def point_in_time_coverage(dataset: DataFrame, membership: DataFrame, monthly: DataFrame) -> DataFrame:
    """The same with the members active in each month.

    Interval ends become +1 / -1 events on the months, so the membership is
    never paired with every date; the priced side is an equi join on ticker.
    """
    from stratapanel.operators.universe import interval_join

    months = monthly.select("date").distinct()
    ends = membership.select("ticker", F.inline(F.array(
        F.struct(F.col("effective_from").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("effective_to").alias("at"), F.lit(-1).alias("step")),
    ))).where(F.col("at").isNotNull()).groupBy("at").agg(F.sum("step").alias("step"))
    w = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    timeline = ends.unionByName(months.select(F.col("date").alias("at"), F.lit(0).cast("bigint").alias("step")))
    # One row per distinct boundary date or month: bounded by the calendar.
    active = timeline.withColumn("universe_members", F.sum("step").over(w)).select(
        F.col("at").alias("date"), "universe_members"
    ).distinct().join(F.broadcast(months), "date", "left_semi")
    priced = interval_join(monthly.where(F.col("close").isNotNull()).select("date", "ticker"), membership)
    counts = priced.groupBy("date").agg(F.count(F.lit(1)).alias("_a"))
    return _coverage(months, counts, dataset).join(F.broadcast(active), "date", "left")


def ticker_feature_diagnostics(dataset: DataFrame, members: DataFrame, prices: DataFrame) -> DataFrame:
    expected = dataset.agg(F.count_distinct("date").alias("_e"))
    zero = F.lit(0).cast("bigint")
    rows = dataset.groupBy("ticker").agg(F.count(F.lit(1)).alias("_c"))
    seen = prices.groupBy("ticker").agg(F.count("close").alias("_p"))
    c = F.coalesce("_c", zero)
    return attach(members.select("ticker").join(seen, "ticker", "left").join(rows, "ticker", "left"), expected).select(
        "ticker", F.coalesce("_p", zero).alias("price_observations"), c.alias("feature_complete_rows"),
        F.greatest(zero, F.col("_e") - c).alias("missing_feature_rows_vs_panel"),
    )


def dataset_summary(dataset: DataFrame, scores: DataFrame) -> DataFrame:
    per_date = dataset.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("total_rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.avg("n").alias("average_rows_per_date"), F.min("n").alias("minimum_rows_per_date"),
        F.max("n").alias("maximum_rows_per_date"),
    )
    cells = sum((F.count(f) for f in FEATURES[1:]), F.count(FEATURES[0]))
    overall = dataset.agg(
        F.count_distinct("ticker").alias("number_of_securities"),
        F.avg(F.col("target").cast("double")).alias("positive_target_fraction"),
        (1.0 - F.try_divide(cells, F.count(F.lit(1)) * len(FEATURES))).alias("missing_feature_rate"),
    )
    predicted = scores.agg(
        F.count(F.lit(1)).alias("prediction_rows"), F.count_distinct("date").alias("prediction_dates")
    )
    return attach(attach(per_date, overall), predicted)


def readiness_funnel(eligibility: DataFrame, scored: DataFrame) -> DataFrame:
    """members -> price ready -> feature ready -> scored."""
    codes = F.array(*[F.lit(c) for c in PRICE_FAILURE_CODES])
    ready = ~F.arrays_overlap(F.split(F.coalesce("reason", F.lit("")), "[|]"), codes)
    agg = eligibility.agg(
        F.count(F.lit(1)).alias("universe_members"), F.count(F.when(ready, 1)).alias("price_ready"),
        F.count(F.when(ready & F.col("feature_ready"), 1)).alias("feature_ready"),
        F.count(F.when(~F.col("eligible"), 1)).alias("rejected"),
    )
    return attach(agg, scored.agg(F.count(F.lit(1)).alias("prediction_ready"))).withColumn(
        "coverage_pct", F.col("prediction_ready") / F.col("universe_members")
    )
