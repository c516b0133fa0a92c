"""Point-in-time universes: interval, as-of, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratapanel.functions.columns import attach, joined
from stratapanel.operators.quality import duplicates, require_columns
from stratapanel.operators.timeseries import calendar

MEMBERSHIP_COLUMNS = (
    "index_name", "ticker", "company_name", "sector", "industry",
    "effective_from", "effective_to", "source", "source_date",
)
UNAVAILABLE = "POINT_IN_TIME_MEMBERSHIP_UNAVAILABLE"


def active_at(date: Column) -> Column:
    """Half-open interval test; a NULL end is open."""
    return (F.col("effective_from") <= date) & (F.col("effective_to").isNull() | (F.col("effective_to") > date))


def _refused(bad: Column, message: str, column: str) -> Column:
    """``column``, failing the job where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.concat(F.lit(message), F.coalesce(F.col("ticker"), F.lit("NULL"))))).otherwise(F.col(column)).alias(column)


#: Widths in days of the calendar's aligned buckets; each is a multiple of the one before.
BUCKET_DAYS = (16, 256, 4096)


def _pieces(first: Column, last: Column, level: int = 0) -> Column:
    """Array of (level, bucket) that covers the day numbers ``first`` to ``last`` (both included) with aligned buckets.

    Wide buckets that lie inside, and narrower ones at both ends; the narrowest
    may reach over an end.  The pieces never overlap.
    """
    width = BUCKET_DAYS[level]
    low, high = F.floor(first / width), F.floor(last / width)
    run = lambda a, b: F.when(a <= b, F.transform(F.sequence(F.least(a, b), b), lambda k: F.struct(F.lit(level).alias("level"), k.alias("bucket")))).otherwise(
        F.filter(F.array(F.struct(F.lit(level).alias("level"), a.alias("bucket"))), lambda x: F.lit(False)))
    if level + 1 == len(BUCKET_DAYS):
        return run(low, high)
    per = BUCKET_DAYS[level + 1] // width
    # Whole wider buckets between the two ends.
    up, down = F.ceil(low / per), F.floor((high + 1) / per) - 1
    ends = F.concat(run(low, up * per - 1), run((down + 1) * per, high))
    inner = _pieces(up * per * width, (down + 1) * per * width - 1, level + 1)
    return F.when(up <= down, F.concat(ends, inner)).otherwise(run(low, high))


def interval_join(dataset: DataFrame, membership: DataFrame, *columns: str, strict: bool = True) -> DataFrame:
    """Rows whose (ticker, date) lies in a membership interval.

    An equi join on (ticker, level, bucket): an interval is covered by aligned
    calendar buckets of a few widths, a row lies in one bucket of each, and an
    interval meets a row in one piece only.  So a ticker with many intervals is
    split by time, and rows are compared with the intervals near them.
    ``strict`` fails the job where two intervals of a ticker overlap, as a row
    would come out twice.
    """
    spans = membership.select("ticker", "effective_from", "effective_to", *columns)
    if strict:
        later = F.lead("effective_from").over(Window.partitionBy("ticker").orderBy("effective_from"))
        spans = spans.withColumn("_later", later)
        bad = F.col("_later") < F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
        spans = spans.select("ticker", _refused(bad, "Overlapping membership of ", "effective_from"), "effective_to", *columns)
    # Open and long intervals are cut at the dates that ask.
    asked = dataset.agg(F.min(F.unix_date("date")).cast("bigint").alias("_low"), F.max(F.unix_date("date")).cast("bigint").alias("_high"))
    spans = attach(spans, asked)
    first = F.greatest(F.unix_date("effective_from").cast("bigint"), F.col("_low"))
    last = F.least(F.coalesce(F.unix_date("effective_to").cast("bigint") - 1, F.col("_high")), F.col("_high"))
    spans = spans.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    spans = spans.select("ticker", "effective_from", "effective_to", *columns, F.inline(_pieces(F.col("_first"), F.col("_last"))))
    day = F.unix_date("date")
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(day / w).cast("bigint").alias("bucket")) for i, w in enumerate(BUCKET_DAYS)])
    rows = dataset.select("*", F.inline(keys))
    return rows.join(spans, ["ticker", "level", "bucket"]).where(active_at(F.col("date"))).drop("effective_from", "effective_to", "level", "bucket")


def overlap_violations(dataset: DataFrame, membership: DataFrame) -> DataFrame:
    """(date, ticker) pairs covered by more than one interval."""
    return duplicates(interval_join(dataset, membership, strict=False), "date", "ticker")


def members_at(membership: DataFrame, date: str) -> DataFrame:
    return membership.where(active_at(F.lit(date).cast("date")))


def point_in_time_members(membership: DataFrame, date: str, current: DataFrame | None = None, required: bool = False) -> DataFrame:
    """Members at a date: dated records first, else current-only members.

    ``verified`` tells which; an uncovered date fails when ``required`` is set or
    when the current list was retrieved later than the date.
    """
    dated = members_at(membership, date).withColumn("verified", F.lit(True))
    if not dated.limit(1).collect():
        if required or current is None:
            raise ValueError(f"{UNAVAILABLE}: no dated membership covers {date}.")
        late = current.where(F.col("source_date") > F.lit(date).cast("date")).limit(1).collect()
        if late:
            raise ValueError(f"{UNAVAILABLE}: current members cannot represent {date}.")
        return current.withColumn("verified", F.lit(False))
    return dated


def snapshot_decision(membership: DataFrame, dates: list[str]) -> DataFrame:
    """Per requested date: verified, member count, sources, newest source."""
    options = F.array(*[F.lit(d).cast("date") for d in dates])
    keyed = membership.withColumn("requested_date", F.explode(options))
    inside = active_at(F.col("requested_date"))
    source = F.when(inside, F.col("source"))
    return keyed.groupBy("requested_date").agg(
        F.bool_or(inside).alias("verified"), F.count_distinct(F.when(inside, F.col("ticker"))).alias("members"),
        # Distinct sources: a handful of registry names.
        joined(F.array_sort(F.collect_set(source)), ";").alias("source"),
        F.max(F.when(inside, F.col("source_date"))).alias("latest_source_date"),
    )


def membership_violations(membership: DataFrame) -> DataFrame:
    """Duplicate records and intervals that do not end after their start."""
    twice = duplicates(membership, "index_name", "ticker", "effective_from").select(
        "ticker", "effective_from", F.lit("duplicate").alias("violation")
    )
    inverted = membership.where(F.col("effective_to") <= F.col("effective_from")).select(
        "ticker", "effective_from", F.lit("inverted").alias("violation")
    )
    return twice.unionByName(inverted)


def load_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dated membership file: strict start and source dates, lenient end.

    Repeated records and intervals that do not end after their start fail the job.
    """
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, *MEMBERSHIP_COLUMNS)
    out = raw.select(
        *[c for c in MEMBERSHIP_COLUMNS[:5]], F.to_date("effective_from").alias("effective_from"),
        F.try_to_date("effective_to").alias("effective_to"), "source", F.to_date("source_date").alias("source_date"),
    )
    out = out.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("index_name", "ticker", "effective_from")))
    bad = (F.col("_times") > 1) | (F.col("effective_to") <= F.col("effective_from"))
    return out.select(*[_refused(bad, "Repeated or inverted membership of ", c) if c == "effective_from" else c for c in MEMBERSHIP_COLUMNS])


def load_current_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    columns = ("ticker", "company_name", "sector", "industry", "source", "source_date")
    require_columns(raw, *columns)
    return raw.select(*columns[:5], F.to_date("source_date").alias("source_date"))


def universe_hash(members: DataFrame) -> DataFrame:
    """Order-free fingerprint and size of a member set (no global sort)."""
    return fingerprint(members)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash of any table: sum of the rows' 60-bit SHA-256 prefixes.

    Cells are written as text with a mark of their own for NULL and an escaped
    separator, so no two different rows read alike.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||"))), F.lit("~")) for c in sorted(df.columns)]
    head = F.substring(F.sha2(F.concat_ws("|;", *cells), 256), 1, 15)
    number = F.conv(head, 16, 10).cast("decimal(20,0)")
    return df.select(number.alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).alias("_sum")).select(
        "row_count", F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), F.col("_sum").cast("decimal(38,0)").cast("string")), 256).alias("fingerprint"))


def with_sector(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of the sector; missing and empty become Unknown."""
    return df.join(metadata.select("ticker", "sector"), "ticker", "left").withColumn("sector", _known("sector"))


def with_dated_sector(df: DataFrame, membership: DataFrame) -> DataFrame:
    return interval_join(df, membership, "sector").withColumn("sector", _known("sector"))


def _known(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))


def next_session(dates: DataFrame, panel: DataFrame, column: str = "date") -> DataFrame:
    """First market session strictly after each date, for any date.

    Dates and sessions are interleaved on one short timeline and the next
    session is a running minimum from below: no range join.
    """
    sessions = panel.select(F.col("date").alias("at")).distinct().withColumn("_s", F.lit(True))
    asked = dates.select(F.col(column).alias("at")).distinct().withColumn("_s", F.lit(False))
    w = Window.orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    line = sessions.unionByName(asked).withColumn("at_n", F.datediff("at", F.lit("1970-01-01").cast("date")))
    w = Window.orderBy("at_n").rangeBetween(1, Window.unboundedFollowing)
    return line.withColumn("next_session", F.min(F.when(F.col("_s"), F.col("at"))).over(w)).where(~F.col("_s")).select(
        F.col("at").alias(column), "next_session"
    )


def restrict(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    return df.join(keys.select(*columns), list(columns), "left_semi")


def exclude(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    return df.join(keys.select(*columns), list(columns), "left_anti")


def embargoed_training(dataset: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Training rows per cutoff: label known strictly before it.

    One copy of a row per cutoff it serves is inherent to the expanding window;
    the copies are made in place, without a join.
    """
    options = F.filter(
        F.array(*[F.lit(c).cast("date") for c in cutoffs]), lambda c: c > F.col("target_date")
    )
    return dataset.where(F.col("target_date").isNotNull() & F.col("target").isNotNull()).withColumn(
        "cutoff", F.explode(options)
    )


def training_counts(dataset: DataFrame) -> DataFrame:
    """(prediction_date, training_rows, prediction_rows) without a theta join.

    Labels are counted per target date first; a running sum over the calendar
    then answers every cutoff.
    """
    labelled = dataset.where(F.col("target_date").isNotNull() & F.col("target").isNotNull())
    known = labelled.groupBy(F.col("target_date").alias("at")).agg(F.count(F.lit(1)).alias("_l"))
    asked = dataset.groupBy(F.col("date").alias("at")).agg(F.count(F.lit(1)).alias("prediction_rows"))
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return asked.join(known, "at", "full_outer").withColumn(
        "training_rows", F.coalesce(F.sum(F.coalesce("_l", F.lit(0))).over(w), F.lit(0)).cast("bigint")
    ).where(F.col("prediction_rows").isNotNull()).select(
        F.col("at").alias("prediction_date"), "training_rows", "prediction_rows"
    )


def cutoff_eligibility(dataset: DataFrame, minimum_months: int = 36, start: str | None = None, end: str | None = None) -> DataFrame:
    """Cutoffs with enough distinct labelled months and both classes."""
    labelled = dataset.where(F.col("target_date").isNotNull() & F.col("target").isNotNull())
    # A feature month becomes usable at its earliest target date.
    first = labelled.groupBy("date").agg(F.min("target_date").alias("at"))
    months = first.groupBy("at").agg(F.count(F.lit(1)).alias("_m"))
    classes = labelled.groupBy(F.col("target_date").alias("at")).agg(
        F.min("target").alias("_lo"), F.max("target").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    asked = dataset.groupBy(F.col("date").alias("at")).agg(F.count(F.lit(1)).alias("prediction_rows"))
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    line = asked.join(months, "at", "full_outer").join(classes, "at", "full_outer").select(
        F.col("at").alias("prediction_date"), "prediction_rows",
        F.coalesce(F.sum("_m").over(w), zero).alias("train_months"),
        F.coalesce(F.sum("_n").over(w), zero).alias("training_rows"),
        (F.min("_lo").over(w) < F.max("_hi").over(w)).alias("_both"),
    ).where(F.col("prediction_rows").isNotNull())
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("prediction_date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("prediction_date") <= F.lit(end).cast("date"))
    return line.withColumn(
        "eligible", (F.col("train_months") >= minimum_months) & F.coalesce("_both", F.lit(False)) & inside
    ).drop("_both")


def replay_snapshots(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Per month-end as-of date: size and bounds of the truncated panel.

    Everything additive is a running sum over the calendar, so the history is
    read once instead of once per as-of date.
    """
    first = panel.groupBy("ticker").agg(F.min("date").alias("date")).groupBy("date").agg(
        F.count(F.lit(1)).alias("_new")
    )
    daily = panel.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    line = daily.join(first, "date", "left").select(
        "date", F.sum("_rows").over(run).alias("rows_visible"),
        F.coalesce(F.sum("_new").over(run), F.lit(0)).alias("securities_seen"),
        F.lead("date").over(w).alias("_next"), F.row_number().over(w).cast("bigint").alias("sessions"),
    )
    last = F.col("_next").isNull() | (F.trunc("_next", "month") > F.trunc("date", "month"))
    return line.where(last & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        F.col("date").alias("as_of"), "sessions", "rows_visible", "securities_seen"
    )


def session_lookup(panel: DataFrame) -> DataFrame:
    """(date, next_date) for dates that are sessions themselves."""
    return calendar(panel).select("date", F.col("next_date").alias("next_session"))
