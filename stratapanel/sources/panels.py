"""Price panels derived from the star-schema tables.

All panels are sparse and long: a missing cell is an absent row.  A bar is one
(ticker, period) group of line items, so a hot ticker collapses in the map-side
combine before anything is shuffled.  Money is summed as whole cents: integer
sums are exact, so prices do not depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratapanel.sources.tables import read_table


def _lines(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    return read_table(
        spark, folder, "lineitem", "l_extendedprice", "l_quantity", "l_shipdate", *extra
    )


def cents(column: str) -> Column:
    """Nearest whole cent of a non-negative amount."""
    return F.floor(F.col(column) * 100 + 0.5)


def money(column: str = "l_extendedprice") -> Column:
    return F.sum(cents(column)) / 100.0


def _bars(df: DataFrame, ticker: Column, date: Column) -> DataFrame:
    value, quantity = money(), F.sum("l_quantity")
    return (
        df.groupBy(date.alias("date"), ticker.alias("ticker"))
        .agg(
            value.alias("value"),
            quantity.alias("volume"),
            F.min(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("open"),
        )
        .withColumn("close", F.try_divide("value", "volume"))
    )


def month_end(column: str) -> Column:
    return F.last_day(F.to_date(column))


def brand_months(spark: SparkSession, folder: str) -> DataFrame:
    """(date, ticker, value, volume, open, close) by brand and month."""
    part = read_table(spark, folder, "part", "p_partkey", "p_brand")
    lines = _lines(spark, folder, "l_partkey")
    joined = lines.join(part, lines.l_partkey == part.p_partkey)
    return _bars(joined, F.col("p_brand"), month_end("l_shipdate"))


def supplier_months(spark: SparkSession, folder: str) -> DataFrame:
    """The same by supplier: the wide-universe panel, no join needed."""
    lines = _lines(spark, folder, "l_suppkey")
    return _bars(lines, F.col("l_suppkey").cast("string"), month_end("l_shipdate"))


def _nation_lines(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    supplier = read_table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    lines = _lines(spark, folder, "l_suppkey", *extra)
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)


def nation_ticker() -> Column:
    return F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))


def nation_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars by supplier nation."""
    return _bars(_nation_lines(spark, folder), nation_ticker(), F.to_date("l_shipdate"))


def region_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars by supplier region inside the month window: a dense panel."""
    supplier = read_table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    nation = read_table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, folder, "region", "r_regionkey", "r_name")
    place = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    ).select("s_suppkey", "r_name")
    lines = _lines(spark, folder, "l_suppkey")
    return _bars(lines.join(place, lines.l_suppkey == place.s_suppkey), F.col("r_name"), F.to_date("l_shipdate"))


def vendor_feed(panel: DataFrame) -> DataFrame:
    """Market panel with faults planted by volume, and an arrival order.

    Rows whose volume hits a multiple get a bad price, a bad volume or a second
    copy; arrival goes by weekday, so dates run backwards.
    """
    v, raw = F.col("volume"), F.col("raw_close")
    days = F.datediff("date", F.lit("1990-01-01").cast("date"))
    bad = panel.select(
        "date", "canonical_ticker", "provider_ticker",
        F.when(v % 97 == 0, 0.0).when(v % 89 == 0, -raw).otherwise(F.col("adjusted_close")).alias("adjusted_close"),
        F.when(v % 83 == 0, -1.0).otherwise(raw).alias("raw_close"),
        F.when(v % 79 == 0, -v).otherwise(v).alias("volume"), "dividends", "stock_splits",
        ((days % 7) * 100_000 + days).cast("bigint").alias("ingest_seq"),
        F.when(v % 73 == 0, 2).otherwise(1).alias("_copies"),
    )
    return bad.withColumn("_c", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_c", "_copies")


def market_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Eight-column vendor panel by nation and day, with raw and adjusted price."""
    lines = _nation_lines(
        spark, folder, "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    quantity = F.sum("l_quantity")
    return (
        lines.groupBy(F.to_date("l_shipdate").alias("date"), nation_ticker().alias("canonical_ticker"))
        .agg(
            F.try_divide(
                F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))) / 10_000.0, quantity
            ).alias("adjusted_close"),
            F.try_divide(money(), quantity).alias("raw_close"),
            quantity.alias("volume"),
            (F.sum(F.when(F.col("l_returnflag") == "R", cents("l_tax")).otherwise(0)) / 100.0).alias("dividends"),
            F.max(
                F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") == 50), 2.0).otherwise(0.0)
            ).alias("stock_splits"),
        )
        .withColumn("provider_ticker", F.col("canonical_ticker"))
    )


def benchmark_months(spark: SparkSession, folder: str) -> DataFrame:
    """(date, close) over all line items; one partial aggregate per map task."""
    lines = _lines(spark, folder)
    return lines.groupBy(month_end("l_shipdate").alias("date")).agg(
        F.try_divide(money(), F.sum("l_quantity")).alias("close")
    )


def benchmark_days(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return lines.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.try_divide(money(), F.sum("l_quantity")).alias("close")
    )


def event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Ingested observations: user as ticker, event id as arrival version."""
    events = read_table(spark, folder, "events", "event_id", "ts", "user_id", "value")
    return events.select(
        F.to_date("ts").alias("date"),
        F.col("user_id").cast("string").alias("ticker"),
        F.col("value"),
        F.col("event_id").alias("version"),
    )


def brand_sectors(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, sector): brand number modulo the region keys."""
    part = read_table(spark, folder, "part", "p_brand").distinct()
    region = read_table(spark, folder, "region", "r_regionkey", "r_name")
    key = F.substring("p_brand", 7, 9).cast("int") % 5
    return part.join(region, key == region.r_regionkey, "left").select(
        F.col("p_brand").alias("ticker"), F.col("r_name").alias("sector")
    )


def supplier_sectors(spark: SparkSession, folder: str) -> DataFrame:
    supplier = read_table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    nation = read_table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    region = read_table(spark, folder, "region", "r_regionkey", "r_name")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))
    )


def supplier_membership(spark: SparkSession, folder: str, months: DataFrame) -> DataFrame:
    """Half-open membership intervals per supplier; every fifth one ends."""
    span = months.groupBy("ticker").agg(F.min("date").alias("effective_from"))
    ends = F.col("ticker").cast("bigint") % 5 == 0
    return span.join(supplier_sectors(spark, folder), "ticker", "left").select(
        F.lit("SUPPLIERS").alias("index_name"),
        "ticker",
        "sector",
        "effective_from",
        F.when(ends, F.add_months("effective_from", 36)).alias("effective_to"),
        F.when(ends, "registry-b").otherwise("registry-a").alias("source"),
        F.col("effective_from").alias("source_date"),
    )
