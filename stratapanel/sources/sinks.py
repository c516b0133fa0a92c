"""Sinks: Parquet, CSV, versioned datasets and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.functions.columns import sorted_json


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """Report sink with header; ``index`` moves one column to the front."""
    if index:
        df = df.select(index, *[c for c in df.columns if c != index])
    flatten_maps(df).write.mode("overwrite").option("header", True).csv(path)


def flatten_maps(df: DataFrame) -> DataFrame:
    """Map and array columns become JSON text with sorted keys."""
    def flat(f):
        kind = f.dataType.typeName()
        if kind == "map":
            return sorted_json(F.col(f.name)).alias(f.name)
        if kind == "array":
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def write_version(df: DataFrame, root: str, run_id: str, created_at: str) -> None:
    """Immutable version: its own ``run_id`` partition, plus a catalog row.

    Dynamic overwrite makes a retried write replace only its own partition.
    """
    spark = df.sparkSession
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(f"{root}/data")
    spark.range(1).select(F.lit(created_at).alias("created_at"), F.lit(run_id).alias("run_id")).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/versions")


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """Newest version; only its partition is listed and read."""
    row = latest_version(spark.read.parquet(f"{root}/versions")).first()
    return spark.read.parquet(f"{root}/data").where(F.col("run_id") == row["run_id"])


def not_yet_recorded(new: DataFrame, existing: DataFrame, keys=("strategy", "signal_date", "realization_date")) -> DataFrame:
    return new.join(existing.select(*keys), list(keys), "left_anti")


def append_once(new: DataFrame, path: str, keys=("strategy", "signal_date", "realization_date")) -> None:
    """Append only rows whose key is not in the ledger yet."""
    spark = new.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as error:  # the first append creates the ledger
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.write.mode("append").parquet(path)
        return
    not_yet_recorded(new, existing, keys).write.mode("append").parquet(path)


def migrate_ledger(df: DataFrame) -> DataFrame:
    """Older ledgers lack the pre-trade and trade columns."""
    if "pretrade_weight" not in df.columns:
        df = df.withColumn("pretrade_weight", F.lit(0.0))
    if "trade_weight" not in df.columns:
        df = df.withColumn("trade_weight", F.lit(None).cast("double"))
    return df.withColumn("pretrade_weight", F.coalesce("pretrade_weight", F.lit(0.0))).withColumn(
        "trade_weight", F.coalesce("trade_weight", F.col("target_weight"))
    )


def vendor_long(fields: dict[str, DataFrame], mapping: DataFrame | None = None) -> DataFrame:
    """Five wide field tables (date x symbol) to the eight-column long panel.

    A symbol without any adjusted close takes its raw close; ``mapping`` gives
    the canonical id of each provider symbol.
    """
    long = None
    for name, wide in fields.items():
        symbols = [c for c in wide.columns if c != "date"]
        part = wide.unpivot("date", symbols, "provider_ticker", name)
        long = part if long is None else long.join(part, ["date", "provider_ticker"], "full_outer")
    for name in ("adjusted_close", "raw_close", "volume", "dividends", "stock_splits"):
        if name not in fields:
            long = long.withColumn(name, F.lit(None).cast("double"))
    return fill_adjusted(long, mapping)


def fill_adjusted(long: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Raw close where a symbol has no adjusted close at all; drop empty rows."""
    has = long.groupBy("provider_ticker").agg(F.count("adjusted_close").alias("_n"))
    zero = F.lit(0.0)
    if mapping is None:
        long = long.withColumn("canonical_ticker", F.col("provider_ticker"))
    else:
        long = long.join(mapping.select("provider_ticker", "canonical_ticker"), "provider_ticker")
    return long.join(has, "provider_ticker").withColumn(
        "adjusted_close", F.when(F.col("_n") == 0, F.col("raw_close")).otherwise(F.col("adjusted_close"))
    ).where(F.col("adjusted_close").isNotNull()).select(
        "date", "canonical_ticker", "provider_ticker",
        "adjusted_close", "raw_close", "volume", F.coalesce("dividends", zero).alias("dividends"),
        F.coalesce("stock_splits", zero).alias("stock_splits"),
    )
