"""Readers for the base Parquet tables: dates as DATE, NaN as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.functions.columns import finite


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_prices(spark: SparkSession, path: str, ticker_columns: list[str] | None = None) -> DataFrame:
    """Long price panel ``(date, ticker, close)``.

    A wide file (one column per security beside ``date``) is unpivoted; a long
    file is projected.  Missing cells stay NULL.
    """
    df = spark.read.parquet(path)
    if {"ticker", "close"}.issubset(df.columns):
        out = df.select(F.to_date("date").alias("date"), "ticker", F.col("close").cast("double"))
    else:
        names = ticker_columns or [c for c in df.columns if c != "date"]
        out = df.select("date", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(
            "date", names, "ticker", "close"
        ).withColumn("date", F.to_date("date"))
    return out.withColumn("close", finite(F.col("close")))


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """First value column of the file as ``(date, close)``."""
    df = spark.read.parquet(path)
    first = next(c for c in df.columns if c != "date")
    return df.select(F.to_date("date").alias("date"), finite(F.col(first).cast("double")).alias("close"))
