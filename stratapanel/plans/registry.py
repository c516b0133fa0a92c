"""Registry of bound queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Bar-level columns are quotients of exact sums, equal to the last bit on every
#: engine; rounding them could only split exact decimal ties differently.
EXACT = {"open", "close", "raw_close", "adjusted_close", "volume", "dividends", "stock_splits", "value", "reference_price"}


def finish(df: DataFrame) -> DataFrame:
    """Report types: doubles to 6 places, every count as BIGINT."""
    def column(f):
        kind = f.dataType.typeName()
        if kind == "double" and f.name not in EXACT:
            return F.round(F.col(f.name), 6).alias(f.name)
        if kind in ("integer", "short", "byte"):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"Duplicate query {name}")
    QUERIES[name] = lambda spark, folder: finish(build(spark, folder))
    if sql is not None:
        ORACLES[name] = sql
