"""Partition width of CPU-heavy steps."""

from __future__ import annotations

from pyspark.sql import DataFrame


def even_width(df: DataFrame) -> int:
    """Partitions for CPU-heavy rows that must not be coalesced: the session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
