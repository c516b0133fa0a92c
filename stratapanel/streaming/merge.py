"""Streaming keep-last merge: new panel rows arrive, later versions win.

The latest version of every key is streaming state, so a batch emits the keys
that it touched and nothing else; with ``expiry`` the state of keys whose date
lies that far behind the newest one is dropped, and rows older than that are
ignored.  The merged table holds one row per key in monthly partitions.  A batch
rewrites the months of its own keys only, and reading takes no ranking: its cost
does not grow with the number of batches.  A batch that is retried after a
failure, or replayed with a new checkpoint, gives the same months again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stratapanel.operators.quality import keep_last


def latest(stream: DataFrame, keys: tuple[str, ...], version: str, expiry: str | None) -> DataFrame:
    """Streaming aggregate of the latest row per key (largest version, then largest values)."""
    rest = [c for c in stream.columns if c not in keys and c != version]
    group = list(keys)
    if expiry is not None:
        stream = stream.withColumn("_event", F.to_timestamp("date")).withWatermark("_event", expiry)
        group.append("_event")
    best = stream.groupBy(*group).agg(F.max(F.struct(version, *rest)).alias("_best"))
    return best.select(*keys, "_best.*")


def _table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add("month", "date")).parquet(f"{root}/table")


def start_merge(stream: DataFrame, root: str, keys: tuple[str, ...] = ("ticker", "date"), version: str = "version", expiry: str | None = None):
    """Start the query; it stops once the available input is consumed.  ``date`` must be one of the columns."""
    state = latest(stream, tuple(keys), version, expiry)
    schema = state.schema
    spark = stream.sparkSession
    spark.createDataFrame([], schema).withColumn("month", F.trunc("date", "month")).write.mode("ignore").partitionBy("month").parquet(f"{root}/table")

    def land(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        changed = batch.withColumn("month", F.trunc("date", "month")).persist()
        months = [r[0] for r in changed.select("month").distinct().collect()]  # calendar-bounded
        held = _table(own, root, schema).where(F.col("month").isin(months)) if months else None
        if held is not None:
            merged = keep_last(held.unionByName(changed), keys, version)
            merged.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{root}/table")
        changed.unpersist()

    return (
        state.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )


def read_merged(spark: SparkSession, root: str) -> DataFrame:
    """The merged table: one row per key."""
    return spark.read.parquet(f"{root}/table").drop("month")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Copy the merged table to a new folder, each month in as few files as its size asks."""
    table = spark.read.parquet(f"{root}/table")
    table.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{target}/table")
