"""Tables written to the cluster's shared folder between the steps of an operator."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from stratapanel.session import shared_folder

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stratapanel/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Inside, Spark removes the shuffle files of a query when it ends, not when the driver's JVM next collects its garbage."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: no step is run twice, a lost executor costs one task, and its shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_released(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
