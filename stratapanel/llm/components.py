"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from stratapanel.llm.store import removed, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b): every node's neighbours (the larger or the smaller) point to its least one."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        out = near.join(least, F.col("a") == F.col("c")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        out = edges.join(least, F.col("a") == F.col("c")).select("b", "m", "a")
        out = out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def _noted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, with their number and a digest of their set, taken while writing."""
    seen = Observation()
    digest = F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")), "edges")
    return table, (seen.get["n"], seen.get["digest"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id of ``edges`` (a, b); loops are ignored, nulls are not allowed."""
    spark = edges.sparkSession
    now, seen = _noted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while seen[0]:
        after, new = _noted(_stars(_stars(now, True), False))
        removed(spark, now)
        now = after
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
