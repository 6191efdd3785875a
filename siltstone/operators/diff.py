"""Differences of two archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_path(a: DataFrame, b: DataFrame) -> DataFrame:
    """path and state: added, removed, changed or unchanged; a, b: path, h."""
    met = a.select("path", F.col("h").alias("ha")).join(b.select("path", F.col("h").alias("hb")), "path", "full_outer")
    state = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") == F.col("hb"), "unchanged").otherwise("changed")
    return met.select("path", state.alias("state"))


def counters(a: DataFrame, b: DataFrame) -> DataFrame:
    return by_path(a, b).groupBy("state").agg(F.count("*").alias("n"))


def chunk_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of b's different chunks (h, s): how many and how much a has too, and the share of new bytes."""
    met = b.select("h", "s").distinct().join(a.select("h").distinct().withColumn("known", F.lit(1)), "h", "left")
    known, new = F.col("known").isNotNull(), F.col("known").isNull()
    sums = met.agg(
        F.count_if(known).alias("shared_chunks"), F.coalesce(F.sum(F.when(known, F.col("s"))), F.lit(0)).alias("shared_bytes"),
        F.count_if(new).alias("new_chunks"), F.coalesce(F.sum(F.when(new, F.col("s"))), F.lit(0)).alias("new_bytes"),
    )
    return sums.withColumn("new_pct", F.round(F.col("new_bytes") * 1000 / (F.col("new_bytes") + F.col("shared_bytes"))) / 10)
