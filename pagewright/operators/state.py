"""Event-sourced state in batch form; the streaming forms are in ``pagewright.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of each key the value of the last event in ``order``, and how many were sent; one map-side combined aggregation."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n_sent"))


def drop_stale(events: DataFrame) -> DataFrame:
    """Events whose lane is above prefetch or whose generation is the current one; 'error' bumps the generation."""
    bump = (F.col("event_type") == "error").cast("long")
    so_far = F.sum(bump).over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    now = events.groupBy("user_id").agg(F.sum(bump).alias("_now"))
    e = events.withColumn("generation", so_far).join(now, "user_id")
    low = ~F.col("event_type").isin("purchase", "signup")
    return e.where((F.col("event_type") != "error") & ~(low & (F.col("generation") < F.col("_now")))).select("user_id", "event_id", "generation")
