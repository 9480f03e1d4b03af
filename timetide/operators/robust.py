"""Robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mad_outliers(df: DataFrame, key: str, value: str, times: float, least: int = 5) -> DataFrame:
    """Rows farther from their group's median than `times` scaled median deviations, with group_median and score.

    Groups of fewer than `least` rows or without spread give none. Two aggregates joined back on the key.
    """
    medians = df.groupBy(key).agg(F.median(value).alias("group_median"), F.count(value).alias("__n"))
    away = df.join(medians, key).withColumn("__away", F.abs(F.col(value) - F.col("group_median")))
    spread = away.groupBy(key).agg((F.median("__away") * 1.4826).alias("__mad"))
    out = away.join(spread, key).filter((F.col("__n") >= least) & (F.col("__mad") > 0) & (F.col("__away") > times * F.col("__mad")))
    return out.withColumn("score", F.round(F.col("__away") / F.col("__mad"), 4)).drop("__n", "__away", "__mad")


def far_from_centre(points: DataFrame, floor: float, factor: float) -> DataFrame:
    """id, distance: points (id, x, y) farther from the marginal medians than max(floor, factor * 99th percentile)."""
    centre = points.agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    away = points.join(F.broadcast(centre)).withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)))  # one row
    limit = away.agg(F.greatest(F.lit(floor), factor * F.percentile("distance", 0.99)).alias("limit"))
    return away.join(F.broadcast(limit)).filter("distance > `limit`").select("id", F.round("distance", 6).alias("distance"))
