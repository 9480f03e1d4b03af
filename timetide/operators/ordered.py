"""Checks over rows in an order: lags, running extremes, runs, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backwards(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value lies below one that came earlier under the key, with `reached` (the largest before)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reached", F.max(value).over(w)).filter(F.col(value) < F.col("reached"))


def not_increasing(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is no more than that of the row before, with `before`."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).filter(F.col(value) <= F.col("before"))


def unsorted_once(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Of each key the first row whose value is no more than the largest before it."""
    w = Window.partitionBy(key).orderBy(*order)
    late = df.withColumn("reached", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col(value) <= F.col("reached"))
    return late.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_and_last(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """key and first_<column>, last_<column>: an aggregate, so only one row a key and task is shuffled."""
    pick = [f(F.col(c), F.col(order)).alias(f"{n}_{c}") for c in columns for n, f in (("first", F.min_by), ("last", F.max_by))]
    return df.groupBy(key).agg(*pick)


def runs(df: DataFrame, key: str, order: list[str], value: str, least: int) -> DataFrame:
    """key, value, length, run_start: maximal runs of equal values, of so many rows or more."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(key, "__run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("run_start"))
    return out.filter(F.col("length") >= least).select(key, value, "length", "run_start")


def day_gaps(df: DataFrame, key: str, day: str, least: int) -> DataFrame:
    """key, gap_from, gap_to, missing: stretches of so many missing days or more between consecutive distinct days."""
    days = df.select(key, F.col(day).cast("date").alias("gap_to")).distinct()
    w = Window.partitionBy(key).orderBy("gap_to")
    gaps = days.withColumn("gap_from", F.lag("gap_to").over(w)).withColumn("missing", F.datediff("gap_to", "gap_from") - 1)
    return gaps.filter(F.col("missing") >= least).select(key, "gap_from", "gap_to", "missing")


def headways(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """keys, n_gaps, mean_gap, max_gap, variation (deviation over mean) of gaps between distinct times, in seconds."""
    times = df.select(*keys, seconds.alias("__t")).distinct()
    w = Window.partitionBy(*keys).orderBy("__t")
    gaps = times.withColumn("__g", F.col("__t") - F.lag("__t").over(w)).filter("__g IS NOT NULL")
    mean = F.avg("__g")
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.round(mean, 4).alias("mean_gap"), F.max("__g").alias("max_gap"), F.round(F.stddev_pop("__g") / mean, 4).alias("variation"))
