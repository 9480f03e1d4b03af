"""Interval operators: overlaps, service calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows that start before an earlier row of their key has ended, with `busy_until`: one sort, no self join."""
    w = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("busy_until", F.max(end).over(w)).filter(F.col(start) < F.col("busy_until"))


WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


#: Exceptions of a service that are compared with each of its days; more are taken as sets.
FEW = 64


def active_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id, date: days of the ranges whose weekday runs, and added days, less removed ones (removed wins).

    calendar: service_id, start_date, end_date and seven 0/1 columns; exceptions: service_id, date, exception_type (1 adds, 2 removes).
    Ranges and exceptions of a service meet before its days are spread, so that no day is shuffled.
    """
    runs = F.array(*[F.coalesce(F.col(d), F.lit(0)) for d in WEEKDAYS])
    given = F.struct("start_date", "end_date", runs.alias("runs")).alias("given")
    ranges = calendar.filter("start_date <= end_date").select("service_id", given, F.lit(None).cast("date").alias("date"), F.lit(0).alias("type"))
    single = exceptions.filter("exception_type IN (1, 2)").select("service_id", F.lit(None).cast(ranges.schema["given"].dataType).alias("given"), F.col("date").cast("date").alias("date"), F.col("exception_type").cast("int").alias("type"))
    added, removed = F.col("type") == 1, (F.col("type") == 2) & F.col("service_id").isNotNull()
    own = ranges.unionByName(single).groupBy("service_id").agg(
        F.collect_list("given").alias("given"),
        F.collect_set(F.when(added, F.col("date"))).alias("added"),
        F.coalesce(F.bool_or(added & F.col("date").isNull()), F.lit(False)).alias("undated"),
        F.collect_set(F.when(removed, F.col("date"))).alias("removed"),
    )
    extra = F.when(F.col("undated"), F.concat("added", F.array(F.lit(None).cast("date")))).otherwise(F.col("added"))
    own = own.select("service_id", "given", extra.alias("added"), "removed")
    # One range and few exceptions, as most services have: each day is looked at as it is spread.
    plain = (F.size("given") == 1) & (F.size("added") + F.size("removed") <= FEW)
    g, date = F.col("g"), F.col("date")
    inside = lambda d: F.coalesce((d >= g["start_date"]) & (d <= g["end_date"]), F.lit(False))
    one = own.filter(plain).withColumn("g", F.get("given", F.lit(0))).withColumn("outside", F.filter("added", lambda d: ~inside(d)))
    spread = one.select("service_id", "g", "added", "removed", F.explode(F.concat(F.sequence(g["start_date"], g["end_date"]), "outside")).alias("date"))
    runs_on = inside(date) & (F.element_at(g["runs"], F.weekday(date) + 1) == 1)
    # A day without a date can only be an added one.
    kept = date.isNull() | ((runs_on | F.array_contains("added", date)) & ~F.array_contains("removed", date))
    few = spread.filter(kept).select("service_id", "date")
    # The others by sets of days; a service without a range has its exceptions only.
    days = F.flatten(F.transform("given", lambda g: F.filter(F.sequence(g["start_date"], g["end_date"]), lambda d: F.element_at(g["runs"], F.weekday(d) + 1) == 1)))
    many = own.filter(~plain).select("service_id", F.explode(F.array_except(F.array_union(days, "added"), "removed")).alias("date"))
    return few.unionByName(many)
