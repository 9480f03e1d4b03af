"""Distance operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def near_pairs(points: DataFrame, limit: float) -> DataFrame:
    """a, b, distance: pairs a < b of points (id, x, y) no farther apart than the limit, in the plane.

    One side stays in its cell, the other is dealt to the nine cells around it: an equi-join on cells.
    """
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    here = points.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    there = points.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), around.alias("d"))
    there = there.select("b", "xb", "yb", (F.floor(F.col("xb") / limit) + F.col("d.i")).alias("cx"), (F.floor(F.col("yb") / limit) + F.col("d.j")).alias("cy"))
    distance = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return here.join(there, ["cx", "cy"]).filter("a < b").withColumn("d", distance).filter(F.col("d") <= limit).select("a", "b", F.round("d", 6).alias("distance"))


def near_stops(stops: DataFrame, metres: float) -> DataFrame:
    """a, b, metres: pairs of stops (stop_id, stop_lat, stop_lon) within so many metres, on the globe.

    Cells are one limit high; in longitude they widen with the latitude band, so the nine around hold every partner.
    """
    step = metres / (EARTH_KM * 1000) * 57.29577951308232 * 1.001
    # One cell width for each band of latitude, wide enough for the band's pole side and its neighbours.
    band = F.floor(F.col("stop_lat") / step).cast("long")
    at = lambda b: F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), (F.abs(b) + 2) * step))))
    here = stops.select(F.col("stop_id").alias("a"), F.col("stop_lat").alias("la"), F.col("stop_lon").alias("oa"), band.alias("cy"))
    here = here.withColumn("cx", F.floor(F.col("oa") * at(F.col("cy")) / step).cast("long"))
    there = stops.select(F.col("stop_id").alias("b"), F.col("stop_lat").alias("lb"), F.col("stop_lon").alias("ob"), F.explode(F.array(band - 1, band, band + 1)).alias("cy"))
    own = F.floor(F.col("ob") * at(F.col("cy")) / step).cast("long")
    there = there.withColumn("cx", F.explode(F.array(own - 1, own, own + 1)))
    apart = haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) * 1000
    return here.join(there, ["cy", "cx"]).filter("a < b").withColumn("metres", apart).filter(F.col("metres") <= metres).select("a", "b", "metres")
