"""Derived series and GeoJSON of storms for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import EXACT, haversine_km
from cumulo.functions.constants import DT_HOURS


def storm_cumulative(steps: DataFrame, key: str = "storm_uid") -> DataFrame:
    """Steps (key, t, volume_km3) with the running volume and the rate in km3 an hour."""
    order = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "t", "volume_km3", F.sum(F.col("volume_km3").cast(EXACT)).over(order).cast("double").alias("cumulative_km3"), (F.col("volume_km3") / F.lit(DT_HOURS)).alias("km3_per_h"))


def track_speed(tracks: DataFrame, key: str = "storm_uid") -> DataFrame:
    """(key, km, median_km_h): length of the track and median speed between consecutive vertices."""
    order = Window.partitionBy(key).orderBy("t")
    prev = lambda c: F.lag(c).over(order)
    rows = tracks.select(key, "t", haversine_km(prev("lat"), prev("lon"), F.col("lat"), F.col("lon")).alias("km"), (F.col("t") - prev("t")).alias("dt"))
    rows = rows.withColumn("speed", F.col("km") / (F.col("dt") * F.lit(DT_HOURS)))
    return rows.groupBy(key).agg(F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 5).alias("km"), F.round(F.expr("percentile(speed, 0.5)"), 5).alias("median_km_h"))


def mean_depth_mm(volume_km3: Column, area_km2: Column) -> Column:
    return volume_km3 / area_km2 * 1e6


def step_extremes(steps: DataFrame, key: str = "label") -> DataFrame:
    """(key, peak_t, peak_mm_hr, largest_t, largest_km2): an object's first step of its highest rate and of its largest footprint."""
    first = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("t")).alias("t")))
    rows = steps.groupBy(key).agg(first("peak_mm_hr").alias("p"), first("area_km2").alias("a"))
    return rows.select(key, (-F.col("p.t")).alias("peak_t"), F.col("p.v").alias("peak_mm_hr"), (-F.col("a.t")).alias("largest_t"), F.col("a.v").alias("largest_km2"))


def starts_3h(cat: DataFrame) -> DataFrame:
    """(bin, n): storm starts in each three UTC hours of the day, empty bins too."""
    counted = cat.groupBy(F.floor(F.hour("start_time") / 3).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return cat.sparkSession.range(8).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def relative_density(points: DataFrame, inner: Column, inner_cells: int, all_cells: int) -> DataFrame:
    """Points a cell inside a box over points a cell in all."""
    return points.agg(((F.sum(inner.cast("long")) / inner_cells) / (F.count("*") / all_cells)).alias("relative_density"))


def feature(track: Column, properties: Column) -> Column:
    """GeoJSON feature as text: a LineString, or a Point for a single vertex."""
    pair = lambda p: F.array(F.round(p["lon"], 4), F.round(p["lat"], 4))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(track, pair).alias("coordinates")))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), pair(track[0]).alias("coordinates")))
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.when(F.size(track) > 1, line).otherwise(point), F.lit(',"properties":'), F.to_json(properties), F.lit("}"))
