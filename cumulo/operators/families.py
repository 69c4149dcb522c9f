"""Families: storms linked over gaps in time and distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.functions.columns import exact_sum
from cumulo.functions.constants import AGE_CLASSES, KM_PER_DEGREE
from cumulo.plans.graph import connected_components


def pairs(storms: DataFrame, gap_h: float = 3.0, dist_km: float = 50.0) -> DataFrame:
    """(a, b) of storms that belong together: a starts first (ties by uid), ends at most ``gap_h`` before b starts, and lies near.

    The gap is one of whole minutes: either time is cut to its minute first.
    Near is (dlat)^2 + (dlon cos(lat_b))^2 <= (dist_km / 111.32)^2.  Storms (storm_uid, start_time, end_time, lat, lon) meet by
    equi-join on buckets of time and space: an earlier storm stands in every time bucket that its reach covers and in the two by two
    cells, each two reaches wide, that its reach can touch; the condition is then exact.  Cells are wide enough for the highest latitude in
    the data.  Storms without place or time take part in nothing.  A storm stands in about eight buckets, which sizes of files don't tell, so
    the sides are merged and none is broadcast.
    """
    deg, gap = dist_km / KM_PER_DEGREE, int(gap_h * 3600)
    rows = storms.where("lat IS NOT NULL AND lon IS NOT NULL AND start_time IS NOT NULL").select("storm_uid", F.unix_micros(F.col("start_time").cast("timestamp")).alias("s"), F.unix_micros(F.col("end_time").cast("timestamp")).alias("e"), "lat", "lon")
    top = rows.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    wide = deg / max(math.cos(math.radians(min(top, 89.0))), 1e-3)
    bucket, minute = max(gap, 3600) * 1_000_000, 60_000_000
    gap = int(gap_h * 60) * minute
    place = (F.floor(F.col("lat") / (2 * deg)).alias("by"), F.floor(F.col("lon") / (2 * wide)).alias("bx"))
    later = rows.select(F.col("storm_uid").alias("b"), F.col("s").alias("s_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.floor(F.col("s") / bucket).alias("bt"), *place)
    cells = lambda c, reach: F.explode(F.sequence(F.floor((F.col(c) - reach * (1 + 1e-9)) / (2 * reach)), F.floor((F.col(c) + reach * (1 + 1e-9)) / (2 * reach))))
    reach = F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") + gap + minute) / bucket)))
    first = rows.select("*", reach.alias("bt")).select("*", cells("lat", deg).alias("by")).select(F.col("storm_uid").alias("a"), "s", "e", "lat", "lon", "bt", "by", cells("lon", wide).alias("bx"))
    dlat, dlon = F.col("lat_b") - F.col("lat"), (F.col("lon_b") - F.col("lon")) * F.cos(F.radians("lat_b"))
    near = (F.floor(F.col("e") / minute) * minute >= F.floor(F.col("s_b") / minute) * minute - gap) & (dlat * dlat + dlon * dlon <= deg * deg)
    before = (F.col("s") < F.col("s_b")) | ((F.col("s") == F.col("s_b")) & (F.col("a") < F.col("b")))
    return first.hint("merge").join(later.hint("merge"), ["bt", "by", "bx"]).where(near & before).select("a", "b")


def link(storms: DataFrame, gap_h: float = 3.0, dist_km: float = 50.0) -> DataFrame:
    """``storms`` with ``fam``, the least uid of the family; the whole record is linked at once."""
    parts = connected_components(pairs(storms, gap_h, dist_km), "a", "b", near=True)
    return storms.join(parts.hint("merge"), storms["storm_uid"] == parts["node"], "left").select(*storms.columns, F.coalesce("component", "storm_uid").alias("fam"))


def summarise(linked: DataFrame) -> DataFrame:
    """One row a family: size, times, volume, peaks, mean place, age and age class."""
    seconds = F.unix_micros(F.max("end_time").cast("timestamp")) - F.unix_micros(F.min("start_time").cast("timestamp"))
    rows = linked.groupBy("fam").agg(
        F.count("*").alias("n_storms"),
        F.min("start_time").alias("start"),
        F.max("end_time").alias("end"),
        exact_sum("volume_km3").alias("volume_km3"),
        F.max("max_intensity_mm_hr").alias("max_intensity_mm_hr"),
        F.max("max_area_km2").alias("max_area_km2"),
        F.round(F.avg("lat"), 6).alias("lat"),
        F.round(F.avg("lon"), 6).alias("lon"),
        (seconds / F.lit(3.6e9) + 0.5).alias("age_h"),
    )
    days = F.floor(F.col("age_h") / 24).cast("int")
    named = F.element_at(F.array(*[F.lit(c) for c in AGE_CLASSES]), F.least(days, F.lit(3)) + 1)
    return rows.withColumn("age_days", days).withColumn("age_class", named).withColumn("year", F.year("start")).withColumn("month", F.month("start"))


def claimed(families: DataFrame, year: int | None = None) -> DataFrame:
    """Families of the year they start in, all years by default, with ``family_uid`` year-month-fam; each belongs to one year."""
    own = families if year is None else families.where(F.col("year") == year)
    return own.withColumn("family_uid", F.concat_ws("-", "year", "month", "fam"))


def percolation(families: DataFrame) -> DataFrame:
    """Largest family's share of the volume."""
    return families.agg(F.coalesce(F.max("volume_km3") / exact_sum("volume_km3"), F.lit(0.0)).alias("percolation"))


def age_classes(families: DataFrame) -> DataFrame:
    """Families, storms and volume of each age class, in fixed order, with shares; empty classes are rows too."""
    spark = families.sparkSession
    every = spark.createDataFrame(list(enumerate(AGE_CLASSES)), "age_order int, age_class string")
    counted = families.groupBy("age_class").agg(F.count("*").alias("n"), F.sum("n_storms").alias("s"), exact_sum("volume_km3").alias("v"))
    total = families.agg(F.count("*").alias("tn"), exact_sum("volume_km3").alias("tv"))
    rows = every.join(counted, "age_class", "left").join(total, F.lit(True))
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0.0))
    return rows.select("age_order", "age_class", n.alias("families"), F.coalesce("s", F.lit(0)).alias("storms"), v.alias("volume_km3"), (n / F.col("tn")).alias("share"), (v / F.col("tv")).alias("volume_share"))
