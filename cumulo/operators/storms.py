"""One row of attributes for each labelled object, its track, and the catalogue's bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.columns import cell_area_m2, volume_km3
from cumulo.functions.constants import DT_HOURS, GRID_DEG, LAT_FIRST, LON_FIRST


def _measured(labelled: DataFrame) -> DataFrame:
    area = cell_area_m2(F.lit(LAT_FIRST) + F.lit(GRID_DEG) * F.col("y"))
    return labelled.withColumn("area_m2", area).withColumn("v", volume_km3(F.col("r"), F.col("area_m2")))


def step_series(labelled: DataFrame) -> DataFrame:
    """(label, t, volume_km3, area_km2, peak_mm_hr, lat, lon): an object's every step; the centre is weighted by volume."""
    rows = _measured(labelled).groupBy("label", "t").agg(
        F.sum("v").alias("volume_km3"),
        (F.sum("area_m2") / 1e6).alias("area_km2"),
        F.max("r").alias("peak_mm_hr"),
        F.sum(F.col("v") * F.col("y")).alias("vy"),
        F.sum(F.col("v") * F.col("x")).alias("vx"),
        F.avg("y").alias("my"),
        F.avg("x").alias("mx"),
    )
    weighted = lambda v, m: F.when(F.col("volume_km3") > 0, F.col(v) / F.col("volume_km3")).otherwise(F.col(m))
    return rows.select("label", "t", "volume_km3", "area_km2", "peak_mm_hr", _lat(weighted("vy", "my")).alias("lat"), _lon(weighted("vx", "mx")).alias("lon"))


def _lat(index: Column) -> Column:
    return F.lit(LAT_FIRST) + F.lit(GRID_DEG) * index


def _lon(index: Column) -> Column:
    return F.lit(LON_FIRST) + F.lit(GRID_DEG) * index


def track_wkt(track: Column) -> Column:
    """LINESTRING of ``lon lat`` with four decimals; POINT for one vertex, LINESTRING EMPTY for none."""
    points = F.transform(track, lambda p: F.format_string("%.4f %.4f", p["lon"], p["lat"]))
    return F.when(F.size(track) == 1, F.concat(F.lit("POINT ("), points[0], F.lit(")"))).when(
        F.size(track) > 1, F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")"))
    ).otherwise(F.lit("LINESTRING EMPTY"))


def parse_track(wkt: Column) -> Column:
    """array of (lat, lon) of a POINT or LINESTRING; null for null, empty and malformed text."""
    numbers = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    body = F.regexp_extract(wkt, rf"^(?:POINT|LINESTRING) \(({numbers} {numbers}(?:, {numbers} {numbers})*)\)$", 1)
    parts = F.transform(F.split(body, ", "), lambda p: F.struct(F.split(p, " ")[1].try_cast("double").alias("lat"), F.split(p, " ")[0].try_cast("double").alias("lon")))
    return F.when(F.length(body) > 0, parts)


def storm_table(labelled: DataFrame, first_time: Column | None = None, extent: tuple[int, int, int] | None = None) -> DataFrame:
    """One row a label: times, duration, volume, peak, largest footprint, centroids, box, truncation, track.

    ``labelled`` is (t, y, x, r, label); steps are half hours from ``first_time`` (the epoch).  ``extent`` (steps, rows,
    columns) is the window's size for the truncation flags, by default the labelled cells' own.  Centroids are means of
    indices, plain and weighted by volume (weight 0: index 0).  The track has a vertex for each step with voxels.
    """
    rows = _measured(labelled)
    lo, hi = (rows.agg(F.min("t"), F.lit(0), F.lit(0)), rows.agg(F.max("t"), F.max("y"), F.max("x")))
    t0, y0, x0 = (0, 0, 0) if extent else lo.first()
    t1, y1, x1 = (n - 1 for n in extent) if extent else hi.first()
    start = F.lit("1970-01-01").cast("timestamp_ntz") if first_time is None else first_time
    at = lambda step: start + F.expr("INTERVAL '1' SECOND") * F.floor(step * F.lit(DT_HOURS * 3600)).cast("int")
    steps = step_series(labelled).groupBy("label").agg(
        F.max("area_km2").alias("max_area_km2"),
        F.transform(F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))), lambda p: p).alias("track"),
    )
    weight = F.sum("v")
    mean = lambda c: F.coalesce(F.sum(F.col("v") * F.col(c)) / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
    one = rows.groupBy("label").agg(
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
        F.count("*").alias("n_voxels"),
        weight.alias("total_volume_km3"),
        F.max("r").alias("max_intensity_mm_hr"),
        _lat(F.avg("y")).alias("centroid_lat"),
        _lon(F.avg("x")).alias("centroid_lon"),
        F.avg("t").alias("mt"),
        _lat(mean("y")).alias("wcentroid_lat"),
        _lon(mean("x")).alias("wcentroid_lon"),
        mean("t").alias("wt"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
    )
    joined = one.join(steps, "label")
    return joined.select(
        "label",
        at(F.col("t_min")).alias("start_time"),
        at(F.col("t_max")).alias("end_time"),
        (F.col("t_max") - F.col("t_min") + 1).alias("n_timesteps"),
        ((F.col("t_max") - F.col("t_min") + 1) * F.lit(DT_HOURS)).alias("duration_h"),
        "total_volume_km3",
        "max_intensity_mm_hr",
        "max_area_km2",
        "n_voxels",
        "centroid_lat",
        "centroid_lon",
        at(F.col("mt")).alias("centroid_time"),
        "wcentroid_lat",
        "wcentroid_lon",
        at(F.col("wt")).alias("wcentroid_time"),
        F.col("track")[0]["lat"].alias("start_lat"),
        F.col("track")[0]["lon"].alias("start_lon"),
        F.element_at("track", -1)["lat"].alias("end_lat"),
        F.element_at("track", -1)["lon"].alias("end_lon"),
        _lat(F.col("y0")).alias("bbox_lat_min"),
        _lat(F.col("y1")).alias("bbox_lat_max"),
        _lon(F.col("x0")).alias("bbox_lon_min"),
        _lon(F.col("x1")).alias("bbox_lon_max"),
        ((F.col("t_min") == t0) | (F.col("t_max") == t1)).alias("truncated_time"),
        ((F.col("y0") == y0) | (F.col("y1") == y1) | (F.col("x0") == x0) | (F.col("x1") == x1)).alias("truncated_space"),
        "track",
        track_wkt(F.col("track")).alias("track_wkt"),
    )


def with_hierarchy(storms: DataFrame, tree: DataFrame) -> DataFrame:
    """``storms`` with n_substorms and max_substorm_persistence of their own peak's component, by identity."""
    held = tree.groupBy(F.col("survivor").alias("label")).agg(F.count("*").alias("n"), F.max(F.col("birth") - F.col("death")).alias("p"))
    joined = storms.join(held, "label", "left")
    return joined.withColumn("n_substorms", F.coalesce("n", F.lit(0))).withColumn("max_substorm_persistence", F.coalesce("p", F.lit(0.0))).drop("n", "p")


def month_windows(days: DataFrame, overlap_days: int = 1) -> DataFrame:
    """(window_start, day, pad_left, pad_right): each calendar month's days and those up to ``overlap_days`` outside, as far as they exist."""
    months = days.select(F.trunc("day", "month").alias("window_start")).distinct()
    near = days.select("day", F.explode(F.array(*[F.trunc(F.date_add("day", k), "month") for k in range(-overlap_days, overlap_days + 1)])).alias("window_start")).distinct()
    rows = near.join(months, "window_start")
    return rows.select("window_start", "day", (F.col("day") < F.col("window_start")).alias("pad_left"), (F.col("day") > F.last_day("window_start")).alias("pad_right"))


def owned(storms: DataFrame, window_start: str = "window_start") -> DataFrame:
    """Storms whose weighted centroid falls into their window's month, with storm_uid year-month-label; a storm has one owner."""
    own = F.trunc("wcentroid_time", "month") == F.col(window_start)
    return storms.where(own).withColumn("storm_uid", F.concat_ws("-", F.year(window_start), F.month(window_start), F.col("label")))


def clear_time_truncation(storms: DataFrame) -> DataFrame:
    """A window padded on both sides truncates no owned storm in time."""
    return storms.withColumn("truncated_time", F.when((F.col("pad_left_days") > 0) & (F.col("pad_right_days") > 0), False).otherwise(F.col("truncated_time")))
