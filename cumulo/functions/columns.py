"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulo.functions.constants import DT_HOURS, EARTH_RADIUS_KM, EARTH_RADIUS_M, GRID_DEG, LAT_CELLS, LAT_FIRST, LON_CELLS, LON_FIRST

EXACT = "decimal(30,10)"


def exact_sum(c: Column | str) -> Column:
    """Sum that doesn't depend on the order of rows, as double: retried tasks and other partitionings give the same value."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(EXACT)).cast("double")


def correlation(y: Column | str, x: Column | str) -> Column:
    """Pearson's r as an aggregate that combines before a shuffle; null where either column doesn't vary."""
    return F.covar_pop(y, x) / F.nullif(F.stddev_pop(y) * F.stddev_pop(x), F.lit(0.0))


def untruncated() -> Column:
    return ~(F.col("truncated_time") | F.col("truncated_space"))


def cell_area_m2(lat: Column, deg: float = GRID_DEG) -> Column:
    """Area of a grid cell on the sphere by its centre's latitude."""
    half, width = F.lit(deg / 2), F.radians(F.lit(deg))
    return F.lit(EARTH_RADIUS_M**2) * width * (F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half)))


def volume_km3(rate: Column, area_m2: Column) -> Column:
    return rate * F.lit(DT_HOURS) / F.lit(1000.0) * area_m2 / F.lit(1e9)


def grid_index(value: Column, first: float, cells: int, deg: float = GRID_DEG) -> Column:
    """Index of the nearest cell, halves to even, clipped to the grid."""
    return F.least(F.greatest(F.bround((value - F.lit(first)) / F.lit(deg)).cast("int"), F.lit(0)), F.lit(cells - 1))


def cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    return grid_index(lat, LAT_FIRST, LAT_CELLS), grid_index(lon, LON_FIRST, LON_CELLS)


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def utc_offset(lon: Column) -> Column:
    """Hours of the civil zone by longitude."""
    return F.when(lon < 112.5, 7).when(lon < 127.5, 8).otherwise(9)


def inside(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive box (lat0, lat1, lon0, lon1)."""
    return lat.between(bbox[0], bbox[1]) & lon.between(bbox[2], bbox[3])
