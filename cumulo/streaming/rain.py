"""Streams of rain cells: daily totals and wet spells as data arrive.  An extension of this package's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.operators.cubes import volume


def daily_totals(cells: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, volume_km3, max_mm_hr) of tumbling days from streamed (ts, y, x, r); state ends ``late`` behind the newest cell."""
    return cells.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.sum(volume()).alias("volume_km3"), F.max("r").alias("max_mm_hr"))


def wet_spells(cells: DataFrame, gap: str = "3 hours", wet: float = 1.0, late: str = "1 day") -> DataFrame:
    """(y, x, spell, steps, depth_mm): runs of wet cells in one place with pauses shorter than ``gap``."""
    rows = cells.where(F.col("r") >= wet).withWatermark("ts", late)
    return rows.groupBy("y", "x", F.session_window("ts", gap).alias("spell")).agg(F.count("*").alias("steps"), F.sum(F.col("r") * 0.5).alias("depth_mm"))
