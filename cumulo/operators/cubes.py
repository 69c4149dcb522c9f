"""Totals, accumulations, rolling maxima and displacement of a rain cube (t, y, x, r), half-hour steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import cell_area_m2, volume_km3
from cumulo.functions.constants import DT_HOURS, GRID_DEG, LAT_FIRST, STEPS_PER_DAY, WET_LEVELS


def volume(y: str = "y", r: str = "r") -> Column:
    """km3 that a voxel adds; a missing rate adds nothing."""
    rate = F.when(F.isnan(r) | F.col(r).isNull(), 0.0).otherwise(F.col(r))
    return volume_km3(rate, cell_area_m2(F.lit(LAT_FIRST) + F.lit(GRID_DEG) * F.col(y)))


def day(t: str = "t") -> Column:
    return F.floor(F.col(t) / STEPS_PER_DAY).cast("int")


def total_volume(cube: DataFrame) -> DataFrame:
    return cube.agg(F.round(F.sum(volume()), 9).alias("volume_km3"))


def step_volume(cube: DataFrame) -> DataFrame:
    return cube.groupBy("t").agg(F.round(F.sum(volume()), 9).alias("volume_km3"))


def daily_totals(cube: DataFrame, cells: int) -> DataFrame:
    """(day, volume_km3, wet_frac_1mm, max_mm_hr): the wet share is of all cells and steps of a day, rows or not."""
    rows = cube.groupBy(day().alias("day")).agg(F.round(F.sum(volume()), 9).alias("volume_km3"), F.sum((F.col("r") >= 1.0).cast("long")).alias("wet"), F.max("r").alias("max_mm_hr"))
    return rows.select("day", "volume_km3", (F.col("wet") / F.lit(float(cells * STEPS_PER_DAY))).alias("wet_frac_1mm"), "max_mm_hr")


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """By month of the days: total, mean, wet mean, maximum, days, share of all, wettest and driest day."""
    rows = daily.withColumn("month", F.month(F.date_from_unix_date("day")))
    out = rows.groupBy("month").agg(
        F.round(F.sum("volume_km3"), 6).alias("volume_km3"), F.round(F.avg("volume_km3"), 9).alias("mean_km3"), F.round(F.avg("wet_frac_1mm"), 9).alias("mean_wet_frac"),
        F.max("max_mm_hr").alias("max_mm_hr"), F.count("*").alias("days"), F.max_by("day", "volume_km3").alias("wettest_day"), F.min_by("day", "volume_km3").alias("driest_day"),
    )
    return out.withColumn("share", F.round(F.col("volume_km3") / F.sum("volume_km3").over(Window.partitionBy()), 6))


def wet_fractions(cube: DataFrame, voxels: int, levels: tuple[float, ...] = WET_LEVELS) -> DataFrame:
    """Share of all ``voxels`` at or over each level."""
    sums = cube.agg(*[F.sum((F.col("r") >= v).cast("long")).alias(f"n{i}") for i, v in enumerate(levels)])
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"n{i}").alias("n")) for i, v in enumerate(levels)]))
    return sums.select(at.alias("a")).select("a.level", (F.col("a.n") / F.lit(float(voxels))).alias("share"))


def box(cube: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Inclusive index box."""
    return cube.where(F.col("y").between(*y) & F.col("x").between(*x))


def accumulation(cube: DataFrame, t: tuple[int, int] | None = None) -> DataFrame:
    """(y, x, depth_mm) over inclusive steps, one decimal."""
    rows = cube.where(F.col("t").between(*t)) if t else cube
    return rows.groupBy("y", "x").agg(F.round(F.sum((F.col("r") * DT_HOURS).cast("decimal(20,6)")).cast("double"), 1).alias("depth_mm"))


def rolling_24h(cube: DataFrame, steps: int = STEPS_PER_DAY) -> DataFrame:
    """(y, x, max_24h_mm): each cell's largest depth over ``steps`` consecutive steps; null where fewer exist.

    A sparse cube needs no dense copy: a largest window can end at a wet step, so only windows that end there are summed.
    """
    ends = cube.agg((F.max("t") - F.min("t") + 1).alias("span"), F.min("t").alias("first"))
    window = Window.partitionBy("y", "x").orderBy("t").rangeBetween(-(steps - 1), 0)
    depth = F.sum((F.col("r") * DT_HOURS).cast("decimal(20,6)")).over(window).cast("double")
    rows = cube.withColumn("depth", depth).groupBy("y", "x").agg(F.max("depth").alias("depth"))
    return rows.join(F.broadcast(ends), F.lit(True)).select("y", "x", F.when(F.col("span") >= steps, F.col("depth")).alias("max_24h_mm"))


def rolling_summary(cells: DataFrame) -> DataFrame:
    """Over time first, then over space: the largest and the mean of the cells' maxima."""
    return cells.agg(F.max("max_24h_mm").alias("max_cell_mm"), F.round(F.avg("max_24h_mm"), 9).alias("mean_cell_mm"))


def local_days(cube: DataFrame, shift_h: int = 7) -> DataFrame:
    """(day, mean_mm, max_mm) of cells' depths by days of a shifted clock, over the cells that the cube has."""
    n = cube.select("y", "x").distinct().agg(F.count("*").alias("cells"))
    local = F.floor((F.col("t") + 2 * shift_h) / STEPS_PER_DAY).cast("int")
    rows = cube.groupBy(local.alias("day"), "y", "x").agg((F.sum("r") * DT_HOURS).alias("mm")).groupBy("day").agg(F.sum("mm").alias("sum"), F.max("mm").alias("max_mm"))
    return rows.join(n, F.lit(True)).select("day", F.round(F.col("sum") / F.col("cells"), 9).alias("mean_mm"), F.round("max_mm", 9).alias("max_mm"))


def hourly_cumulative(cube: DataFrame, cells: int) -> DataFrame:
    """(hour, mean_mm, max_mm, cumulative_mm): areal mean depth an hour, sum of its steps' largest depths, and running mean."""
    steps = cube.groupBy("t").agg(F.sum((F.col("r") * DT_HOURS).cast("decimal(20,6)")).alias("sum"), (F.max("r") * DT_HOURS).cast("decimal(20,6)").alias("top"))
    rows = steps.groupBy(F.floor(F.col("t") / 2).cast("int").alias("hour")).agg(F.sum("sum").alias("sum"), F.sum("top").alias("top"))
    running = F.sum("sum").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("hour", (F.col("sum").cast("double") / F.lit(float(cells))).alias("mean_mm"), F.col("top").cast("double").alias("max_mm"), (running.cast("double") / F.lit(float(cells))).alias("cumulative_mm"))


def displacement(cube: DataFrame, ny: int, nx: int, gap: int = 1, quiet: float = 1.0, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(t, dy, dx): whole-cell shift from each frame to the one ``gap`` steps later by phase correlation of log(1 + r).

    With a ``box`` (first and last row, first and last column, the last ones excluded) only that part of the frames counts.
    Frames whose largest log(1 + r) is under ``quiet`` are left out.  Two frames of a fixed grid meet in a task.
    """

    if box:
        y0, y1, x0, x1 = box
        cube = cube.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)
        ny, nx = y1 - y0, x1 - x0

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        def frame(rows: pd.DataFrame) -> np.ndarray:
            out = np.zeros((ny, nx))
            out[rows["y"], rows["x"]] = np.log1p(np.nan_to_num(rows["r"].to_numpy()))
            return out

        empty = pd.DataFrame({"t": pd.Series(dtype="int32"), "dy": pd.Series(dtype="int32"), "dx": pd.Series(dtype="int32")})
        if left.empty or right.empty:
            return empty
        a, b = frame(left), frame(right)
        if min(a.max(), b.max()) < quiet:
            return empty
        cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
        peak = np.unravel_index(np.argmax(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real), a.shape)
        dy, dx = (int(p) - n if p > n // 2 else int(p) for p, n in zip(peak, a.shape))
        return pd.DataFrame({"t": [key[0]], "dy": [dy], "dx": [dx]})

    now = cube.select("t", "y", "x", "r")
    # Columns of their own: both sides come from one table, whose columns cogroup would otherwise take for each other.
    later = cube.select((F.col("t") - gap).alias("t"), *[F.col(c).alias(c) for c in ("y", "x", "r")])
    return now.groupBy("t").cogroup(later.groupBy("t")).applyInPandas(run, "t int, dy int, dx int")


def advection(shifts: DataFrame) -> DataFrame:
    """Percentiles of the speed in cells a step, and shares beyond one cell and beyond the diagonal neighbour in space and time."""
    speed = F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    rows = shifts.withColumn("speed", speed)
    return rows.agg(F.expr("percentile(speed, array(0.5, 0.75, 0.9, 0.95, 0.99))").alias("percentiles"), F.avg((F.col("speed") > 1).cast("int")).alias("over_1"), F.avg((F.col("speed") > 3**0.5).cast("int")).alias("over_diagonal"))
