"""A catalogue from a cube: all months at once, each padded, each storm owned by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.functions.columns import inside
from cumulo.functions.constants import STEPS_PER_DAY
from cumulo.operators import mergetree, segment, storms
from cumulo.plans.shared import materialize
from cumulo.sources import commits


def build(cube: DataFrame, method: str = "mergetree", wet: float = 1.0, prominence: float = 4.0, min_voxels: int = 6, overlap_days: int = 1, grid: tuple[int, int] | None = None, built: DataFrame | None = None) -> DataFrame:
    """Storm catalogue of ``cube`` (day, t, y, x, r), t in half-hour steps from the epoch.

    Months (year, month) in ``built`` are there already and aren't made again.

    Months are windows with ``overlap_days`` around them, as far as those exist.  They are laid end to end with a gap, so one
    run segments them all and no voxel touches another window's.  A storm belongs to the month of its weighted
    centroid; storms seen from a neighbouring window go.  A window padded on both sides truncates none in time.  ``grid``
    is (rows, columns) for the truncation at edges, by default the extent of the wet cells.
    """
    if method not in ("mergetree", "watershed", "ccl"):
        raise ValueError(f"unknown method {method!r}")
    windows = storms.month_windows(cube.select("day").distinct(), overlap_days)
    if built is not None:
        done = built.select(F.make_date("year", "month", F.lit(1)).alias("window_start"))
        windows = windows.join(done, "window_start", "left_anti")
    span = (31 + 2 * overlap_days) * STEPS_PER_DAY + 2
    number = F.months_between("window_start", F.lit("1970-01-01").cast("date")).cast("int")
    ends = materialize(
        windows.groupBy("window_start").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.sum(F.col("pad_left").cast("int")).alias("pad_left_days"), F.sum(F.col("pad_right").cast("int")).alias("pad_right_days"))
        .withColumn("w", number).withColumn("shift", F.col("w") * span - F.unix_date("first") * STEPS_PER_DAY),
        "windows",
    )
    least = segment.ANY_RAIN if method == "watershed" else wet  # its seeds depend on the rain between peaks, however weak
    laid = cube.where(F.col("r") >= least).join(windows, "day").join(ends.select("window_start", "shift"), "window_start").select((F.col("t") + F.col("shift")).cast("int").alias("t"), "y", "x", "r")
    vox = materialize(segment.voxels(laid, least), "voxels")
    labelled = {
        "mergetree": lambda: mergetree.segment_at(vox, prominence, min_voxels, wet),
        "watershed": lambda: mergetree.label_watershed(vox, prominence, min_voxels, wet, F.floor(F.col("t") / span)),
        "ccl": lambda: segment.label_ccl(vox, min_voxels),
    }[method]()
    table = storms.storm_table(materialize(labelled, "labels"), extent=(2**31 - 1, *grid) if grid else None)
    step = F.floor(F.unix_seconds(F.col("start_time").cast("timestamp")) / 1800)
    rows = table.withColumn("step0", step).withColumn("w", F.floor(F.col("step0") / span).cast("int")).join(F.broadcast(ends), "w")
    back = F.expr("make_dt_interval(0, 0, 0, CAST(shift AS DECIMAL(18,6)) * 1800)")
    for c in ("start_time", "end_time", "centroid_time", "wcentroid_time"):
        rows = rows.withColumn(c, F.col(c) - back)
    first = F.col("w") * span
    length = (F.datediff("last", "first") + 1) * STEPS_PER_DAY
    rows = rows.withColumn("truncated_time", (F.col("step0") == first) | (F.col("step0") + F.col("n_timesteps") == first + length))
    rows = storms.clear_time_truncation(storms.owned(rows)).withColumn("year", F.year("window_start")).withColumn("month", F.month("window_start"))
    return rows.drop("w", "shift", "step0", "first", "last", "window_start")


def resume(cube: DataFrame, path: str, parameters: dict, months_at_once: int = 12, **options) -> list[commits.Month]:
    """Build the months of ``cube`` that the catalogue at ``path`` lacks or can't read, some at a time, and commit each time.

    A build that is stopped goes on where its last commit was.  ``parameters`` name product and prominence and are kept with the storms;
    ``options`` go to :func:`build`.  The months made are returned.
    """
    spark, product, h = cube.sparkSession, str(parameters.get("product", "final")), float(parameters.get("prominence") or 0.0)
    there = [(product, h, r["year"], r["month"]) for r in cube.select(F.year("day").alias("year"), F.month("day").alias("month")).distinct().orderBy("year", "month").collect()]
    todo, made = commits.missing(spark, path, there), []
    for at in range(0, len(todo), months_at_once):
        now = todo[at : at + months_at_once]
        done = spark.createDataFrame([m[2:] for m in there if m not in now], "year int, month int")
        made += commits.commit(materialize(build(cube, prominence=h, built=done, **options), "storms"), path, parameters, now)
    return made


def event(cube: DataFrame, first: str, last: str, bbox: tuple[float, float, float, float] | None = None, pad_days: int = 1, prominence: float = 4.0, min_voxels: int = 6, wet: float = 1.0) -> DataFrame:
    """Storms of the days ``first`` to ``last`` segmented anew, with ``in_box``: the domain and a box from one segmentation.

    The cube is padded by ``pad_days`` so that storms keep what lies over the ends; a storm belongs to the event if its weighted
    centroid's day does, and to the box (lat0, lat1, lon0, lon1) by its weighted centroid.  Without a box every storm is in.
    """
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    near = cube.where(F.col("day").between(F.date_sub(a, pad_days), F.date_add(b, pad_days)))
    vox = materialize(segment.voxels(near.select("t", "y", "x", "r"), wet), "voxels")
    table = storms.storm_table(materialize(mergetree.segment_at(vox, prominence, min_voxels, wet), "labels"))
    held = inside(F.col("wcentroid_lat"), F.col("wcentroid_lon"), bbox) if bbox else F.lit(True)
    return table.where(F.to_date("wcentroid_time").between(a, b)).withColumn("in_box", held)
