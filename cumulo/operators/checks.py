"""Checks of cubes, archives and catalogues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from cumulo.functions.constants import STEPS_PER_DAY

HDF5 = "894844460D0A1A0A"  # fixed values: first bytes of HDF5 and classic NetCDF files
NETCDF = ("43444601", "43444602")


def days_complete(cube: DataFrame, steps: int = STEPS_PER_DAY) -> DataFrame:
    """(day, steps, complete)."""
    return cube.groupBy(F.floor(F.col("t") / steps).cast("int").alias("day")).agg(F.count_distinct("t").alias("steps")).withColumn("complete", F.col("steps") == steps)


def uniform_step(times: DataFrame, column: str = "t") -> DataFrame:
    """(gap, n): how often each distance between neighbouring distinct times occurs; uniform if there is one row."""
    order = Window.orderBy(column)
    rows = times.select(column).distinct().withColumn("gap", F.col(column) - F.lag(column).over(order))
    return rows.where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


class RangeGuard:
    """All that a loaded range must hold, checked in the pass that reads it.

    ``attach`` gives the rows on, and a row outside of the range or grid stops the job where it is read; what only the whole can tell is
    observed on the way, and ``verify`` raises after any action on the rows: steps that are missing, which also make the step uneven, a
    grid that isn't full, more than half of the rates missing, latitudes that fall with their index.  Steps are observed as a set, which the
    range bounds.
    """

    def __init__(self, first: date, last: date, rows: int, columns: int) -> None:
        self.begin, self.steps = (first - date(1970, 1, 1)).days * STEPS_PER_DAY, ((last - first).days + 1) * STEPS_PER_DAY
        self.rows, self.columns, self.seen = rows, columns, None

    def attach(self, cube: DataFrame) -> DataFrame:
        """``cube`` (t, y, x, r, and lat where it has one), to be used in place of it."""
        t, y, x = F.col("t"), F.col("y"), F.col("x")
        inside = t.between(self.begin, self.begin + self.steps - 1) & y.between(0, self.rows - 1) & x.between(0, self.columns - 1)
        told = F.format_string("step %d, row %d, column %d is outside of the range", t, y, x)
        held = cube.withColumn("t", F.when(F.coalesce(inside, F.lit(False)), t).otherwise(F.raise_error(told).cast("int")))
        rising = F.coalesce(F.min_by("lat", "y") <= F.max_by("lat", "y"), F.lit(True)) if "lat" in cube.columns else F.min(F.lit(True))
        self.seen = Observation()
        missing = (F.col("r").isNull() | F.isnan("r")).cast("long")
        return held.observe(
            self.seen,
            F.size(F.collect_set("t")).alias("steps"),
            F.count("*").alias("cells"),
            F.coalesce(F.sum(missing), F.lit(0)).alias("missing"),
            F.coalesce(F.max("y") + 1, F.lit(0)).alias("rows"),
            F.coalesce(F.max("x") + 1, F.lit(0)).alias("columns"),
            rising.cast("int").alias("rising"),
        )

    def verify(self, dense: bool = True) -> dict:
        """What was observed; raises if the range isn't whole.  A sparse cube, ``dense`` false, may lack cells."""
        if self.seen is None:
            raise RuntimeError("attach the guard to the rows first")
        got = dict(self.seen.get)
        if got["steps"] != self.steps:
            raise ValueError(f"{got['steps']} steps, expected {self.steps} at every half hour")
        if dense and (got["rows"], got["columns"], got["cells"]) != (self.rows, self.columns, self.steps * self.rows * self.columns):
            raise ValueError(f"{got['cells']} cells on a grid of {got['rows']} x {got['columns']}, expected {self.rows} x {self.columns} at {self.steps} steps")
        if got["missing"] > 0.5 * got["cells"]:
            raise ValueError(f"{got['missing'] / got['cells']:.1%} of the rates are missing")
        if got["rising"] == 0:
            raise ValueError("latitudes fall with their index")
        return got


def calendar_gaps(days: DataFrame, column: str = "day") -> DataFrame:
    """Calendar days between the first and the last that are absent."""
    ends = days.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(days.select(F.col(column).alias("day")), "day", "left_anti")


def usable_days(available: DataFrame, bad: DataFrame) -> DataFrame:
    return available.join(bad, "day", "left_anti")


def bad_by_month(bad: DataFrame) -> DataFrame:
    return bad.groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(F.count("*").alias("days"))


def cube_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-4, limit: float = 1e-3) -> DataFrame:
    """Cells of either cube compared, a missing one as 0: largest difference, how many beyond ``tolerance``, same or not."""
    both = a.select("t", "y", "x", F.col("r").alias("ra")).join(b.select("t", "y", "x", F.col("r").alias("rb")), ["t", "y", "x"], "full")
    d = F.abs(F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)))
    rows = both.agg(F.count("*").alias("cells"), F.max(d).alias("max_diff"), F.sum((d > tolerance).cast("long")).alias("differing"))
    return rows.withColumn("same", F.coalesce(F.col("max_diff") < limit, F.lit(True)))


def distinct_frames(cube: DataFrame) -> DataFrame:
    """Share of steps whose rounded sum is theirs alone in kind; under one half frames are copies of each other."""
    sums = cube.groupBy("t").agg(F.round(F.sum("r"), 3).alias("s"))
    return sums.agg(F.count("*").alias("steps"), F.count_distinct("s").alias("distinct")).withColumn("ok", F.col("distinct") >= F.col("steps") / 2)


def missing_share(cube: DataFrame) -> DataFrame:
    return cube.agg(F.avg((F.col("r").isNull() | F.isnan("r")).cast("int")).alias("missing"))


def file_kind(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows with ``ok``: the first bytes are those of HDF5 or classic NetCDF."""
    head = F.hex(F.substring("content", 1, 8))
    return files.select("path", "length", ((head == HDF5) | F.substring(head, 1, 8).isin(*NETCDF)).alias("ok"))


def file_reason(files: DataFrame, least_bytes: int = 10_000) -> DataFrame:
    """Why a day file can't be used, or null."""
    head = F.hex(F.substring("content", 1, 8))
    good = (head == HDF5) | F.substring(head, 1, 8).isin(*NETCDF)
    return files.select("path", F.when(F.col("content").isNull(), "missing").when(F.col("length") < least_bytes, "too_small").when(~good, "not_a_data_file").alias("reason"))


def same_parameters(cat: DataFrame, columns: list[str]) -> None:
    """Raise unless all rows were made with the same parameters."""
    if cat.select(*columns).distinct().limit(2).count() > 1:
        raise ValueError(f"the catalogues differ in {', '.join(columns)}")
