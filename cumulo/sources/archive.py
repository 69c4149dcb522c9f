"""Where rain cubes and catalogues come from and go to.

The working form of a cube is Parquet partitioned by product and day with rows (t, y, x, r), t in half-hour steps from the
epoch; day files of an archive are listed and decoded by partition.  Decoders of HDF5 need a library that is not part of this
package and are passed in.
"""

from __future__ import annotations

import json
import math
import os
import subprocess
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.functions.constants import STEPS_PER_DAY
from cumulo.operators.checks import file_kind
from cumulo.sources import netcdf

DAY_FILE = r"_(\d{8})_\d{7}_halfhourly\.nc4$"  # fixed value: the archive's file names
MAX_ONLINE_DAYS = 31
FILL_BELOW = -100.0
CUBE = "t int, y int, x int, r double"

Decoder = Callable[[bytes], np.ndarray]


class Source:
    """Cubes by day; sources are made by :func:`get_source`."""

    name = "base"

    def days(self, first: date, last: date) -> DataFrame:
        raise NotImplementedError


class ParquetSource(Source):
    """The working form: partitions product=.../day=..., of which only those asked for are read."""

    name = "parquet"

    def __init__(self, spark: SparkSession, path: str, product: str = "final") -> None:
        self.spark, self.path, self.product = spark, path, product

    def days(self, first: date, last: date) -> DataFrame:
        rows = self.spark.read.schema(f"{CUBE}, product string, day date").parquet(self.path)
        return rows.where((F.col("product") == self.product) & F.col("day").between(first, last)).drop("product")


class LocalSource(Source):
    """Day files of an archive, found by name; ``decode`` turns a file's bytes into an array (time, lat, lon).

    Classic NetCDF files need no decoder; HDF5 ones do.
    """

    name = "local"

    def __init__(self, spark: SparkSession, path: str, decode: Decoder | None = None) -> None:
        self.spark, self.path, self.decode = spark, path, decode

    def index(self) -> DataFrame:
        """(day, path) of the files whose names have a date; others are ignored."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.nc4").load(self.path).select("path")
        return files.select(F.to_date(F.nullif(F.regexp_extract("path", DAY_FILE, 1), F.lit("")), "yyyyMMdd").alias("day"), "path").where("day IS NOT NULL")

    def days(self, first: date, last: date) -> DataFrame:
        decode = self.decode or (lambda content: netcdf.rain(content)[0])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for day, content in zip(b["day"], b["content"]):
                    values = decode(content)
                    t, y, x = np.nonzero(values > FILL_BELOW)
                    step = (day - date(1970, 1, 1)).days * STEPS_PER_DAY
                    yield pd.DataFrame({"t": (t + step).astype("int32"), "y": y.astype("int32"), "x": x.astype("int32"), "r": values[t, y, x].astype(float), "day": day})

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.nc4").load(self.path)
        day = F.to_date(F.nullif(F.regexp_extract("path", DAY_FILE, 1), F.lit("")), "yyyyMMdd")
        chosen = files.select(day.alias("day"), "content").where(F.col("day").between(first, last))
        return chosen.mapInPandas(run, f"{CUBE}, day date")


class UnavailableSource(Source):
    """A source that is known but needs a network or an account; asking it for days says so."""

    def __init__(self, name: str) -> None:
        self.name = name

    def days(self, first: date, last: date) -> DataFrame:
        raise NotImplementedError(f"the {self.name} source is not available here")


def get_source(name: str, spark: SparkSession, path: str = "", **options) -> Source:
    if name == "parquet":
        return ParquetSource(spark, path, **options)
    if name == "local":
        return LocalSource(spark, path, **options)
    if name in ("opendap", "gee"):
        return UnavailableSource(name)
    raise ValueError(f"unknown source {name!r}")


def guard_span(source: Source, wanted: int, have: int, allow_long: bool = False) -> None:
    """Online sources are asked for at most a month of days that aren't kept yet, unless allowed."""
    if source.name == "opendap" and wanted - have > MAX_ONLINE_DAYS and not allow_long:
        raise ValueError(f"{wanted - have} days to fetch; pass allow_long=True beyond {MAX_ONLINE_DAYS}")


def load_range(source: Source, first: date, last: date, allow_missing: bool = False) -> DataFrame:
    """Inclusive days of a source; a missing day is an error, never a gap."""
    rows = source.days(first, last)
    if not allow_missing:
        there = {r[0] for r in rows.select("day").distinct().collect()}
        lacking = [d for d in (first + timedelta(k) for k in range((last - first).days + 1)) if d not in there]
        if lacking:
            raise FileNotFoundError(f"{len(lacking)} days are missing, {lacking[0]} the first")
    return rows


def in_area(rows: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells strictly inside an area, by coordinate columns; reaches the scan as a filter."""
    return rows.where((F.col("lat") > lat[0]) & (F.col("lat") < lat[1]) & (F.col("lon") > lon[0]) & (F.col("lon") < lon[1]))


def keep_days(rows: DataFrame, path: str, product: str = "final") -> None:
    """Write days into the working form; only the partitions that ``rows`` has are replaced."""
    out = rows.withColumn("product", F.lit(product)).repartition("day")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("product", "day").parquet(path)


def kept_days(spark: SparkSession, path: str, product: str = "final") -> DataFrame:
    return ParquetSource(spark, path, product).spark.read.parquet(path).where(F.col("product") == product).select("day").distinct()


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    return file_kind(spark.read.format("binaryFile").load(path)).where("NOT ok")


def write_catalogue(storms: DataFrame, path: str, parameters: dict) -> None:
    """Storms by product, prominence, year and month; months present are replaced, others stay, so a build resumes by month."""
    out = storms
    for name, value in parameters.items():
        out = out.withColumn(f"param_{name}", F.lit(value))
    out = out.withColumn("product", F.lit(str(parameters.get("product", "final")))).withColumn("h", F.lit(float(parameters.get("prominence") or 0.0)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("product", "h", "year", "month").parquet(path)


def write_meta(spark: SparkSession, path: str, parameters: dict) -> None:
    """The parameters of a catalogue beside it, as ``<path>.meta.json``; numpy scalars become plain numbers."""
    plain = {k: v.item() if isinstance(v, np.generic) else v for k, v in parameters.items()}
    write_json(spark.createDataFrame([], "none int"), f"{path.rstrip('/')}.meta.json", plain)


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Regions, families, transitions or diurnal bins as Parquet."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Daily totals or sweeps as CSV with a header; small results, one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def revision(folder: str = ".") -> str:
    """Short git revision of a folder, with ``-dirty`` where files differ from it; ``unknown`` without git."""
    try:
        say = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        return say("rev-parse", "--short", "HEAD") + ("-dirty" if say("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def archive_folder(candidates: list[str], variable: str = "CUMULO_ARCHIVE", pattern: str = "*.nc4") -> str:
    """The folder named in the environment, or the candidate that holds most files; the first of equals."""
    if os.environ.get(variable):
        return os.environ[variable]
    held = {c: sum(1 for _ in Path(c).rglob(pattern)) for c in candidates if Path(c).is_dir()}
    if not held:
        raise FileNotFoundError(f"no archive among {', '.join(candidates)}; set {variable}")
    return max(held, key=held.get)


def read_catalogue(spark: SparkSession, path: str, product: str = "final", h: float = 4.0, exclude_years: tuple[int, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """Storms of one product and prominence; years and columns not asked for aren't read."""
    rows = spark.read.parquet(path).where((F.col("product") == product) & (F.col("h") == h))
    rows = rows.where(~F.col("year").isin(*exclude_years)) if exclude_years else rows
    return rows.select(*columns) if columns else rows


def catalogue_files(spark: SparkSession, path: str, product: str = "final", h: float = 4.0) -> DataFrame:
    """(path, length) of a catalogue's files of one product and prominence; an error if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    own = files.where(F.contains("path", F.lit(f"/product={product}/")) & F.contains("path", F.lit(f"/h={h}/")))
    if own.isEmpty():
        raise FileNotFoundError(f"no catalogue of product {product} at {h:g} mm/h in {path}")
    return own


def write_bad_days(bad: DataFrame, path: str, product: str, archive: str, deep: bool, n_indexed: int) -> None:
    """Bad days (day, reason) as one JSON file with what was checked beside them."""
    write_json(bad.orderBy("day"), path, {"product": product, "archive": archive, "checked": date.today().isoformat(), "deep": deep, "n_indexed": n_indexed})


def months_built(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("product", "h", "year", "month").distinct()


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """CSV sweeps with the method taken from the file's name."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    name = F.col("_metadata.file_name")
    return rows.withColumn("method", F.when(F.lower(name).contains("watershed"), "watershed").otherwise("mergetree"))


def write_json(rows: DataFrame, path: str, meta: dict, most: int = 100_000) -> None:
    """A small result as one JSON file with a meta block: NaN becomes null, floats have six decimals; larger results are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows; write Parquet instead")

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v if v is None or isinstance(v, (int, str, bool)) else str(v)

    body = json.dumps({"meta": meta, "rows": [{k: plain(v) for k, v in r.asDict(True).items()} for r in found]})
    spark = rows.sparkSession
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
