"""Everything that the panels of a catalogue show, from one scan and one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.functions.columns import exact_sum, untruncated

SETS = {"all": (), "year": ("year",), "year_month": ("year", "month"), "cell_month": ("glat", "glon", "month")}


def panels(cat: DataFrame, deg: float = 1.0) -> DataFrame:
    """One long table: ``panel`` and its keys (null where they don't belong to it), then the sums that the panels need.

    Panels are ``all``, ``year``, ``year_month`` and ``cell_month`` (lower corner of a grid cell of ``deg`` degrees; storms without a place
    are in none).  A single aggregation over grouping sets: each storm is read once and combined before the shuffle.  Medians hold a count
    for each different duration, which are half hours.  ``months`` counts the different months.
    """
    rows = cat.select("year", "month", (F.floor(F.col("wcentroid_lat") / deg) * deg).alias("glat"), (F.floor(F.col("wcentroid_lon") / deg) * deg).alias("glon"), "duration_h", "total_volume_km3", "max_intensity_mm_hr", untruncated().alias("whole"))
    keys = ["year", "month", "glat", "glon"]
    held = rows.groupingSets([[F.col(k) for k in s] for s in SETS.values()], *keys).agg(
        F.grouping_id(*keys).alias("_set"),
        F.count("*").alias("storms"),
        F.sum(F.col("whole").cast("long")).alias("untruncated"),
        exact_sum("total_volume_km3").alias("volume_km3"),
        exact_sum(F.when(F.col("whole"), F.col("total_volume_km3"))).alias("untruncated_km3"),
        F.max("max_intensity_mm_hr").alias("max_intensity_mm_hr"),
        F.expr("percentile(duration_h, 0.5)").alias("median_duration_h"),
        F.round(F.expr("percentile(duration_h, 0.95)"), 6).alias("p95_duration_h"),
        F.expr("bit_count(bit_or(shiftleft(1, CAST(month AS INT))))").cast("long").alias("months"),
    )
    number = {sum(2 ** (len(keys) - 1 - n) for n, k in enumerate(keys) if k not in s): name for name, s in SETS.items()}
    name = F.coalesce(*[F.when(F.col("_set") == n, F.lit(p)) for n, p in number.items()]).alias("panel")
    return held.select(name, *[c for c in held.columns if c != "_set"]).where("panel <> 'cell_month' OR (glat IS NOT NULL AND glon IS NOT NULL)")


def panel(table: DataFrame, name: str) -> DataFrame:
    """The rows and keys of one panel."""
    return table.where(F.col("panel") == name).drop("panel", *{k for s in SETS.values() for k in s if k not in SETS[name]})
