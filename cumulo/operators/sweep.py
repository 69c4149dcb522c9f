"""How counts and volumes depend on the prominence."""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import exact_sum
from cumulo.operators import mergetree
from cumulo.operators.storms import storm_table
from cumulo.plans.selection import select_quantiles
from cumulo.plans.shared import materialize


def month_bounds(year: int, month: int) -> tuple[date, date]:
    """First and last day of a month."""
    return date(year, month, 1), date(year, month, monthrange(year, month)[1])


def sweep(vox: DataFrame, heights: list[float], min_voxels: int = 6, wet: float = 1.0, month: str = "all") -> DataFrame:
    """One row a prominence: storms, percolation, captured share, volumes, durations, areas, truncated share.

    The tree and the flooding graph are made once, one flood cuts them at all prominences, and one set of histograms gives
    all quantiles.  A prominence that leaves no storm has a count of 0.
    """
    components, _ = mergetree.build(vox, wet)
    total, n = max(vox.count(), 1), len(heights)
    asked = vox.sparkSession.createDataFrame([(k, float(h)) for k, h in enumerate(heights)], "k int, h double")
    cut = mergetree.Flood(vox).cuts(materialize(components, "components"), heights, min_voxels).join(F.broadcast(asked), "h")
    table = storm_table(materialize(cut.withColumn("label", F.col("label") * n + F.col("k")), "labels"))
    storms = materialize(table.withColumn("k", F.pmod("label", F.lit(n)).cast("int")), "storms")
    rows = storms.groupBy("k").agg(
        F.count("*").alias("n_storms"),
        (F.max("n_voxels") / F.sum("n_voxels")).alias("percolation"),
        (F.sum("n_voxels") / total).alias("captured"),
        exact_sum("total_volume_km3").alias("vol_total_km3"),
        F.avg((F.col("truncated_time") | F.col("truncated_space")).cast("int")).alias("trunc_frac"),
    )
    wanted = {f"{name}_{level}_{unit}": (column, q) for name, unit, column, levels in _QUANTILES for level, q in levels}
    rows = rows.join(select_quantiles(storms, wanted, ["k"]), "k")
    known = asked.join(rows, "k", "left").fillna(0, ["n_storms", "percolation", "captured"])
    return known.select(F.lit(month).alias("month"), "h", F.lit("mergetree").alias("method"), "n_storms", "percolation", "captured", "vol_total_km3", *wanted, "trunc_frac")


_QUANTILES = (
    ("vol", "km3", "total_volume_km3", (("med", 0.5), ("p95", 0.95))),
    ("dur", "h", "duration_h", (("med", 0.5), ("p95", 0.95))),
    ("area", "km2", "max_area_km2", (("p95", 0.95),)),
)


def stability(counts: DataFrame, nominal: float = 4.0) -> DataFrame:
    """Change of the count from each prominence to the next, and over +-20 % of the nominal one.

    Steps of over a quarter decide nothing; else under a tenth is stable.  ``counts`` is (month, h, n_storms).
    """
    order = Window.partitionBy("month").orderBy("h")
    steps = counts.select("month", F.lag("h").over(order).alias("h_from"), F.col("h").alias("h_to"), F.lag("n_storms").over(order).alias("n0"), F.col("n_storms").alias("n1")).where("h_from IS NOT NULL")
    dh, dn = (F.col("h_to") - F.col("h_from")) / F.col("h_from"), (F.col("n1") - F.col("n0")) / F.nullif("n0", F.lit(0))
    verdict = F.when(F.abs(dh) > 0.25, "n/a - step too big").when(F.abs(dn) < 0.10, "stable").otherwise("UNSTABLE")
    each = steps.select("month", "h_from", "h_to", F.round(dh, 3).alias("d_h_frac"), F.round(dn, 3).alias("d_count_frac"), verdict.alias("verdict"))
    lo, hi = round(nominal * 0.8, 2), round(nominal * 1.2, 2)
    at = lambda h: F.max(F.when(F.round("h", 2) == h, F.col("n_storms")))
    span = counts.groupBy("month").agg(at(lo).alias("n0"), at(hi).alias("n1")).where("n0 IS NOT NULL AND n1 IS NOT NULL")
    change = (F.col("n1") - F.col("n0")) / F.col("n0")
    whole = span.select("month", F.lit(lo).alias("h_from"), F.lit(hi).alias("h_to"), F.lit(0.40).alias("d_h_frac"), F.round(change, 3).alias("d_count_frac"), F.when(F.abs(change) < 0.10, "STABLE over +/-20%").otherwise("UNSTABLE over +/-20%").alias("verdict"))
    return each.unionByName(whole)


def count_pivot(counts: DataFrame, months: list[str]) -> DataFrame:
    """Counts by prominence and month, with the ratio of the first to the second where there are two months."""
    wide = counts.groupBy("h").pivot("month", months).agg(F.first("n_storms"))
    return wide.withColumn("ratio", F.col(f"`{months[0]}`") / F.col(f"`{months[1]}`")) if len(months) == 2 else wide
