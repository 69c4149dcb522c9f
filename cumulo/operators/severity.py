"""Nine severity classes on bands of volume and peak rate, ranks in a reference population, concentration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import untruncated
from cumulo.functions.constants import MIN_RECORD_YEARS, PERCENTILE_BANDS, SEVERITY_NAMES, STORM_RATE_BANDS
from cumulo.plans.ranking import kth_largest, quantiles, ranked


@dataclass(frozen=True)
class Scale:
    """Edges of the volume and intensity bands; a value at an edge belongs to the band above.  An edge without any reference is null."""

    volume: tuple[float | None, float | None]
    intensity: tuple[float | None, float | None]
    years: float
    storms: int
    by_rate: bool
    bands: tuple[float, float]

    @property
    def basis(self) -> str:
        return "return_period" if self.years >= MIN_RECORD_YEARS else "percentile"

    def describe(self) -> str:
        kind = "a year" if self.by_rate else "percentile"
        shown = lambda x, digits, unit: "no" + unit if x is None else f"{x:.{digits}f}{unit}"
        edges = "; ".join(f"{b:g} {kind}: {shown(v, 4, ' km3')}, {shown(i, 1, ' mm/hr')}" for b, v, i in zip(self.bands, self.volume, self.intensity))
        return f"{self.storms:,} storms over {self.years:.1f} years, by {self.basis.replace('_', ' ')}; {edges}"


def fit(ref: DataFrame, years: float, volume: str = "total_volume_km3", intensity: str = "max_intensity_mm_hr", bands: tuple[float, float] | None = None, rate_bands: tuple[float, float] = STORM_RATE_BANDS, exclude_truncated: bool = True) -> Scale:
    """Scale of a reference population.

    From ten years on, and unless percentile ``bands`` are given, edges are the values exceeded ``rate_bands`` times a year:
    the k-th largest non-null one with k = round(rate * years), halves to even, within 1..n.  Else they are percentiles.
    Truncated storms are left out where the columns exist.  Without any value the edges are null.
    """
    if exclude_truncated and "truncated_time" in ref.columns:
        ref = ref.where(untruncated())
    n = ref.count()
    if years >= MIN_RECORD_YEARS and bands is None:
        edges = []
        for c in (volume, intensity):
            known = ref.where(F.col(c).isNotNull()).count()
            ks = [min(max(round(r * years), 1), known) for r in rate_bands]
            found = dict(map(tuple, kth_largest(ref, c, ks).collect())) if known else {}
            edges.append(tuple(found.get(k) for k in ks))
        return Scale(edges[0], edges[1], years, n, True, rate_bands)
    bands = bands or PERCENTILE_BANDS
    edges = []
    for c in (volume, intensity):
        found = dict(map(tuple, quantiles(ref, c, [b / 100 for b in bands]).collect()))
        edges.append(tuple(found[b / 100] for b in bands))
    return Scale(edges[0], edges[1], years, n, False, bands)


def edges(spark, scale: Scale) -> DataFrame:
    """The scale as rows (band, volume_km3, intensity_mm_hr)."""
    real = lambda x: None if x is None else float(x)
    rows = [(float(b), real(v), real(i)) for b, v, i in zip(scale.bands, scale.volume, scale.intensity)]
    return spark.createDataFrame(rows, "band double, volume_km3 double, intensity_mm_hr double")


def band(value: Column, at: tuple[float | None, float | None]) -> Column:
    """0, 1 or 2 by the edges; null for a null value or edge."""
    return sum(((value >= F.lit(x).cast("double")).cast("int") for x in at[1:]), (value >= F.lit(at[0]).cast("double")).cast("int"))


def classify(df: DataFrame, scale: Scale, volume: str = "total_volume_km3", intensity: str = "max_intensity_mm_hr") -> DataFrame:
    """``df`` with vol_band, int_band, severity_index (3 * volume + intensity), severity and severity_basis."""
    names = F.array(*[F.lit(n) for n in SEVERITY_NAMES])
    rows = df.withColumn("vol_band", band(F.col(volume), scale.volume)).withColumn("int_band", band(F.col(intensity), scale.intensity))
    rows = rows.withColumn("severity_index", F.col("vol_band") * 3 + F.col("int_band"))
    return rows.withColumn("severity", F.element_at(names, F.col("severity_index") + 1)).withColumn("severity_basis", F.lit(scale.basis))


def occupancy(classified: DataFrame, years: float) -> DataFrame:
    """Storms of each of the nine classes, none left out, with yearly rate and share."""
    spark = classified.sparkSession
    every = spark.createDataFrame(list(enumerate(SEVERITY_NAMES)), "severity_index int, severity string")
    counted = classified.groupBy("severity_index").agg(F.count("*").alias("n"))
    total = classified.count()
    rows = every.join(counted, "severity_index", "left").withColumn("storms", F.coalesce("n", F.lit(0)))
    return rows.select("severity_index", "severity", "storms", (F.col("storms") / F.lit(float(years))).alias("per_year"), (F.col("storms") / F.lit(float(max(total, 1)))).alias("share"))


def percentile_of(values: DataFrame, ref: DataFrame, value: str, ref_value: str, years: float | None = None, side: str = "right") -> DataFrame:
    """``values`` with ``percentile`` of the reference at or under (side right) or under (left) each value, and ``larger``.

    The different values and the reference are ranked together by range, so neither is collected, and results join on the
    value; ``larger`` counts reference values strictly above.  A null value has nulls.  With ``years``, ``return_years`` is
    years / max(larger, 1).
    """
    first = 0 if side == "right" else 1
    both = ref.select(F.col(ref_value).cast("double").alias("_v"), F.lit(first).alias("_own"), F.lit(1).alias("_ref")).where("_v IS NOT NULL")
    asked = values.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").distinct().select("_v", F.lit(1 - first).alias("_own"), F.lit(0).alias("_ref"))
    seen = ranked(both.union(asked), [F.col("_v"), F.col("_own")], running="_ref").where("_ref = 0").select(F.col("_v").alias("_value"), F.col("running").cast("long").alias("_under"))
    n = ref.where(F.col(ref_value).isNotNull()).count()
    larger = F.lit(n) - F.col("_under")
    if side == "left":
        equal = ref.groupBy(F.col(ref_value).cast("double").alias("_value")).agg(F.count("*").alias("_equal"))
        seen, larger = seen.join(equal, "_value", "left"), larger - F.coalesce("_equal", F.lit(0))
    under = seen.select("_value", (F.col("_under") / F.lit(float(max(n, 1))) * 100).alias("percentile"), larger.alias("larger"))
    out = values.join(under, values[value].cast("double") == under["_value"], "left").drop("_value")
    return out if years is None else out.withColumn("return_years", F.lit(float(years)) / F.greatest("larger", F.lit(1)))


def contribution(df: DataFrame, fractions: tuple[float, ...] = (0.01, 0.05, 0.10, 0.13, 0.20, 0.50), value: str = "total_volume_km3", key: str = "storm_uid") -> DataFrame:
    """Share of the volume in the largest fraction of storms: (top_frac, n_storms, volume_share).

    The count is round(fraction * n), halves to even; where that is 0 the largest storm stands for it.
    """
    rows = ranked(df, [F.desc(value), F.col(key)], running=value)
    asked = df.sparkSession.createDataFrame([(float(f),) for f in fractions], "top_frac double")
    count = F.bround(F.col("top_frac") * F.col("total_rows")).cast("long")
    return rows.join(F.broadcast(asked), F.col("rank") == F.greatest(count, F.lit(1))).select("top_frac", count.alias("n_storms"), (F.col("running") / F.col("total")).alias("volume_share"))


def concentration_curve(df: DataFrame, points: int = 400, value: str = "total_volume_km3", key: str = "storm_uid") -> DataFrame:
    """Running share of volume at ranks spaced evenly by logarithm: (rank, storm_frac, volume_frac)."""
    rows = ranked(df, [F.desc(value), F.col(key)], running=value)
    n = df.count()
    steps = df.sparkSession.range(points).select(F.round(F.pow(F.lit(float(max(n, 1))), F.col("id") / F.lit(float(points - 1)))).cast("long").alias("rank")).distinct()
    return rows.join(F.broadcast(steps), "rank").select("rank", (F.col("rank") / F.col("total_rows")).alias("storm_frac"), (F.col("running") / F.col("total")).alias("volume_frac"))


def rank_context(event: DataFrame, ref: DataFrame, levels: tuple[float, ...] = (50, 90, 99, 99.9, 99.99), value: str = "total_volume_km3") -> DataFrame:
    """Event storms above each quantile of the reference: (quantile, threshold_km3, n, share_pct)."""
    at = quantiles(ref, value, [q / 100 for q in levels])
    total = event.count()
    counted = event.join(F.broadcast(at), F.col(value) > F.col("value")).groupBy("level").agg(F.count("*").alias("n"))
    rows = at.join(counted, "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select(F.round(F.col("level") * 100, 6).alias("quantile"), F.col("value").alias("threshold_km3"), "n", (F.col("n") / F.lit(float(max(total, 1))) * 100).alias("share_pct"))


def share_needed(df: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.97, 0.99), value: str = "total_volume_km3", key: str = "storm_uid") -> DataFrame:
    """Smallest fraction of storms, largest first, that reaches each share of the volume."""
    rows = ranked(df, [F.desc(value), F.col(key)], running=value)
    asked = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    reached = rows.join(F.broadcast(asked), F.col("running") / F.col("total") >= F.col("share"))
    return reached.groupBy("share").agg((F.min("rank") / F.max("total_rows")).alias("storm_frac"))


def regional_bias(classified: DataFrame, years: float, notable: int = 6) -> DataFrame:
    """Storms of the three highest classes a year in each region, and relative to the region that has most."""
    rows = classified.groupBy("region").agg(F.sum((F.col("severity_index") >= notable).cast("long")).alias("notable"))
    top = F.max("notable").over(Window.partitionBy())
    return rows.select("region", "notable", (F.col("notable") / F.lit(float(years))).alias("per_year"), (F.col("notable") / F.nullif(top, F.lit(0))).alias("of_most"))
