"""Events: families or days of an area in a window, ranked against the record."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import EXACT, exact_sum, inside
from cumulo.functions.constants import FAMILY_RATE_BANDS
from cumulo.operators.severity import Scale, classify, fit, percentile_of
from cumulo.plans.ranking import kth_largest

Box = tuple[float, float, float, float]


def storms_in_window(cat: DataFrame, t0: str, t1: str, bbox: Box | None = None, n: int | None = None, start: tuple[str, str] = ("wcentroid_lat", "wcentroid_lon"), end: tuple[str, str] | None = None) -> DataFrame:
    """Storms that overlap [t0, t1], start or end in the box if one is given, largest first."""
    rows = cat.where((F.col("start_time") <= F.lit(t1).cast("timestamp_ntz")) & (F.col("end_time") >= F.lit(t0).cast("timestamp_ntz")))
    if bbox:
        hit = inside(F.col(start[0]), F.col(start[1]), bbox)
        rows = rows.where(hit | inside(F.col(end[0]), F.col(end[1]), bbox) if end else hit)
    rows = rows.orderBy(F.desc("total_volume_km3"), "storm_uid")
    return rows.limit(n) if n else rows


def event_families(fam: DataFrame, t0: str, t1: str, bbox: Box | None = None) -> DataFrame:
    """Families that overlap the window with their mean place in the box."""
    rows = fam.where((F.col("start") <= F.lit(t1).cast("timestamp_ntz")) & (F.col("end") >= F.lit(t0).cast("timestamp_ntz")))
    return rows.where(inside(F.col("lat"), F.col("lon"), bbox)) if bbox else rows


def family_scale(fam: DataFrame, years: float, rate_bands: tuple[float, float] = FAMILY_RATE_BANDS) -> Scale:
    return fit(fam, years, "volume_km3", "max_intensity_mm_hr", rate_bands=rate_bands, exclude_truncated=False)


def rank_event(fam: DataFrame, t0: str, t1: str, years: float, bbox: Box | None = None, scale: Scale | None = None) -> DataFrame:
    """The event's largest family among all: rank counts those at least as large (1 at least), T = years / rank.

    A return period is supported within [1, years].  Without any family the one row has n_families 0.
    """
    event = event_families(fam, t0, t1, bbox)
    scale = scale or family_scale(fam, years)
    top = classify(event.orderBy(F.desc("volume_km3"), "fam").limit(1), scale, "volume_km3").select("fam", "n_storms", "volume_km3", "max_intensity_mm_hr", "age_h", "severity", "severity_index")
    whole = event.agg(F.count("*").alias("n_families"), exact_sum("volume_km3").alias("combined_volume_km3"))
    ref = fam.select(F.col("volume_km3").alias("ref")).join(F.broadcast(top.select(F.col("volume_km3").alias("own"))), F.lit(True))
    place = ref.agg(F.sum((F.col("ref") >= F.col("own")).cast("long")).alias("k"), F.sum((F.col("ref") < F.col("own")).cast("long")).alias("below"), F.count("*").alias("n_reference"))
    rows = whole.join(top, F.lit(True), "left").join(place, F.lit(True), "left")
    rank = F.greatest("k", F.lit(1))
    period = F.lit(float(years)) / rank
    return rows.select(
        "n_families", "combined_volume_km3", "fam", "n_storms", "volume_km3", "max_intensity_mm_hr", "age_h", "severity", "severity_index",
        (F.col("below") / F.col("n_reference") * 100).alias("percentile"),
        F.when(F.col("n_families") > 0, rank).alias("rank"),
        F.when(F.col("n_families") > 0, period).alias("return_years"),
        F.when(F.col("n_families") > 0, period.between(1.0, float(years))).alias("supported"),
    )


def area_daily(cat: DataFrame, bbox: Box) -> DataFrame:
    """(day, volume_km3) of storms whose weighted centroid is in the box; every day from first to last, dry ones 0.  Truncated storms count."""
    rows = cat.where(inside(F.col("wcentroid_lat"), F.col("wcentroid_lon"), bbox)).groupBy(F.to_date("wcentroid_time").alias("day")).agg(exact_sum("total_volume_km3").alias("v"))
    days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(rows, "day", "left").select("day", F.coalesce("v", F.lit(0.0)).alias("volume_km3"))


def annual_maxima(daily: DataFrame, days: int) -> DataFrame:
    """(year, volume_km3): largest trailing sum of ``days`` days in years with at least 364 days; the first sums are of fewer days."""
    order = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    rows = daily.withColumn("roll", F.sum(F.col("volume_km3").cast(EXACT)).over(order).cast("double"))
    return rows.groupBy(F.year("day").alias("year")).agg(F.max("roll").alias("volume_km3"), F.count("*").alias("n")).where(F.col("n") >= 364).drop("n")


def area_rank(daily: DataFrame, t0: str, t1: str) -> DataFrame:
    """The window's total against annual maxima: rank, Weibull return period (n + 1) / rank, verdict and ratio to the median."""
    first, last = F.to_date(F.lit(t0)), F.to_date(F.lit(t1))
    days = (date.fromisoformat(t1) - date.fromisoformat(t0)).days + 1
    value = daily.where(F.col("day").between(first, last)).agg(F.coalesce(exact_sum("volume_km3"), F.lit(0.0)).alias("value_km3"))
    rows = annual_maxima(daily, days).join(F.broadcast(value), F.lit(True), "right")
    out = rows.groupBy("value_km3").agg(F.count("volume_km3").alias("n_years"), F.coalesce(F.sum((F.col("volume_km3") > F.col("value_km3")).cast("long")), F.lit(0)).alias("bigger"), F.expr("percentile(volume_km3, 0.5)").alias("median"))
    rank = F.col("bigger") + 1
    verdict = F.when(rank == 1, "highest in the record").when(rank > F.col("n_years") / 2, "below the typical annual maximum").otherwise(F.concat(F.lit("about 1 in "), F.bround((F.col("n_years") + 1) / rank).cast("int"), F.lit(" years")))
    return out.select(F.lit(days).alias("window_days"), "value_km3", "n_years", rank.alias("rank"), ((F.col("n_years") + 1) / rank).alias("return_years"), verdict.alias("verdict"), F.round(F.col("median"), 9).alias("median_km3"), F.round(F.col("value_km3") / F.nullif("median", F.lit(0.0)), 9).alias("ratio_to_median"))


def band_sensitivity(fam: DataFrame, years: float, pairs: tuple[tuple[float, float], ...] = ((500.0, 50.0), (200.0, 20.0), (100.0, 10.0), (50.0, 5.0), (20.0, 2.0))) -> DataFrame:
    """Share of families in the lowest and the highest class for several band rates.

    A band edge is the k-th largest value, k families of the record for its rate; the top rows give the edges of all pairs, and one pass
    counts what lies below the lower and at or above the upper edges of both measures.
    """
    measures = ("volume_km3", "max_intensity_mm_hr")
    n = fam.agg(F.count("*"), *[F.count(m) for m in measures]).first()
    place = lambda rate, held: min(max(round(rate * years), 1), held)
    edges = {}
    for m, held in zip(measures, n[1:]):
        ks = {rate: place(rate, held) for pair in pairs for rate in pair}
        known = dict(map(tuple, kth_largest(fam, m, sorted(set(ks.values()))).collect())) if held else {}
        edges[m] = {rate: known.get(k) for rate, k in ks.items()}
    both = lambda test: F.sum(F.coalesce(test(measures[0]) & test(measures[1]), F.lit(False)).cast("long"))
    below = lambda rate: lambda m: F.col(m) < F.lit(edges[m][rate])
    above = lambda rate: lambda m: F.col(m) >= F.lit(edges[m][rate])
    found = fam.agg(*[both(f) for low, high in pairs for f in (below(low), above(high))]).first()
    rows = [(low, high, (found[2 * i] or 0) / max(n[0], 1), (found[2 * i + 1] or 0) / max(n[0], 1)) for i, (low, high) in enumerate(pairs)]
    return fam.sparkSession.createDataFrame(rows, "low_rate double, high_rate double, lowest_share double, highest_share double")


def area_windows(cat: DataFrame, boxes: dict[str, Box], starts: tuple[str, str], days: tuple[int, ...] = (1, 2, 3, 5, 7)) -> DataFrame:
    """:func:`area_rank` of several areas and window lengths that end together."""
    out = None
    for name, bbox in boxes.items():
        daily = area_daily(cat, bbox)
        for n in days:
            first = date.fromisoformat(starts[1]) - timedelta(n - 1)
            row = area_rank(daily, first.isoformat(), starts[1]).select(F.lit(name).alias("area"), "*")
            out = row if out is None else out.union(row)
    return out


def top_events(fam: DataFrame, years: float, n: int = 12) -> DataFrame:
    """The largest families with their class and the percentile of families below."""
    top = classify(fam.orderBy(F.desc("volume_km3"), "fam").limit(n), family_scale(fam, years), "volume_km3")
    return percentile_of(top, fam, "volume_km3", "volume_km3", side="left").select("fam", "volume_km3", "severity", "percentile")
