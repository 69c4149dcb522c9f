"""Totals of a storm catalogue by year and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import exact_sum, untruncated
from cumulo.plans.ranking import group_quantiles, kth_largest


def record_years(cat: DataFrame) -> DataFrame:
    """Length of the record: different (year, month) pairs over twelve."""
    return cat.agg((F.count_distinct("year", "month") / F.lit(12.0)).alias("record_years"))


def years_of(cat: DataFrame) -> float:
    return record_years(cat).first()[0]


def headline(cat: DataFrame) -> DataFrame:
    """Storms, untruncated share, volume, storms a year (of all and of untruncated storms)."""
    whole = F.sum(untruncated().cast("long"))
    years = F.count_distinct("year", "month") / F.lit(12.0)
    return cat.agg(
        F.count("*").alias("storms"),
        (whole / F.count("*")).alias("untruncated_share"),
        exact_sum("total_volume_km3").alias("volume_km3"),
        (F.count("*") / years).alias("storms_per_year"),
        (whole / years).alias("untruncated_per_year"),
    )


def by_year(cat: DataFrame) -> DataFrame:
    """Storms, volume, months present and volume a month of each year, untruncated storms; ``full`` marks twelve months."""
    rows = cat.where(untruncated()).groupBy("year").agg(F.count("*").alias("storms"), exact_sum("total_volume_km3").alias("volume_km3"), F.count_distinct("month").alias("months"))
    return rows.withColumn("volume_per_month", F.col("volume_km3") / F.col("months")).withColumn("full", F.col("months") == 12)


def interannual(cat: DataFrame) -> DataFrame:
    """Wettest and driest full year and their ratio."""
    full = by_year(cat).where("full")
    return full.agg(
        F.max_by("year", "volume_km3").alias("wettest_year"),
        F.max("volume_km3").alias("wettest_km3"),
        F.min_by("year", "volume_km3").alias("driest_year"),
        F.min("volume_km3").alias("driest_km3"),
        (F.max("volume_km3") / F.min("volume_km3")).alias("ratio"),
    )


def by_month(cat: DataFrame) -> DataFrame:
    """Storms, volume and share of each calendar month, untruncated storms of all years pooled."""
    rows = cat.where(untruncated()).groupBy("month").agg(F.count("*").alias("storms"), exact_sum("total_volume_km3").alias("volume_km3"))
    return rows.withColumn("share", F.col("volume_km3") / F.sum(F.col("volume_km3").cast("decimal(30,10)")).over(Window.partitionBy()).cast("double"))


def threshold_table(cat: DataFrame, years: float, periods: tuple[int, ...] = (1, 2, 5, 10, 25)) -> DataFrame:
    """Value exceeded about once in T years: the k-th largest with k = round(years / T), halves to even, one at least."""
    spark = cat.sparkSession
    wanted = [(t, max(round(years / t), 1)) for t in periods]
    asked = spark.createDataFrame(wanted, "period int, k int")
    whole, ks = cat.where(untruncated()), sorted({k for _, k in wanted})
    volume = kth_largest(whole, "total_volume_km3", ks).withColumnRenamed("value", "volume_km3")
    intensity = kth_largest(whole, "max_intensity_mm_hr", ks).withColumnRenamed("value", "intensity_mm_hr")
    return asked.join(volume, "k", "left").join(intensity, "k", "left").select("period", "k", "volume_km3", "intensity_mm_hr")


def critical_mass(cat: DataFrame, min_volume: float = 0.01, min_intensity: float = 10.0) -> DataFrame:
    """Storms of at least that volume and peak rate, and their share of storms and volume."""
    hit = (F.col("total_volume_km3") >= min_volume) & (F.col("max_intensity_mm_hr") >= min_intensity)
    volume = exact_sum(F.when(hit, F.col("total_volume_km3")).otherwise(0.0))
    return cat.where(untruncated()).agg(
        F.sum(hit.cast("long")).alias("storms"), (F.sum(hit.cast("long")) / F.count("*")).alias("share"), (volume / exact_sum("total_volume_km3")).alias("volume_share")
    )


def annual_summary(cat: DataFrame) -> DataFrame:
    """Per year: counts, volume, median volume, 95th percentile of duration (untruncated), truncated share, months."""
    whole = untruncated()
    median = group_quantiles(cat.where(whole), "year", "total_volume_km3", {"median": 0.5})
    rows = cat.groupBy("year").agg(
        F.count("*").alias("storms"),
        exact_sum(F.when(whole, F.col("total_volume_km3"))).alias("volume_km3"),
        F.round(F.expr("percentile(CASE WHEN NOT (truncated_time OR truncated_space) THEN duration_h END, 0.95)"), 6).alias("p95_duration_h"),
        (F.sum((~whole).cast("long")) / F.count("*")).alias("truncated_share"),
        F.count_distinct("month").alias("months"),
    )
    return rows.join(median, "year", "left").withColumn("median_volume_km3", F.round("median", 9)).drop("median")


def seasonal_estimators(cat: DataFrame) -> DataFrame:
    """Each month's share of the year in percent by three estimators, and the spread over complete years.

    Pooled over all years; pooled over complete years (all twelve months present); mean over complete years of the share
    within the year, with its 10th and 90th percentile, minimum and maximum.
    """
    monthly = cat.where(untruncated()).groupBy("year", "month").agg(exact_sum("total_volume_km3").alias("v"))
    year = Window.partitionBy("year")
    rows = monthly.withColumn("complete", F.count("*").over(year) == 12).withColumn("share", F.col("v") / F.sum(F.col("v").cast("decimal(30,10)")).over(year).cast("double") * 100)
    every = Window.partitionBy()
    kept = F.when(F.col("complete"), F.col("v"))
    share = F.when(F.col("complete"), F.col("share"))
    months = rows.groupBy("month").agg(
        exact_sum("v").alias("all_v"),
        exact_sum(kept).alias("complete_v"),
        F.round(F.avg(share), 6).alias("mean_of_shares_pct"),
        F.round(F.expr("percentile(CASE WHEN complete THEN share END, 0.1)"), 6).alias("p10_share_pct"),
        F.round(F.expr("percentile(CASE WHEN complete THEN share END, 0.9)"), 6).alias("p90_share_pct"),
        F.round(F.min(share), 6).alias("min_share_pct"),
        F.round(F.max(share), 6).alias("max_share_pct"),
    )
    pooled = lambda c: F.round(F.col(c) / F.sum(F.col(c).cast("decimal(30,10)")).over(every).cast("double") * 100, 6)
    return months.select("month", pooled("all_v").alias("pooled_all_pct"), pooled("complete_v").alias("pooled_complete_pct"), "mean_of_shares_pct", "p10_share_pct", "p90_share_pct", "min_share_pct", "max_share_pct")


def season_ratio(shares: DataFrame, high: int = 12, low: int = 8) -> DataFrame:
    """Ratio of two months' shares by each estimator."""
    pick = lambda c, m: F.max(F.when(F.col("month") == m, F.col(c)))
    names = {"pooled_all_pct": "pooled_all", "pooled_complete_pct": "pooled_complete", "mean_of_shares_pct": "mean_of_shares"}
    return shares.agg(*[(pick(c, high) / pick(c, low)).alias(n) for c, n in names.items()])


def month_rank(cat: DataFrame) -> DataFrame:
    """Months of the record ranked by volume, largest first."""
    rows = cat.groupBy("year", "month").agg(exact_sum("total_volume_km3").alias("volume_km3"))
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.desc("volume_km3"))))


def year_quantiles(cat: DataFrame) -> DataFrame:
    """Median, 99th percentile and maximum of untruncated storms' volume by year."""
    found = group_quantiles(cat.where(untruncated()), "year", "total_volume_km3", {"p50_km3": 0.5, "p99_km3": 0.99, "max_km3": 1.0})
    return found.select("year", F.round("p50_km3", 9).alias("p50_km3"), F.round("p99_km3", 9).alias("p99_km3"), "max_km3")


def percentile_meaning(cat: DataFrame, years: float, levels: tuple[float, ...] = (90.0, 99.0, 99.9, 99.99)) -> DataFrame:
    """How many storms a year lie beyond a percentile, and the years between two of them."""
    n = cat.where(untruncated()).count()
    rows = cat.sparkSession.createDataFrame([(float(p),) for p in levels], "level double")
    beyond = F.lit(float(n)) * (F.lit(1.0) - F.col("level") / 100) / F.lit(float(years))
    return rows.select("level", F.round(beyond, 9).alias("per_year"), F.round(F.lit(1.0) / beyond, 9).alias("years_between"))


def full_year_mean(cat: DataFrame) -> DataFrame:
    """Mean volume of full years, and how many years are full and how many are not."""
    full = F.when(F.col("full"), F.col("volume_km3"))
    return by_year(cat).agg((exact_sum(full) / F.count(full)).alias("mean_km3"), F.sum(F.col("full").cast("long")).alias("full_years"), F.sum((~F.col("full")).cast("long")).alias("partial_years"))


def percolation_range(cat: DataFrame, column: str = "param_percolation_share") -> DataFrame:
    """Least, median and largest of the different percolation shares that a catalogue's windows were built with."""
    shares = cat.where(F.col(column).isNotNull()).select(column).distinct()
    return shares.agg(F.min(column).alias("percolation_min"), F.expr(f"percentile(`{column}`, 0.5)").alias("percolation_median"), F.max(column).alias("percolation_max"))
