"""Seasonal shapes on a coarse grid, and regions from them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import exact_sum

MONTHS = list(range(1, 13))


def on_grid(cat: DataFrame, deg: float = 1.0) -> DataFrame:
    """``cat`` with the lower corner (glat, glon) of each storm's cell; storms without a centroid go."""
    rows = cat.where("wcentroid_lat IS NOT NULL AND wcentroid_lon IS NOT NULL")
    return rows.withColumn("glat", F.floor(F.col("wcentroid_lat") / deg) * F.lit(deg)).withColumn("glon", F.floor(F.col("wcentroid_lon") / deg) * F.lit(deg))


def seasonal_grid(cat: DataFrame, deg: float = 1.0, min_storms: int = 200) -> DataFrame:
    """(glat, glon, storms, m1..m12): each cell's monthly shares of its volume; cells with fewer storms go, truncated storms count."""
    rows = on_grid(cat, deg)
    wide = rows.groupBy("glat", "glon").pivot("month", MONTHS).agg(exact_sum("total_volume_km3"))
    counts = rows.groupBy("glat", "glon").agg(F.count("*").alias("storms")).where(F.col("storms") >= min_storms)
    wide = wide.join(counts, ["glat", "glon"]).select("glat", "glon", "storms", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"v{m}") for m in MONTHS])
    total = sum((F.col(f"v{m}") for m in MONTHS[1:]), F.col("v1"))
    return wide.withColumn("total", total).select("glat", "glon", "storms", *[F.when(F.col("total") > 0, F.col(f"v{m}") / F.col("total")).otherwise(0.0).alias(f"m{m}") for m in MONTHS])


def _shape() -> list:
    return [F.col(f"m{m}") for m in MONTHS]


def silhouette(labelled: DataFrame, label: str = "label") -> float:
    """Mean silhouette with Euclidean distance; the grid has at most some thousand cells, each met with each."""
    rows = labelled.select("glat", "glon", F.col(label).alias("label"), F.array(*_shape()).alias("s"))
    other = rows.select(F.col("label").alias("label2"), F.col("s").alias("s2"), F.col("glat").alias("glat2"), F.col("glon").alias("glon2"))
    far = F.sqrt(F.aggregate(F.zip_with("s", "s2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    met = rows.join(other, (F.col("glat") != F.col("glat2")) | (F.col("glon") != F.col("glon2"))).withColumn("d", far)
    means = met.groupBy("glat", "glon", "label", "label2").agg(F.avg("d").alias("d"))
    own, next_ = F.max(F.when(F.col("label") == F.col("label2"), F.col("d"))), F.min(F.when(F.col("label") != F.col("label2"), F.col("d")))
    each = means.groupBy("glat", "glon").agg(own.alias("a"), next_.alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(value)).first()[0]


def cluster(grid: DataFrame, k: int, seeds: int = 10) -> DataFrame:
    """``grid`` with ``label``: the k-means of least cost over ``seeds`` starts; no cells, no labels."""
    if not grid.limit(1).count():
        return grid.withColumn("label", F.lit(0))
    rows = grid.withColumn("features", array_to_vector(F.array(*_shape())))
    models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="label").fit(rows) for s in range(seeds)]
    return min(models, key=lambda m: m.summary.trainingCost).transform(rows).drop("features")


def choose_k(grid: DataFrame, kmin: int = 2, kmax: int = 6, seeds: int = 10) -> list[tuple[int, float]]:
    """(k, silhouette) of each number of regions."""
    return [(k, silhouette(cluster(grid, k, seeds))) for k in range(kmin, kmax + 1)]


def label_regions(clustered: DataFrame) -> DataFrame:
    """(glat, glon, region, peak_month): ids in the order of the centres' peak months, ties by the cluster's label."""
    centres = clustered.groupBy("label").agg(*[F.avg(f"m{m}").alias(f"m{m}") for m in MONTHS])
    peak = F.array_position(F.array(*_shape()), F.array_max(F.array(*_shape()))).cast("int")
    order = centres.select("label", peak.alias("peak_month")).withColumn("region", F.row_number().over(Window.orderBy("peak_month", "label")) - 1)
    return clustered.join(F.broadcast(order), "label").select("glat", "glon", "region", "peak_month")


def attach(cat: DataFrame, regions: DataFrame, deg: float = 1.0) -> DataFrame:
    """Storms of the regions' cells with ``region``; storms elsewhere go."""
    return on_grid(cat, deg).join(regions.select("glat", "glon", "region"), ["glat", "glon"])


def region_of(rows: DataFrame, regions: DataFrame, lat: str, lon: str, deg: float = 1.0) -> DataFrame:
    """``rows`` with ``region`` of the cell of a place; -1 where the cell has none or the place is null.  Every row stays."""
    at = regions.select(F.col("glat").alias("_glat"), F.col("glon").alias("_glon"), F.col("region").alias("_region"))
    corner = (F.floor(F.col(lat) / deg) * F.lit(deg) == F.col("_glat")) & (F.floor(F.col(lon) / deg) * F.lit(deg) == F.col("_glon"))
    return rows.join(at, corner, "left").withColumn("region", F.coalesce("_region", F.lit(-1))).drop("_glat", "_glon", "_region")


def extents(stormy: DataFrame, deg: float = 1.0) -> DataFrame:
    """Cells, storms, volume, share of the volume and bounds of each region."""
    every = Window.partitionBy()
    rows = stormy.groupBy("region").agg(
        F.count_distinct("glat", "glon").alias("cells"),
        F.count("*").alias("storms"),
        exact_sum("total_volume_km3").alias("volume_km3"),
        F.min("glat").alias("lat_min"),
        (F.max("glat") + deg).alias("lat_max"),
        F.min("glon").alias("lon_min"),
        (F.max("glon") + deg).alias("lon_max"),
    )
    return rows.withColumn("volume_share", F.col("volume_km3") / F.sum(F.col("volume_km3").cast("decimal(30,10)")).over(every).cast("double"))


def with_domain(stormy: DataFrame) -> DataFrame:
    """:func:`contrast` of each region, and of all of them together as region -1 with the whole volume as its share."""
    whole = contrast(stormy.withColumn("region", F.lit(-1)))
    return contrast(stormy).unionByName(whole)


def contrast(stormy: DataFrame) -> DataFrame:
    """Seasonal contrast (largest over least month) of each region, by volume and by the mean of its cells' shapes."""
    cells = stormy.groupBy("region", "glat", "glon").pivot("month", MONTHS).agg(exact_sum("total_volume_km3"))
    cells = cells.select("region", "glat", "glon", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"v{m}") for m in MONTHS])
    total = sum((F.col(f"v{m}") for m in MONTHS[1:]), F.col("v1"))
    cells = cells.withColumn("total", total)
    rows = cells.groupBy("region").agg(
        F.count("*").alias("cells"),
        exact_sum("total").alias("volume_km3"),
        F.array(*[exact_sum(f"v{m}") for m in MONTHS]).alias("volumes"),
        F.array(*[F.round(F.avg(F.col(f"v{m}") / F.col("total")), 9) for m in MONTHS]).alias("shapes"),
    )
    every = Window.partitionBy()
    found = lambda c, f: F.array_position(c, f(c)).cast("int")
    return rows.select(
        "region",
        "cells",
        (F.col("volume_km3") / F.sum(F.col("volume_km3").cast("decimal(30,10)")).over(every).cast("double") * 100).alias("volume_share_pct"),
        (F.array_max("volumes") / F.array_min("volumes")).alias("volume_contrast"),
        found(F.col("volumes"), F.array_max).alias("volume_peak_month"),
        found(F.col("volumes"), F.array_min).alias("volume_trough_month"),
        F.round(F.array_max("shapes") / F.array_min("shapes"), 3).alias("cell_contrast"),
        found(F.col("shapes"), F.array_max).alias("cell_peak_month"),
        found(F.col("shapes"), F.array_min).alias("cell_trough_month"),
    )
