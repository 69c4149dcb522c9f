"""Analyses of a catalogue or a cube beside the standing products: rank correlation, lags between series, effect of chunk boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import cell_area_m2, correlation, exact_sum, volume_km3
from cumulo.functions.constants import DT_HOURS, GRID_DEG, LAT_FIRST, STEPS_PER_DAY, STORM_RATE_BANDS
from cumulo.plans.graph import connected_components
from cumulo.plans.ranking import ranked
from cumulo.plans.selection import select_quantiles
from cumulo.plans.shared import materialize


#: Tasks that share a region's volumes.
DEALS = 64


def mid_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(value, mid): the mean rank that the ``n`` rows of each value share, from one row a different value.

    Values are dealt by range; a value that a third of all rows have is one row here.
    """
    return ranked(counts, [F.col(value)], running=n).select(value, (F.col("running") - F.col(n) + (F.col(n) + 1) / 2).alias("mid"))


def rank_correlation(df: DataFrame, y: str, x: str) -> DataFrame:
    """(n, pearson, spearman) of two columns over the rows that have both; null where either doesn't vary.

    Rows are counted by pair of values first, then values get mid-ranks and the pairs look theirs up; sums of centred ranks give the coefficient.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = materialize(rows.groupBy("x", "y").agg(F.count("*").alias("n")), "cells")
    ranks = {c: mid_ranks(cells.groupBy(c).agg(F.sum("n").alias("n")), c) for c in "xy"}
    both = cells.join(ranks["x"].withColumnRenamed("mid", "rx"), "x").join(ranks["y"].withColumnRenamed("mid", "ry"), "y")
    total = cells.agg(F.sum("n").alias("total"))
    centred = both.join(F.broadcast(total), F.lit(True)).select("n", *[(F.col(c) - (F.col("total") + 1) / 2).alias(c) for c in ("rx", "ry")])
    spread = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    spearman = centred.agg((spread("rx", "ry") / F.nullif(F.sqrt(spread("rx", "rx")) * F.sqrt(spread("ry", "ry")), F.lit(0.0))).alias("spearman"))
    plain = rows.agg(F.count("*").alias("n"), correlation("y", "x").alias("pearson"))
    return plain.join(spearman, F.lit(True)).select("n", "pearson", "spearman")


def lag_scan(a: DataFrame, b: DataFrame, lags: list[int], time: str = "t", value: str = "v") -> DataFrame:
    """(lag, n, r, best): Pearson's r of series ``a`` at t and ``b`` at t + lag, for all lags from one join and one aggregation.

    ``b`` goes to each of the lags; counts, sums and products are combined before the shuffle.  A lag at which the series don't meet or one
    of them doesn't vary has no r; the best is the highest r, the smaller lag of equal ones.
    """
    shifted = b.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(time).alias("t"), F.col(value).cast("double").alias("w")).select("lag", (F.col("t") - F.col("lag")).alias("t"), "w")
    met = a.select(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).join(shifted, "t").where("v IS NOT NULL AND w IS NOT NULL")
    found = met.groupBy("lag").agg(F.count("*").alias("n"), correlation("v", "w").alias("r"))
    every = a.sparkSession.createDataFrame([(int(k),) for k in lags], "lag int").join(found, "lag", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = Window.orderBy(F.desc_nulls_last("r"), "lag")  # a row a lag
    return every.select("lag", "n", "r", ((F.row_number().over(first) == 1) & F.col("r").isNotNull()).alias("best"))


def chunked(vox: DataFrame, offset: int = 0, steps: int = STEPS_PER_DAY) -> DataFrame:
    """``vox`` with chunks of ``steps`` steps, the first one beginning ``offset`` steps before the epoch, moved apart so that no object crosses a boundary."""
    return vox.withColumn("t", (F.col("t") + 2 * F.floor((F.col("t") + offset) / steps)).cast("int"))


def unchunked(labelled: DataFrame, offset: int = 0, steps: int = STEPS_PER_DAY) -> DataFrame:
    """:func:`chunked` undone, with ``at_edge``: the voxel lies on its chunk's first or last step."""
    place = F.col("t") + offset
    chunk = F.floor(place / (steps + 2))
    inside = place - chunk * (steps + 2)
    return labelled.withColumn("at_edge", (inside == 0) | (inside == steps - 1)).withColumn("t", (F.col("t") - 2 * chunk).cast("int"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n, share, best_for_a, best_for_b): objects of two labellings that share ``n`` voxels, and their share of the union.

    The best partner has the largest share, then the smaller label.  Labels meet by an equi-join of voxels.
    """
    left, right = a.select("id", F.col("label").alias("a")), b.select("id", F.col("label").alias("b"))
    met = left.join(right, "id").groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = lambda side, name: side.groupBy(name).agg(F.count("*").alias(f"n{name}"))
    pairs = met.join(sizes(left, "a"), "a").join(sizes(right, "b"), "b")
    pairs = materialize(pairs.select("a", "b", "n", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("share")), "overlaps")
    best = lambda of, other: pairs.groupBy(of).agg((-F.max(F.struct("share", (-F.col(other)).alias("o")))["o"]).alias(f"best_{of}"))
    return pairs.join(best("a", "b"), "a").join(best("b", "a"), "b").select("a", "b", "n", "share", (F.col("b") == F.col("best_a")).alias("best_for_a"), (F.col("a") == F.col("best_b")).alias("best_for_b"))


def matching(pairs: DataFrame) -> DataFrame:
    """(one_to_one, split, merged, mixed): connected parts of the overlap graph by how many objects of either labelling they hold.

    ``pairs`` is (a, b) with labels from 0.  Split: one object of a became several of b; merged: several became one.
    """
    nodes = connected_components(pairs.select("a", (-F.col("b") - 1).alias("b")), "a", "b")
    ends = nodes.select("node", "component").union(nodes.select(F.col("component").alias("node"), "component").distinct())
    held = ends.distinct().groupBy("component").agg(F.sum((F.col("node") >= 0).cast("long")).alias("na"), F.sum((F.col("node") < 0).cast("long")).alias("nb"))
    kinds = {"one_to_one": "na = 1 AND nb = 1", "split": "na = 1 AND nb > 1", "merged": "na > 1 AND nb = 1", "mixed": "na > 1 AND nb > 1"}
    return held.agg(*[F.coalesce(F.sum(F.expr(rule).cast("long")), F.lit(0)).alias(name) for name, rule in kinds.items()])


def chunk_row(name: str, labelled: DataFrame) -> DataFrame:
    """(chunking, storms, truncated_share, volume_km3, max_duration_h) of labelled voxels with ``at_edge``."""
    area = cell_area_m2(F.lit(LAT_FIRST) + F.lit(GRID_DEG) * F.col("y"))
    one = labelled.groupBy("label").agg(F.max("at_edge").alias("truncated"), F.sum(volume_km3(F.col("r"), area)).alias("volume"), ((F.max("t") - F.min("t") + 1) * F.lit(DT_HOURS)).alias("hours"))
    return one.agg(F.lit(name).alias("chunking"), F.count("*").alias("storms"), F.avg(F.col("truncated").cast("int")).alias("truncated_share"), exact_sum("volume").alias("volume_km3"), F.max("hours").alias("max_duration_h"))


def chunk_alignment(vox: DataFrame, label, offsets: dict[str, int], steps: int = STEPS_PER_DAY) -> DataFrame:
    """:func:`chunk_row` of the whole record and of chunks with each offset, with :func:`matching` against the whole one.

    ``label`` segments voxels (id, t, y, x, r).  The whole record's edges are its first and last step, and it matches itself.
    """
    ends = vox.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    whole = materialize(label(vox).join(F.broadcast(ends), F.lit(True)).withColumn("at_edge", (F.col("t") == F.col("t0")) | (F.col("t") == F.col("t1"))).drop("t0", "t1"), "whole")
    out = chunk_row("continuous", whole).select("*", F.col("storms").alias("one_to_one"), *[F.lit(0).cast("long").alias(c) for c in ("split", "merged", "mixed")])
    for name, offset in offsets.items():
        cut = materialize(unchunked(label(materialize(chunked(vox, offset, steps), "chunks")), offset, steps), "labels")
        out = out.union(chunk_row(name, cut).join(matching(overlaps(whole, cut)), F.lit(True)))
    return out


def age_exceedance(cat: DataFrame, years: float, hours: tuple[float, ...] = (12.0, 24.0, 48.0, 72.0), age: str = "duration_h", volume: str = "total_volume_km3") -> DataFrame:
    """(hours, storms, per_year, volume_share) of the storms that last at least so long, all ages from one aggregation; ages that none reaches count 0."""
    each = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("h"), (F.col(age) >= h).alias("hit")) for h in hours])).alias("x")
    rows = cat.select(each, F.col(volume).alias("v")).groupBy(F.col("x.h").alias("hours")).agg(F.coalesce(F.sum(F.col("x.hit").cast("long")), F.lit(0)).alias("storms"), F.coalesce(exact_sum(F.when(F.col("x.hit"), F.col("v"))), F.lit(0.0)).alias("part"), exact_sum("v").alias("whole"))
    return rows.select("hours", "storms", (F.col("storms") / F.lit(float(years))).alias("per_year"), (F.col("part") / F.nullif("whole", F.lit(0.0))).alias("volume_share"))


def propagation_speed(landed: DataFrame, beyond_km: float = 15.0) -> DataFrame:
    """(n, p25_km_h, median_km_h, p75_km_h): offshore distance at the start over hours at sea, of storms that form farther out than ``beyond_km``."""
    rows = landed.where((F.col("offshore_km_at_start") > beyond_km) & (F.col("hours_at_sea") > 0)).select((F.col("offshore_km_at_start") / F.col("hours_at_sea")).alias("speed"))
    rows = materialize(rows, "speeds")  # the quantiles read it once a round
    at = select_quantiles(rows, {"p25_km_h": ("speed", 0.25), "median_km_h": ("speed", 0.5), "p75_km_h": ("speed", 0.75)})
    return rows.agg(F.count("*").alias("n")).join(at, F.lit(True), "left")


def regional_edges(cat: DataFrame, years: float, rates: tuple[float, float] = STORM_RATE_BANDS, volume: str = "total_volume_km3") -> DataFrame:
    """(domain, region, storms_per_year, low_km3, high_km3, of_domain) of each ``region`` and of the domain (region null): volumes that so many storms a year reach.

    An edge is the k-th largest volume, k = round(rate * years), halves to even, within 1..n; of_domain compares the upper ones.  Volumes are counted once a
    region and dealt over ``DEALS`` tasks a region, which keep their first k; a region's first k are found among those, and the domain's among the regions'.
    """
    rows = cat.where(F.col(volume).isNotNull()).select("region", F.col(volume).alias("v"))
    counts = materialize(rows.groupBy("region", "v").agg(F.count("*").alias("n")), "volumes")
    ks = [max(round(r * years), 1) for r in rates]
    first = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v")))).where(F.col("k") <= max(ks)).drop("k")
    dealt = lambda df, *by: first(first(df.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALS))), *by, "deal"), *by)
    of = lambda domain, region: F.struct(F.lit(domain).alias("domain"), region.cast(cat.schema["region"].dataType).alias("region")).alias("of")
    tops = materialize(dealt(counts, "region").select("region", "v", "n"), "tops")
    every = dealt(tops.groupBy("v").agg(F.sum("n").alias("n")).withColumn("domain", F.lit(True)), "domain")
    sizes = counts.groupBy("region").agg(F.sum("n").alias("all"))
    sizes = sizes.select(of(False, F.col("region")), "all").union(sizes.agg(F.sum("all").alias("all")).where("all IS NOT NULL").select(of(True, F.lit(None)), "all"))
    top = tops.select(of(False, F.col("region")), "v", "n").union(every.select(of(True, F.lit(None)), "v", "n"))
    top = top.withColumn("k", F.sum("n").over(Window.partitionBy("of").orderBy(F.desc("v"))))
    at = lambda k: F.max(F.when(F.col("k") >= F.least(F.lit(k), F.col("all")), F.col("v")))
    found = top.join(sizes, "of").groupBy("of", "all").agg(at(ks[0]).alias("low_km3"), at(ks[1]).alias("high_km3")).withColumnRenamed("all", "n")
    whole = found.where("of.domain").select(F.col("high_km3").alias("all"))
    return found.join(F.broadcast(whole), F.lit(True)).select("of.domain", "of.region", (F.col("n") / F.lit(float(years))).alias("storms_per_year"), "low_km3", "high_km3", (F.col("high_km3") / F.nullif("all", F.lit(0.0))).alias("of_domain"))


def density_concentration(storms: DataFrame, area_km2: float, months: float, top: float = 0.13) -> DataFrame:
    """By prominence ``h``: storms a million km2 and month, mean volume, mean duration, and the share of volume in the largest ``top`` of the storms.

    ``storms`` is (h, label, total_volume_km3, duration_h); the largest are round(top * n) by volume, halves to even, 1 at least.
    """
    order = [F.col("h"), F.desc("total_volume_km3"), F.col("label")]
    rows = ranked(storms.select("h", "label", "total_volume_km3", "duration_h"), order)
    sizes = storms.groupBy("h").agg(F.count("*").alias("n"))
    before = sizes.select("h", "n", F.coalesce(F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))  # a row a prominence
    placed = rows.join(F.broadcast(before), "h").withColumn("first", F.col("rank") - F.col("n0") <= F.greatest(F.bround(F.lit(top) * F.col("n")), F.lit(1)))
    held = placed.groupBy("h", "n").agg(exact_sum("total_volume_km3").alias("all"), exact_sum(F.when(F.col("first"), F.col("total_volume_km3"))).alias("most"), exact_sum("duration_h").alias("hours"))
    per = F.lit(area_km2 / 1e6 * months)
    return held.select("h", (F.col("n") / per).alias("storms_per_mkm2_month"), (F.col("all") / F.col("n")).alias("mean_volume_km3"), (F.col("hours") / F.col("n")).alias("mean_duration_h"), (F.col("most") / F.nullif("all", F.lit(0.0))).alias("top_share"))
