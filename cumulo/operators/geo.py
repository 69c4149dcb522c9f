"""Land, provinces and coasts on the grid; local hours; transitions between sea and land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import cell, correlation, exact_sum, untruncated, utc_offset
from cumulo.functions.constants import DT_HOURS, GRID_DEG, KM_PER_DEGREE, TRANSITIONS
from cumulo.plans.ranking import group_quantiles, quantiles


#: Cells of a grid that is broadcast, at most.
GRID_MOST = 500_000


def rasterise(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """``cells`` (y, x, lat, lon) with the ``name`` of the last polygon (order, name, ring of (lat, lon)) that holds the centre, else null.

    Scan lines, on a regular grid: each edge gives its crossing with every row of cells that it spans, the crossings of a row sorted by
    longitude pair up, and what lies between the two of a pair is inside (even-odd).  Work grows with edges and cells that are
    met; a polygon is split by its rows.  Up to ``GRID_MOST`` cells are broadcast, so cells that polygons cover are made and compared where they are
    made; beyond it the sides are merged.  A centre on a crossing counts to the east of it.  Rings needn't be closed; null names are none.
    """
    axis = cells.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count("*").alias("n")).first()
    if axis["y0"] is None:
        return cells.withColumn("name", F.lit(None).cast("string"))
    side = F.broadcast if axis["n"] <= GRID_MOST else lambda df: df.hint("merge")
    place = lambda v, first, last, low, high: (v - F.lit(low)) / F.lit((high - low) / max(last - first, 1) or 1.0) + F.lit(first)
    row, column = (lambda v: place(v, axis["y0"], axis["y1"], axis["a"], axis["b"])), (lambda v: place(v, axis["x0"], axis["x1"], axis["c"], axis["d"]))
    ends = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("q"))
    edge = polygons.where("size(ring) > 2").select("order", "name", F.explode(ends).alias("e"))
    # A row more on either side: which rows an edge spans is decided by the cells' own latitude.
    least, most = F.least("e.p.lat", "e.q.lat"), F.greatest("e.p.lat", "e.q.lat")
    first, last = F.greatest(F.ceil(row(least)).cast("int") - 1, F.lit(axis["y0"])), F.least(F.floor(row(most)).cast("int") + 1, F.lit(axis["y1"]))
    spanned = edge.where(first <= last).select("order", "name", "e", F.explode(F.sequence(first, last)).alias("y"))
    at = spanned.join(side(cells.groupBy("y").agg(F.first("lat").alias("lat"))), "y").where((F.col("e.p.lat") > F.col("lat")) != (F.col("e.q.lat") > F.col("lat")))
    crossing = F.col("e.p.lon") + (F.col("lat") - F.col("e.p.lat")) / (F.col("e.q.lat") - F.col("e.p.lat")) * (F.col("e.q.lon") - F.col("e.p.lon"))
    line = Window.partitionBy("order", "y").orderBy("at")
    pairs = at.select("order", "name", "y", crossing.alias("at")).withColumn("k", F.row_number().over(line)).withColumn("to", F.lead("at").over(line)).where("k % 2 = 1")
    west, east = F.greatest(F.ceil(column(F.col("at"))).cast("int") - 1, F.lit(axis["x0"])), F.least(F.floor(column(F.col("to"))).cast("int") + 1, F.lit(axis["x1"]))
    filled = pairs.where(west <= east).select("order", "y", "at", "to", F.explode(F.sequence(west, east)).alias("x"))
    inside = (F.col("at") <= F.col("lon")) & (F.col("lon") < F.col("to"))
    # The last order of each cell comes from numbers alone, which needs no sort; the few polygons that are on top then give their names.
    top = filled.join(side(cells.select("y", "x", "lon")), ["y", "x"]).where(inside).groupBy("y", "x").agg(F.max("order").alias("order"), F.first("lon").alias("lon"))
    held = pairs.join(side(top), ["order", "y"]).where(inside).groupBy("y", "x").agg(F.max("name").alias("name"))
    return cells.join(held, ["y", "x"], "left")


def coast_distance(grid: DataFrame) -> DataFrame:
    """``grid`` (y, x, is_land) with ``coast_km``, the exact Euclidean distance to the nearest land cell; null without land.

    First along columns by windows, then along rows: land at another column can only be nearer within the column distance, so
    each cell looks no further than that.
    """
    km = GRID_DEG * KM_PER_DEGREE
    column = Window.partitionBy("x").orderBy("y")
    land_y = F.when(F.col("is_land"), F.col("y"))
    above = F.col("y") - F.last(land_y, True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(land_y, True).over(column.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    rows = grid.withColumn("g", F.least(above, below))
    far = grid.agg(F.max("x")).first()[0] or 0
    reach = F.coalesce("g", F.lit(far))
    looks = rows.select("y", "x", F.explode(F.sequence(F.greatest(F.col("x") - reach, F.lit(0)), F.least(F.col("x") + reach, F.lit(far)))).alias("x2"))
    near = looks.join(rows.select("y", F.col("x").alias("x2"), F.col("g").alias("g2")), ["y", "x2"]).where("g2 IS NOT NULL")
    best = near.groupBy("y", "x").agg(F.min((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + F.col("g2") * F.col("g2")).alias("d2"))
    return grid.join(best, ["y", "x"], "left").withColumn("coast_km", F.sqrt("d2") * F.lit(km)).drop("d2")


def looked_up(df: DataFrame, grid: DataFrame, lat: str, lon: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with the grid's ``columns`` (name -> new name) of the nearest cell; the grid has a fixed number of cells."""
    y, x = cell(F.col(lat), F.col(lon))
    side = grid.select(F.col("y").alias("_y"), F.col("x").alias("_x"), *[F.col(a).alias(b) for a, b in columns.items()])
    return df.withColumn("_y", y).withColumn("_x", x).join(F.broadcast(side), ["_y", "_x"]).drop("_y", "_x")


def local_hour(time: Column, lon: Column) -> Column:
    """Hour of the day with fraction of minutes, in the civil zone of the longitude."""
    return F.pmod(F.hour(time) + F.minute(time) / F.lit(60.0) + utc_offset(lon), F.lit(24.0))


def diurnal(cat: DataFrame, grid: DataFrame) -> DataFrame:
    """Twelve two-hour bins: share of land and sea storms by local and by UTC hour; untruncated storms with a centroid."""
    rows = cat.where(untruncated() & F.col("wcentroid_lat").isNotNull() & F.col("wcentroid_lon").isNotNull())
    rows = looked_up(rows, grid, "wcentroid_lat", "wcentroid_lon", {"is_land": "land"})
    utc = F.hour("wcentroid_time") + F.minute("wcentroid_time") / F.lit(60.0)
    rows = rows.select("land", F.floor(local_hour(F.col("wcentroid_time"), F.col("wcentroid_lon")) / 2).cast("int").alias("local"), F.floor(utc / 2).cast("int").alias("utc"))
    total = rows.agg(F.sum(F.col("land").cast("long")).alias("n_land"), F.sum((~F.col("land")).cast("long")).alias("n_sea"))
    each = rows.select(F.explode(F.array(F.struct(F.col("local").alias("bin"), F.lit("local").alias("clock")), F.struct(F.col("utc").alias("bin"), F.lit("utc").alias("clock")))).alias("b"), "land")
    counted = each.groupBy("b.bin").agg(*[F.sum(((F.col("land") == land) & (F.col("b.clock") == clock)).cast("long")).alias(f"{name}_{clock}") for land, name in ((True, "land"), (False, "sea")) for clock in ("local", "utc")])
    bins = cat.sparkSession.range(12).select(F.col("id").cast("int").alias("bin"))
    share = lambda c, n: (F.coalesce(c, F.lit(0)) / F.col(n)).alias(c)
    out = bins.join(counted, "bin", "left").join(total, F.lit(True))
    return out.select("bin", F.format_string("%02d-%02d", F.col("bin") * 2, F.col("bin") * 2 + 2).alias("hour"), share("land_local", "n_land"), share("land_utc", "n_land"), share("sea_local", "n_sea"), share("sea_utc", "n_sea"))


def diurnal_peaks(bins: DataFrame) -> DataFrame:
    """Peak bin and amplitude (largest over least share) of land and sea by local time."""
    return bins.agg(*[x for k in ("land", "sea") for x in (F.max_by("hour", f"{k}_local").alias(f"{k}_peak"), (F.max(f"{k}_local") / F.nullif(F.min(f"{k}_local"), F.lit(0.0))).alias(f"{k}_amplitude"))])


def transitions(storms: DataFrame, grid: DataFrame) -> DataFrame:
    """Untruncated storms with start and end place, with start_land, end_land and ``transition``."""
    rows = storms.where(untruncated() & F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull())
    rows = looked_up(looked_up(rows, grid, "start_lat", "start_lon", {"is_land": "start_land"}), grid, "end_lat", "end_lon", {"is_land": "end_land"})
    kind = F.when(~F.col("start_land") & F.col("end_land"), TRANSITIONS[0]).when(~F.col("start_land"), TRANSITIONS[1]).when(F.col("end_land"), TRANSITIONS[2]).otherwise(TRANSITIONS[3])
    return rows.withColumn("transition", kind)


def transition_summary(moved: DataFrame, years: float) -> DataFrame:
    """Storms, yearly rate, volume, durations and shares of each class."""
    every = Window.partitionBy()
    rows = moved.groupBy("transition").agg(
        F.count("*").alias("storms"),
        exact_sum("total_volume_km3").alias("volume_km3"),
        F.round(F.expr("percentile(duration_h, 0.5)"), 6).alias("median_duration_h"),
        F.round(F.expr("percentile(duration_h, 0.99)"), 6).alias("p99_duration_h"),
    )
    median = group_quantiles(moved, "transition", "total_volume_km3", {"median": 0.5})
    rows = rows.join(median, "transition").withColumn("median_volume_km3", F.round("median", 9)).drop("median")
    total = F.sum(F.col("volume_km3").cast("decimal(30,10)")).over(every).cast("double")
    return rows.select("*", (F.col("storms") / F.lit(float(years))).alias("per_year"), (F.col("storms") / F.sum("storms").over(every)).alias("share"), (F.col("volume_km3") / total).alias("volume_share"))


def first_landfall(tracks: DataFrame, grid: DataFrame) -> DataFrame:
    """(storm_uid, n_vertices, landfall_idx, landfall_lat, landfall_lon, hours_at_sea, hours_over_land): the first vertex over land.

    ``tracks`` has a row for each vertex (storm_uid, t, lat, lon), t from 0 without gaps; storms that never reach land have nulls.
    """
    rows = looked_up(tracks, grid, "lat", "lon", {"is_land": "land"})
    first = F.when(F.col("land"), F.col("t"))
    one = rows.groupBy("storm_uid").agg(F.count("*").alias("n_vertices"), F.min(first).alias("landfall_idx"), F.min_by("lat", first).alias("landfall_lat"), F.min_by("lon", first).alias("landfall_lon"))
    return one.withColumn("hours_at_sea", F.col("landfall_idx") * F.lit(DT_HOURS)).withColumn("hours_over_land", (F.col("n_vertices") - 1 - F.col("landfall_idx")) * F.lit(DT_HOURS))


def volume_quartile(df: DataFrame, value: str = "total_volume_km3") -> DataFrame:
    """``df`` with ``q`` 1..4 by linear quantile edges, right-closed, the lowest value included; not equal counts."""
    at = quantiles(df, value, [0.25, 0.5, 0.75]).orderBy("level").agg(F.sort_array(F.collect_list("value")).alias("edges"))
    rows = df.join(F.broadcast(at), F.lit(True))
    return rows.withColumn("q", F.lit(1) + sum((F.col(value) > F.col("edges")[i]).cast("int") for i in range(3))).drop("edges")


def lead_times(landed: DataFrame, by: str) -> DataFrame:
    """Count, median and 90th percentile of hours at sea, and median offshore distance at the start, by a column."""
    return landed.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.expr("percentile(hours_at_sea, 0.5)"), 6).alias("median_lead_h"),
        F.round(F.expr("percentile(hours_at_sea, 0.9)"), 6).alias("p90_lead_h"),
        F.round(F.expr("percentile(offshore_km_at_start, 0.5)"), 6).alias("offshore_km"),
    )


def top_provinces(landed: DataFrame, n: int = 14) -> DataFrame:
    """:func:`lead_times` of the ``n`` provinces with most landfalls, most first; a place without a province is none."""
    return lead_times(landed.where("province IS NOT NULL"), "province").orderBy(F.desc("n"), "province").limit(n)


def lead_histogram(landed: DataFrame, most: float = 24.0) -> DataFrame:
    return landed.groupBy(F.least("hours_at_sea", F.lit(most)).alias("hours_at_sea")).agg(F.count("*").alias("n"))


def offshore_bands(landed: DataFrame, edges: tuple[float, ...] = (0, 15, 30, 50, 100, 10_000)) -> DataFrame:
    """Right-closed bands of offshore distance (0 itself in none) with count and median hours at sea."""
    band = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        band = F.when((F.col("offshore_km_at_start") > a) & (F.col("offshore_km_at_start") <= b), F.lit(f"({a}, {b}]")).otherwise(band)
    rows = landed.withColumn("band", band).where("band IS NOT NULL")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.round(F.expr("percentile(hours_at_sea, 0.5)"), 6).alias("median_lead_h"))


def regression(landed: DataFrame, y: str = "hours_at_sea", x: str = "offshore_km_at_start") -> DataFrame:
    """Pearson r and the least-squares line."""
    return landed.agg(F.round(correlation(y, x), 6).alias("r"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.count("*").alias("n"))


def landfall_percentiles(landed: DataFrame) -> DataFrame:
    """Percentiles and maximum of hours at sea, and the share that lands on the first vertex."""
    levels = {f"p{q}": q / 100 for q in (10, 25, 50, 75, 90, 99)}
    return landed.agg(*[F.round(F.expr(f"percentile(hours_at_sea, {v})"), 6).alias(k) for k, v in levels.items()], F.max("hours_at_sea").alias("max_h"), F.avg((F.col("landfall_idx") == 0).cast("double")).alias("first_step_share"))
