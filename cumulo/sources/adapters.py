"""Star-schema tables seen as a storm catalogue, tracks, a rain cube and link events; views only, nothing is generated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulo.functions.constants import GRID_DEG, LAT_CELLS, LAT_FIRST, LON_CELLS, LON_FIRST


def _lat(key: str):
    return F.lit(LAT_FIRST) + F.lit(GRID_DEG) * ((F.col(key) * 37) % LAT_CELLS)


def _lon(key: str):
    return F.lit(LON_FIRST) + F.lit(GRID_DEG) * ((F.col(key) * 91) % LON_CELLS)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One storm for each order with lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.max("l_quantity").cast("int").alias("n_timesteps"),
        (F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double") / F.lit(1e6)).alias("total_volume_km3"),
        F.max("l_quantity").alias("max_intensity_mm_hr"),
        F.count("*").alias("n_voxels"),
        (F.max("l_extendedprice") / F.lit(1e3)).alias("max_area_km2"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(
        F.col("o_orderkey").alias("storm_uid"),
        F.col("o_orderdate").alias("start_time"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 30 * (n_timesteps - 1), 0)").alias("end_time"),
        "n_timesteps",
        (F.lit(0.5) * F.col("n_timesteps")).alias("duration_h"),
        "total_volume_km3",
        "max_intensity_mm_hr",
        "max_area_km2",
        "n_voxels",
        _lat("o_custkey").alias("wcentroid_lat"),
        _lon("o_custkey").alias("wcentroid_lon"),
        F.col("o_orderdate").alias("wcentroid_time"),
        (F.col("o_orderstatus") == "P").alias("truncated_time"),
        (F.col("o_orderpriority") == "5-LOW").alias("truncated_space"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vertex for each line, in a total order: (storm_uid, t, lat, lon, volume_km3)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("storm_uid"),
        (F.row_number().over(order) - 1).alias("t"),
        _lat("l_partkey").alias("lat"),
        _lon("l_partkey").alias("lon"),
        (F.col("l_extendedprice") / F.lit(1e6)).alias("volume_km3"),
    )


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet voxels (t, y, x, r) of events in half-hour bins; rates are a tenth of the largest value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    half_hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_800_000_000)).cast("int")
    return events.groupBy(half_hour.alias("t"), F.floor(F.col("user_id") / 15).cast("int").alias("y"), F.pmod("user_id", F.lit(15)).cast("int").alias("x")).agg(
        (F.max("value") / 10).alias("r")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as storms to be linked: (storm_uid, start_time, end_time, lat, lon, volume_km3, intensity, area)."""
    y, x = F.floor(F.col("user_id") / 15), F.pmod("user_id", F.lit(15))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("storm_uid"),
        F.col("ts").alias("start_time"),
        F.col("ts").alias("end_time"),
        (F.lit(LAT_FIRST) + F.lit(0.45) * y).alias("lat"),
        (F.lit(LON_FIRST) + F.lit(0.45) * x).alias("lon"),
        F.col("value").alias("volume_km3"),
        (F.col("value") / 10).alias("max_intensity_mm_hr"),
        F.col("value").alias("max_area_km2"),
    )


def grid(spark: SparkSession) -> DataFrame:
    """(y, x, is_land, province): land in blocks of eight cells like a chess board, provinces in larger blocks."""
    cells = spark.range(LAT_CELLS * LON_CELLS).select(F.floor(F.col("id") / LON_CELLS).cast("int").alias("y"), (F.col("id") % LON_CELLS).cast("int").alias("x"))
    return cells.select(
        "y",
        "x",
        ((F.floor(F.col("y") / 8) + F.floor(F.col("x") / 8)) % 2 == 0).alias("is_land"),
        F.concat_ws("-", F.lit("P"), F.floor(F.col("y") / 46), F.floor(F.col("x") / 59)).alias("province"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as polygons (order, name, ring of (lat, lon)): a dart with its notch to the south, as wide as the part's size says."""
    lat, lon, r = _lat("p_partkey") + F.lit(0.013), _lon("p_partkey") + F.lit(0.017), F.lit(0.2) + F.col("p_size") / F.lit(25.0)
    corners = ((lat + r, lon), (lat - r, lon + r), (lat - F.lit(0.3) * r, lon), (lat - r, lon - r))
    ring = F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in corners])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("order"), F.col("p_brand").alias("name"), ring.alias("ring"))
