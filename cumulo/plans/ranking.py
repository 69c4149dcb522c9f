"""Ranks, running sums and quantiles over a whole table, without a window in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.columns import EXACT
from cumulo.plans.shared import materialize


def ranked(df: DataFrame, order: list[Column], running: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1, by ``order``), ``total_rows`` and, for a column, ``running`` and ``total`` sums.

    Rows are dealt by range and written; each part's count and sum, one row a part, shift the ranks inside it.  The
    order should be total.  Sums are exact decimals, so they don't depend on how rows were dealt.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    value = F.col(running).cast(EXACT) if running else F.lit(0).cast(EXACT)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).cast(EXACT).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    shifts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).cast(EXACT).alias("_s0"),
        F.sum("_n").over(every).alias("total_rows"),
        F.sum("_s").over(every).cast(EXACT).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    out = parts.join(F.broadcast(shifts), "_part").withColumn("rank", F.col("_n0") + F.row_number().over(inside))
    if running:
        so_far = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast(EXACT)
        out = out.withColumn("running", (F.col("_s0") + so_far).cast("double")).withColumn("total", F.col("_total").cast("double"))
    return out.drop("_part", "_n0", "_s0", "_total")


def quantiles(df: DataFrame, column: str, levels: list[float]) -> DataFrame:
    """``(level, value)``: linear-interpolated quantiles of the non-null values, exact; null values for an empty table."""
    rows = ranked(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), [F.col("v")])
    asked = df.sparkSession.createDataFrame([(float(q),) for q in levels], "level double")
    place = F.col("level") * (F.col("total_rows") - 1)
    at = lambda q: q * (F.col("total_rows") - 1)
    near_by = F.filter(F.array(*[F.lit(float(q)) for q in levels]), lambda q: (F.col("rank") - 1 == F.floor(at(q))) | (F.col("rank") - 1 == F.ceil(at(q))))
    near = rows.select("v", "rank", "total_rows", F.explode(near_by).alias("level"))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    found = near.groupBy("level").agg((low + (high - low) * F.max(place - F.floor(place))).alias("value"))
    return asked.join(found, "level", "left")


def group_quantiles(df: DataFrame, by: str, column: str, levels: dict[str, float]) -> DataFrame:
    """(by, one column for each of ``levels``): linear-interpolated quantiles of the non-null values of each group, exact.

    For columns with as many different values as rows, where an aggregate would hold a whole group's values in one task.
    Rows are dealt by range of group and value; counts by part and group, a row for each of the few groups that a part holds,
    give each row its rank in its group.
    """
    rows = df.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("_v"))
    parts = materialize(rows.repartitionByRange(by, "_v").withColumn("_part", F.spark_partition_id()), "ranged")
    group = Window.partitionBy(by)
    sizes = parts.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    shifts = sizes.select(by, "_part", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n0"), F.sum("_n").over(group).alias("_total"))
    place = parts.join(shifts, [by, "_part"]).withColumn("_k", F.col("_n0") + F.row_number().over(Window.partitionBy("_part", by).orderBy("_v")) - 1)
    at = {name: q * (F.col("_total") - 1) for name, q in levels.items()}
    near = [(F.col("_k") == F.floor(a)) | (F.col("_k") == F.ceil(a)) for a in at.values()]
    hit = near[0]
    for n in near[1:]:
        hit = hit | n
    picked = place.where(hit)
    value = lambda a, n: F.min(F.when(n, F.col("_v"))) + (F.max(F.when(n, F.col("_v"))) - F.min(F.when(n, F.col("_v")))) * F.max(a - F.floor(a))
    return picked.groupBy(by).agg(*[value(a, n).alias(name) for (name, a), n in zip(at.items(), near)])


def kth_largest(df: DataFrame, column: str, ks: list[int]) -> DataFrame:
    """``(k, value)`` of the k-th largest values; top rows only, so no full sort."""
    top = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).orderBy(F.desc("value")).limit(max(ks))
    rows = top.withColumn("k", F.row_number().over(Window.orderBy(F.desc("value"))))
    return rows.where(F.col("k").isin(ks)).select("k", "value")
