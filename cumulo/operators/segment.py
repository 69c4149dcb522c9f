"""Labelled objects in a sparse cube: neighbour edges, connected components, sizes and shares.

Voxels are rows (id, t, y, x, r), wet ones only; ``id`` is the flat index and orders ties.  Labels are the least or the
peak voxel's id, so they don't depend on how rows are dealt.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.plans import local
from cumulo.plans.graph import connected_components
from cumulo.plans.ranking import ranked


#: A threshold that every cell above 0 reaches.
ANY_RAIN = 5e-324


def voxels(cube: DataFrame, wet: float = 1.0) -> DataFrame:
    """(id, t, y, x, r) of the cube's cells at or over ``wet``; missing rates are dry.  The flat index uses the cube's extent."""
    size = cube.agg(F.max("y") + 1, F.max("x") + 1).first()
    ny, nx = (int(s or 1) for s in size)
    flat = (F.col("t").cast("long") * ny + F.col("y")) * nx + F.col("x")
    return cube.where((F.col("r") >= wet) & ~F.isnan("r")).select(flat.alias("id"), "t", "y", "x", "r")


#: Steps, rows and columns of a block in which neighbours meet.
BLOCK = (16, 32, 32)


def edges(vox: DataFrame, connectivity: int = 26) -> DataFrame:
    """(u, v, ru, rv), each neighbouring pair once, by 13 of the 26 shifts or 3 of the 6.

    Voxels are dealt by blocks; those on a block's border go to the blocks beside it too, a fifth more rows in all, and each task looks neighbours up
    within its blocks.  No block holds more than its cells and their border.
    """
    forward = [o for o in product((-1, 0, 1), repeat=3) if o > (0, 0, 0) and (connectivity == 26 or sum(map(abs, o)) == 1)]
    block = lambda c, n: F.floor(c / n).cast("int")
    spread = lambda c, n, after: F.explode(F.sequence(block(F.col(c) - 1, n), block(F.col(c) + after, n)))
    placed = vox.select("id", "t", "y", "x", "r")
    for c, n, after in zip("tyx", BLOCK, (0, 1, 1)):
        placed = placed.select("*", spread(c, n, after).alias(f"b{c}"))
    here = [F.col(f"b{c}") == block(F.col(c), n) for c, n in zip("tyx", BLOCK)]
    placed = placed.select("bt", "by", "bx", "t", "y", "x", "id", "r", (here[0] & here[1] & here[2]).alias("own"))
    return local.neighbours(placed.repartition("bt", "by", "bx").sortWithinPartitions("bt", "by", "bx"), BLOCK, forward, vox.schema["r"].dataType.simpleString())


def drop_small(labelled: DataFrame, min_voxels: int, label: str = "label") -> DataFrame:
    """Rows of labels with at least ``min_voxels`` rows."""
    if min_voxels <= 1:
        return labelled
    kept = labelled.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_voxels)
    return labelled.join(kept.select(label), label, "left_semi")


def label_ccl(vox: DataFrame, min_voxels: int = 6, connectivity: int = 26) -> DataFrame:
    """``vox`` with ``label``, the least id of the voxel's connected component; small components go."""
    parts = connected_components(edges(vox, connectivity), "u", "v", near=True)
    labelled = vox.join(parts, vox["id"] == parts["node"], "left").select(*vox.columns, F.coalesce("component", "id").alias("label"))
    return drop_small(labelled, min_voxels)


def numbered(labelled: DataFrame, label: str = "label") -> DataFrame:
    """``labelled`` with ``storm_id`` from 1 in the order of labels; one row a label is ranked, by range, not one a voxel."""
    ids = ranked(labelled.select(label).distinct(), [F.col(label)]).select(label, F.col("rank").cast("int").alias("storm_id"))
    return labelled.join(ids, label)


def percolation_share(labelled: DataFrame) -> DataFrame:
    """Largest object's share of the labelled voxels; 0 without any."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("percolation"))


def captured_share(labelled: DataFrame, vox: DataFrame) -> DataFrame:
    """Labelled voxels over wet voxels."""
    n = vox.agg(F.count("*").alias("wet"))
    return labelled.agg(F.count("*").alias("labelled")).join(n, F.lit(True)).select((F.col("labelled") / F.greatest("wet", F.lit(1))).alias("captured"))


def label_stats(vox: DataFrame) -> DataFrame:
    """Components of any size: count, wet voxels, largest and ten largest as shares of the wet ones, median, small ones, extent of the largest."""
    sizes = label_ccl(vox, 1).groupBy("label").agg(
        F.count("*").alias("n"),
        ((F.max("t") - F.min("t") + 1) * 0.5).alias("hours"),
        (F.max("y") - F.min("y") + 1).alias("lat_cells"),
        (F.max("x") - F.min("x") + 1).alias("lon_cells"),
    )
    order = F.struct(F.col("n"), -F.col("label"))
    top = sizes.orderBy(F.desc("n"), "label").limit(10).agg(F.sum("n").alias("top10"))
    rows = sizes.agg(
        F.count("*").alias("objects"),
        F.sum("n").alias("wet"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        F.expr("percentile(n, 0.5)").alias("median_voxels"),
        F.sum((F.col("n") < 6).cast("long")).alias("under_6"),
        F.max_by("hours", order).alias("largest_hours"),
        F.max_by("lat_cells", order).alias("largest_lat_cells"),
        F.max_by("lon_cells", order).alias("largest_lon_cells"),
    )
    return rows.join(top, F.lit(True)).withColumn("top10_share", F.col("top10") / F.col("wet")).drop("top10")


def method_row(name: str, labelled: DataFrame, vox: DataFrame) -> DataFrame:
    """(method, storms, largest_share, captured) of one segmentation."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    wet = vox.agg(F.count("*").alias("wet"))
    rows = sizes.agg(F.count("*").alias("storms"), F.max("n").alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).join(wet, F.lit(True))
    return rows.select(F.lit(name).alias("method"), "storms", F.coalesce(F.col("top") / F.col("all"), F.lit(0.0)).alias("largest_share"), (F.col("all") / F.greatest("wet", F.lit(1))).alias("captured"))
