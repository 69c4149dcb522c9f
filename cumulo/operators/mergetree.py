"""Merge tree of a sparse cube and its cut at a prominence, as rounds of joins.

Every voxel climbs to its best neighbour until a local maximum: its basin.  Basins touch at saddles.  A component whose
highest saddle leads to a higher peak dies there, and all such merge in one round; what is left of the graph is
contracted and the next round begins.  The order of voxels is total (rate falling, then id), so the tree is the one that
a sweep of the voxels in that order finds.  No group or task holds a whole tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.operators.segment import drop_small, edges, label_ccl
from cumulo.plans.graph import joining
from cumulo.plans.pointers import follow
from cumulo.plans.selection import select_quantiles
from cumulo.plans.shared import materialize

MAX_ROUNDS = 200


def basins(vox: DataFrame, touching: DataFrame) -> DataFrame:
    """(id, basin): the local maximum that steepest ascent along the edges ``touching`` (:func:`~cumulo.operators.segment.edges`) reaches."""
    both = touching.select(F.col("u").alias("id"), F.struct(F.col("rv").alias("r"), (-F.col("v")).alias("n")).alias("best")).union(touching.select("v", F.struct(F.col("ru").alias("r"), (-F.col("u")).alias("n"))))
    own = vox.select("id", F.struct("r", (-F.col("id")).alias("n")).alias("best"))
    up = both.union(own).groupBy("id").agg(F.max("best").alias("best")).select(F.col("id").alias("node"), (-F.col("best.n")).alias("next"))
    moving = follow(up.where("node <> next"))
    return vox.join(moving, vox["id"] == moving["node"], "left").select("id", F.coalesce("root", "id").alias("basin"))


def saddles(touching: DataFrame, basin: DataFrame) -> DataFrame:
    """(a, b, s): the best saddle (rate, -id of the lower voxel) between each two basins that touch, a < b."""
    at = touching.join(basin.select(F.col("id").alias("u"), F.col("basin").alias("bu")), "u").join(basin.select(F.col("id").alias("v"), F.col("basin").alias("bv")), "v")
    lower = F.least(F.struct(F.col("ru").alias("r"), (-F.col("u")).alias("n")), F.struct(F.col("rv").alias("r"), (-F.col("v")).alias("n")))
    return at.where("bu <> bv").groupBy(F.least("bu", "bv").alias("a"), F.greatest("bu", "bv").alias("b")).agg(F.max(lower).alias("s"))


def build(vox: DataFrame, wet: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(components, basin): ``(comp_id, birth, death, parent, persistence)`` and ``(id, basin)`` on the 26-neighbour graph.

    comp_id is the peak's voxel.  Where components meet the lower peak dies (equal rates: the larger id); its parent is the
    component it joins.  The last of each connected part dies at ``wet`` with parent -1.  No voxels, no components.
    """
    touching = materialize(edges(vox, 26), "edges")
    basin = materialize(basins(vox, touching), "basins")
    peaks = materialize(basin.where("id = basin").join(vox.select("id", "r"), "id").select(F.col("id").alias("comp_id"), F.col("r").alias("birth")), "peaks")
    deaths = joining(saddles(touching, basin), peaks.select(F.col("comp_id").alias("node"), F.lit(False).alias("fixed"), F.col("birth").cast("double").alias("r")))
    if deaths is None:
        return peaks.select("comp_id", "birth", F.lit(wet).cast("double").alias("death"), F.lit(-1).cast("long").alias("parent"), (F.col("birth") - wet).alias("persistence")), basin
    deaths = materialize(deaths.select("node", "next", F.struct(F.col("sr").alias("r"), F.col("sn").alias("n")).alias("s")), "deaths")
    # A component that it joined may itself have died at a higher saddle: its heir is the parent.
    now = deaths.select("node", F.col("next").alias("parent"), "s")
    earlier = deaths.select(F.col("node").alias("parent"), F.col("next").alias("heir"), F.col("s").alias("s2"))
    for _ in range(MAX_ROUNDS):
        stepped = now.join(earlier, "parent", "left").withColumn("moved", F.coalesce(F.col("s2") >= F.col("s"), F.lit(False)))
        if stepped.where("moved").isEmpty():
            break
        now = materialize(stepped.select("node", F.when(F.col("moved"), F.col("heir")).otherwise(F.col("parent")).alias("parent"), "s"), "parents")
    else:
        raise RuntimeError("parents don't settle")
    died = now.select(F.col("node").alias("comp_id"), F.col("s.r").alias("death"), "parent")
    rows = peaks.join(died, "comp_id", "left").select("comp_id", "birth", F.coalesce("death", F.lit(wet)).alias("death"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))
    return rows.withColumn("persistence", F.col("birth") - F.col("death")), basin


def survivors(components: DataFrame, h: float) -> DataFrame:
    """Components of at least that persistence, and all roots."""
    return components.where((F.col("persistence") >= h) | (F.col("parent") < 0))


def survivor_of(components: DataFrame, h: float) -> DataFrame:
    """(comp_id, survivor): the nearest ancestor that survives the cut, itself included."""
    gone = components.where((F.col("persistence") < h) & (F.col("parent") >= 0)).select(F.col("comp_id").alias("node"), F.col("parent").alias("next"))
    ends = follow(gone)
    return components.join(ends, components["comp_id"] == ends["node"], "left").select("comp_id", F.coalesce("root", "comp_id").alias("survivor"))


def summary(components: DataFrame) -> DataFrame:
    """(components, roots, max_persistence, median_persistence) of a tree."""
    rows = components.agg(F.count("*").alias("components"), F.sum((F.col("parent") < 0).cast("long")).alias("roots"), F.max("persistence").alias("max_persistence"))
    return rows.join(select_quantiles(components, {"median_persistence": ("persistence", 0.5)}), F.lit(True), "left")


def hierarchy(components: DataFrame, h: float) -> DataFrame:
    """(survivor, comp_id, birth, death, persistence): a row for every component that the cut folds into a survivor."""
    held = components.join(survivor_of(components, h), "comp_id").where("comp_id <> survivor")
    return held.select("survivor", "comp_id", "birth", "death", "persistence")


def cut_topological(vox: DataFrame, components: DataFrame, basin: DataFrame, h: float, min_voxels: int = 6) -> DataFrame:
    """``vox`` with ``label`` of the survivor that first touched it; a diagnostic, uneven where two survivors meet."""
    joined = vox.join(basin, "id").join(survivor_of(components, h), F.col("basin") == F.col("comp_id")).select(*vox.columns, F.col("survivor").alias("label"))
    return drop_small(joined, min_voxels)


def _at(df: DataFrame, n: int, ids: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` once for each of ``n`` heights: number v at height k is v * n + k, and the n of a key (r, n), minus such a number, follows."""
    if n == 1:
        return df
    every = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in ids:
        every = every.withColumn(c, F.col(c) * n + F.col("_k"))
    for c in keys:
        every = every.withColumn(c, F.struct(F.col(f"{c}.r").alias("r"), (F.col(f"{c}.n") * n - F.col("_k")).alias("n")))
    return every.drop("_k")


class Flood:
    """The graph that is flooded, made once and flooded from any markers, for many heights at once.

    The flood is the sequential one: a queue ordered by rate, then id, starts with the markers' voxels; who leaves it hands its label to
    all its neighbours without one, which enter it.  So a voxel has the label of the neighbour that left first.
    That order needs no queue.  A voxel's *passage* is the best of all ways from a marker, each worth the least voxel on it.  Voxels leave by
    falling passage, and those of equal passage hang together behind one voxel, the passage itself, whose label they all get.  That voxel
    has the label of its neighbour with the highest passage.  Passages are the voxel's own rate or the level of its basin,
    and levels come from the same contraction as the merge tree, with the markers' basins fixed.
    """

    def __init__(self, vox: DataFrame, connectivity: int = 6) -> None:
        self.touching = materialize(edges(vox, connectivity), "edges")
        self.vox, self.basin = vox, materialize(basins(vox, self.touching), "basins")
        self.graph = saddles(self.touching, self.basin)

    def grow(self, markers: DataFrame, n: int = 1) -> DataFrame:
        """``vox`` with ``label`` of the marker that floods each voxel; unreached ones go.

        ``markers`` is (id, label); the voxels of one label that touch have equal rates, and the highest voxel of a marker's basin is one of its label.
        For ``n`` heights ids and labels are those of :func:`_at`, in the result too.
        """
        vox, basin, touching = _at(self.vox, n, ("id",)), _at(self.basin, n, ("id", "basin")), _at(self.touching, n, ("u", "v"))
        fixed = markers.select(F.col("id").alias("node"), F.lit(True).alias("fixed"))
        peaks = basin.where("id = basin").join(vox.select("id", "r"), "id").select(F.col("id").alias("node"), F.col("r").cast("double").alias("r"))
        heights = materialize(peaks.join(fixed, "node", "left").select("node", F.coalesce("fixed", F.lit(False)).alias("fixed"), "r"), "heights")
        joined = joining(_at(self.graph, n, ("a", "b"), ("s",)), heights)
        levels = heights.where("fixed").select(F.col("node").alias("basin"), F.lit(None).cast("struct<r:double,n:bigint>").alias("level"))
        if joined is not None:
            ends = follow(joined, key=("sr", "sn")).join(heights.where("fixed").select(F.col("node").alias("root")), "root", "left_semi")
            levels = levels.union(ends.select(F.col("node").alias("basin"), F.struct(F.col("sr").alias("r"), F.col("sn").alias("n")).alias("level")))
        own = F.struct(F.col("r").cast("double").alias("r"), (-F.col("id")).alias("n"))
        reached = vox.join(basin, "id").join(levels, "basin").withColumn("way", F.when(F.col("level").isNull(), own).otherwise(F.least(own, "level")))
        reached = materialize(reached.select(*vox.columns, "way"), "passages")
        starts = reached.select("id", "way").join(markers.select("id"), "id", "left_anti")
        heads = starts.where("way.n = -id").select("id")
        both = touching.select("u", "v").union(touching.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(heads.withColumnRenamed("id", "u"), "u", "left_semi")
        first = both.join(reached.select(F.col("id").alias("v"), "way"), "v").groupBy("u").agg(F.max("way").alias("way"))
        behind = starts.where("way.n <> -id").select(F.col("id").alias("node"), (-F.col("way.n")).alias("next"))
        root = follow(behind.union(first.select(F.col("u").alias("node"), (-F.col("way.n")).alias("next"))))
        ended = reached.join(root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        return ended.join(markers.select(F.col("id").alias("root"), "label"), "root").select(*self.vox.columns, "label")

    def cuts(self, components: DataFrame, heights: list[float], min_voxels: int = 6) -> DataFrame:
        """Voxels with ``h`` and ``label``, the surviving peak whose flood reaches them, for all heights in one flood; small objects go."""
        n = len(heights)
        levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(h)).alias("h")) for k, h in enumerate(heights)]))
        at = components.withColumn("at", levels).where((F.col("persistence") >= F.col("at.h")) | (F.col("parent") < 0))
        place = F.col("comp_id") * n + F.col("at.k")
        held = drop_small(materialize(self.grow(materialize(at.select(place.alias("id"), place.alias("label")), "markers"), n), "flooded"), min_voxels)
        k = F.pmod("label", F.lit(n)).cast("int")
        return held.withColumn("h", F.get(F.array(*[F.lit(float(h)) for h in heights]), k)).withColumn("id", ((F.col("id") - k) / n).cast("long")).withColumn("label", ((F.col("label") - k) / n).cast("long"))

    def cut(self, components: DataFrame, h: float, min_voxels: int = 6) -> DataFrame:
        """Voxels with ``label``, the surviving peak whose flood reaches them; small objects go."""
        return self.cuts(components, [h], min_voxels).drop("h")


def segment_at(vox: DataFrame, h: float = 4.0, min_voxels: int = 6, wet: float = 1.0, flood_connectivity: int = 6) -> DataFrame:
    """The default segmentation: tree on 26 neighbours, flood on ``flood_connectivity``."""
    components, _ = build(vox, wet)
    return Flood(vox, flood_connectivity).cut(materialize(components, "components"), h, min_voxels)


def seeds(field: DataFrame, prominence: float, wet: float = 1.0, window: Column | None = None) -> DataFrame:
    """``(id, label)``: wet voxels from which no strictly higher one is reached without falling ``prominence`` below them.

    ``field`` holds every cell above 0, so that the way between two peaks counts below ``wet`` too; a cell that it doesn't hold is at 0, and the
    highest peaks of all, or of each ``window`` that a column of ``field`` names, are seeds whatever the prominence.  Seeds that touch, on 26
    neighbours, share the least id as their label.
    """
    components, basin = build(field, 0.0)
    components = materialize(components, "components")
    above = components.select(F.col("comp_id").alias("parent"), F.col("birth").alias("above"))
    # Dying to a peak of equal rate isn't yet a way to a higher one: that is where the last of equal peaks dies.
    level = components.join(above, "parent", "left").where("above = birth").select(F.col("comp_id").alias("node"), F.col("parent").alias("next"))
    last = components.join(follow(level).withColumnRenamed("node", "comp_id"), "comp_id", "left").select("comp_id", "birth", F.coalesce("root", "comp_id").alias("last"))
    fallen = last.join(components.select(F.col("comp_id").alias("last"), "death"), "last")
    places = field.select(F.col("id").alias("comp_id"), (F.lit(0) if window is None else window).alias("window"))
    fallen = materialize(fallen.join(places, "comp_id"), "fallen")
    kept = fallen.join(fallen.groupBy("window").agg(F.max("birth").alias("top")), "window").where((F.col("birth") - F.col("death") >= prominence) | (F.col("birth") == F.col("top")))
    peaks = field.where(F.col("r") >= wet).join(basin, "id").join(kept.select(F.col("comp_id").alias("basin"), "birth"), "basin").where("r = birth")
    return label_ccl(materialize(peaks.select(*field.columns), "peaks"), 1).select("id", "label")


def label_watershed(field: DataFrame, prominence: float = 4.0, min_voxels: int = 6, wet: float = 1.0, window: Column | None = None) -> DataFrame:
    """Wet voxels of ``field``, which holds every cell above 0, flooded from :func:`seeds`; plain components where there are none."""
    vox = field.where(F.col("r") >= wet)
    markers = materialize(seeds(field, prominence, wet, window), "seeds")
    if markers.isEmpty():
        return label_ccl(vox, min_voxels)
    return drop_small(materialize(Flood(vox).grow(markers), "flooded"), min_voxels)
