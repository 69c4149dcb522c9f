"""Connected components on DataFrames: alternating large-star and small-star rounds.

Each round is a grouped minimum (combined map-side) and an equi-join, so a hub
node never gathers its neighbours in one task; adaptive skew handling may split
its join partition.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.plans import local
from cumulo.plans.pointers import follow
from cumulo.plans.shared import discard, in_one_part, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, near: bool = False) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; component is the least node reachable.

    Self-loops and edges with a null end are ignored; repeated edges count once.
    An edge table without rows gives a table without rows.  With ``near``, neighbours tend to have close numbers: edges are
    dealt by range and contracted within each part first.
    """
    given = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    given = given.select(F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")).where("src > dst")
    current = materialize(local.stars(given.repartitionByRange("src")) if near else given.distinct(), "edges")
    if near and in_one_part(current) and given.count() <= local.CHUNK:  # all edges were one chunk, so each node has its least
        return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, old = mark, current
        current = materialize(_small_star(_large_star(current)), "edges")
        discard(old)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def contracted(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """Ends of ``graph`` (a, b, saddle s) replaced by their roots (node, root); loops go, the best saddle stays."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    moved = graph.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "s")
    return moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))


def joining(graph: DataFrame, heights: DataFrame, max_rounds: int = 200) -> DataFrame | None:
    """``(node, next, sr, sn)``: which node each node joins when levels fall, and at which saddle; None where no node joins any.

    ``graph`` is (a, b, s), s the saddle (r, n); ``heights`` is (node, fixed, r).  A node whose best saddle leads to a higher node joins it there:
    fixed ones are higher than others and join nobody, then the rate counts, then the smaller number.  Chunks of the graph are contracted where they
    lie; then the ends are replaced and the next round begins.  A round in which no chunk holds a node's every edge takes the best
    edges by a grouped maximum instead.
    """
    found = []
    of = lambda end: heights.select(F.col("node").alias(end), F.col("fixed").alias(f"f{end}"), F.col("r").alias(f"r{end}"))
    for _ in range(max_rounds):
        known = graph.join(of("a"), "a").join(of("b"), "b").where("NOT (fa AND fb)")
        known = materialize(known.select("a", "b", F.col("s.r").alias("sr"), F.col("s.n").alias("sn"), "fa", "ra", "fb", "rb"), "reach")
        left = known.count()
        if not left:
            break
        both = known.union(known.select("b", "a", "sr", "sn", "fb", "rb", "fa", "ra"))
        step = materialize(local.joins(both.select(*local.EDGE).repartitionByRange("a").sortWithinPartitions("a")), "joins")
        if in_one_part(step) and 2 * left <= local.CHUNK:  # the whole graph was one chunk
            found.append(step)
            break
        if step.isEmpty():
            own, other = F.struct("fa", "ra", (-F.col("a")).alias("n")), F.struct(F.col("fb").alias("fa"), F.col("rb").alias("ra"), (-F.col("b")).alias("n"))
            best = both.groupBy("a", own.alias("own")).agg(F.max(F.struct("sr", "sn", other.alias("other"))).alias("best")).where("NOT own.fa AND best.other > own")
            step = materialize(best.select(F.col("a").alias("node"), (-F.col("best.other.n")).alias("next"), "best.sr", "best.sn"), "joins")
        if step.isEmpty():
            break
        found.append(step)
        graph = contracted(known.select("a", "b", F.struct(F.col("sr").alias("r"), F.col("sn").alias("n")).alias("s")), follow(step.select("node", "next")))
    else:
        raise RuntimeError("the graph doesn't shrink")
    return reduce(DataFrame.union, found) if found else None
