"""Following pointers to their ends by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.plans import local
from cumulo.plans.shared import discard, in_one_part, materialize


def follow(pointers: DataFrame, max_rounds: int = 60, key: tuple[str, str] | None = None) -> DataFrame:
    """``(node, root)`` from ``(node, next)`` without cycles; a ``next`` that is no node is an end.

    Numbers of neighbours tend to be close, so paths are followed within parts by range first; then they halve each round.
    With two columns of a ``key`` each node also gets the least key on its way.
    """
    names = list(key or ())
    now = materialize(local.shortened(pointers.select("node", F.col("next").alias("root"), *names).repartitionByRange("node")), "pointers")
    if in_one_part(now) and now.count() <= local.CHUNK:  # they were one chunk, so every path has been followed to its end
        return now.select("node", "root", *names)
    for _ in range(max_rounds):
        onward = now.select(F.col("node").alias("root"), F.col("root").alias("further"), *[F.col(c).alias(f"{c}_on") for c in names])
        both = now.join(onward, "root", "left")
        less = F.least(F.struct(*names), F.when(F.col("further").isNotNull(), F.struct(*[F.col(f"{c}_on").alias(c) for c in names]))) if names else None
        moved = materialize(both.select("node", F.coalesce("further", "root").alias("root"), *[less[c].alias(c) for c in names], F.col("further").isNotNull().alias("moved")), "pointers")
        discard(now)
        now = moved
        if now.where("moved").isEmpty():
            return now.select("node", "root", *names)
    raise RuntimeError("pointers form a cycle")
