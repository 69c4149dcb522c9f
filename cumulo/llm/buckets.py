"""Pairs inside buckets, without writing the pairs out.

Rows arrive sorted by bucket; each bucket is scanned with numpy in one task and
only a spanning set of links (at most one a row) leaves it.  Buckets above
``tile_rows`` are dealt over tiles first, so a hot bucket is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the group's number for each row; batches are sorted by ``keys`` (integers)."""
    held: list[pa.Table] = []

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < rows:
            continue
        t = pa.concat_tables(held)
        g = numbered(t)
        last = int(np.searchsorted(g, g[-1]))
        if last:
            yield t.slice(0, last), g[:last]
        held = [t.slice(last)]
    t = pa.concat_tables(held) if held else None
    if t is not None and t.num_rows:
        yield t, numbered(t)


def pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, inside equal runs of ``groups``, one lag at a time."""
    n = len(groups)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the group
    i = np.arange(n)
    for lag in range(1, int(sizes.max(initial=0))):
        i = i[left[i] > lag]
        yield i, i + lag


class Forest:
    """Least-index roots under unions of index pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def tiled(df: DataFrame, counts: DataFrame, keys: list[str], spread: str, tile_rows: int = 1000, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows of ``df`` whose tile holds two or more, dealt to ``(tile_a, tile_b)`` and sorted by bucket and tile.

    Bucket sizes come from ``counts`` (keys, n), combined map-side, so no task ever holds a hot bucket.  A bucket of n rows
    gets k = ceil(n / tile_rows) chunks; chunk c goes to the k tiles (min(c,j), max(c,j)), so each two rows meet and no
    tile holds over about 2 * tile_rows rows.  ``chunk`` is the row's own chunk.  Only buckets over ``tile_rows`` are looked up; their
    list is broadcast while it has at most ``broadcast_rows`` rows and joined by shuffle beyond that.
    """
    hot = counts.where(F.col("n") > tile_rows).select(*keys, F.ceil(F.col("n") / F.lit(tile_rows)).cast("int").alias("k"))
    if hot.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = F.broadcast(hot)
    dealt = (
        df.join(hot, keys, "left")
        .withColumn("k", F.coalesce("k", F.lit(1)))
        .withColumn("chunk", F.expr(f"CAST(pmod(xxhash64({spread}), k) AS INT)"))
        .withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
        .withColumn("tile_a", F.least("chunk", "j"))
        .withColumn("tile_b", F.greatest("chunk", "j"))
        .drop("k", "j")
    )
    by = [*keys, "tile_a", "tile_b"]
    # The window needs the same partitioning, so it adds no shuffle, and a sort that it shares; its groups are tiles.
    sized = dealt.repartition(*by).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    return sized.where("n > 1").drop("n")
