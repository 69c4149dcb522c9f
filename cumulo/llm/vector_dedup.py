"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.buckets import Forest, pairs, tiled, whole_groups
from cumulo.llm.vectors import finite, matrix
from cumulo.plans.graph import connected_components
from cumulo.plans.shared import materialize


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n vectors: about one chance vector a bucket, and a pair at the threshold missed with at most ``miss``.

    Two vectors at angle a agree on a random hyperplane with 1 - a / pi, on a table's bits with that to the power of bits.
    """
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def signed(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``reps`` (dim, rep, copies, v) with ``keys``, one int of ``bits`` sign bits for each table."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                for at in range(0, part.num_rows, 2000):
                    some = part.slice(at, 2000)
                    signs = (matrix(some.column(3), dim) @ planes[dim] >= 0).reshape(-1, tables, bits) @ weights
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, signs.size + 1, tables, np.int32)), pa.array(signs.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([*some.columns, keys], names=["dim", "rep", "copies", "v", "keys"])

    return reps.mapInArrow(run, "dim int, rep long, copies long, v array<double>, keys array<int>")


def tile_links(rows: DataFrame, threshold: float, tables: int) -> DataFrame:
    """``(rep, links, dst)`` of each tile: copies linked to rep and first met here, and a spanning link (null at a root).

    A pair that meets in several tables is counted in the first of them only, so sums over tiles are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, ["dim", "t", "key", "tile_a", "tile_b"], 8000):
            rep, copies, chunk, table = (t[c].to_numpy() for c in ("rep", "copies", "chunk", "t"))
            own_tile = (t["tile_a"].to_numpy() == t["tile_b"].to_numpy()), t["dim"].to_numpy()
            keys = t["keys"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
            links, forest = np.zeros(t.num_rows, np.int64), Forest(t.num_rows)
            for dim in np.unique(own_tile[1]).tolist():
                at = np.flatnonzero(own_tile[1] == dim)
                units = unit(matrix(t["v"].take(pa.array(at)), dim))
                for i, j in pairs(groups[at]):
                    cross = own_tile[0][at[i]] | (chunk[at[i]] != chunk[at[j]])
                    i, j = i[cross], j[cross]
                    near = np.concatenate([np.einsum("ij,ij->i", units[i[s : s + 4000]], units[j[s : s + 4000]]) >= threshold for s in range(0, len(i), 4000)] or [np.zeros(0, bool)])
                    i, j = at[i[near]], at[j[near]]
                    if not len(i):
                        continue
                    forest.join(i, j)
                    first = ~((keys[i] == keys[j]) & (np.arange(tables) < table[i][:, None])).any(axis=1)
                    np.add.at(links, i[first], copies[j[first]])
                    np.add.at(links, j[first], copies[i[first]])
            root = forest.root
            own = np.flatnonzero((links > 0) | (root != np.arange(t.num_rows)))
            dst = pa.array(rep[root[own]], mask=root[own] == own)
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(links[own]), dst], names=["rep", "links", "dst"])

    return rows.mapInArrow(run, "rep long, links long, dst long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, miss: float = 1e-4, tile_rows: int = 1000, seed: int = 7) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: vectors linked by cosine >= threshold, in double precision.

    n_links counts the other rows linked directly; component_id is the smallest id reachable, the row's own included; kept is
    id = component_id.  Equal vectors collapse to one representative with a count, which gives their links without pairs.
    Tables and bits follow from the number of different vectors (:func:`plan`): a pair just at the threshold is missed with
    probability ``miss``, closer ones less.  Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of different dimension are never compared.  Repeated ids stay separate rows; a row without an id
    links with nothing.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    takes_part = finite("v") & F.expr("exists(v, x -> x != 0)") & F.col("id").isNotNull()
    rows = rows.withColumn("v", F.when(takes_part, F.col("v")))
    reps = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialize(reps.select(F.size("v").alias("dim"), "rep", "copies", "v"), "distinct")
    bits, tables = plan(reps.count(), threshold, miss)
    keyed = materialize(signed(reps, bits, tables, seed), "signed")
    counts = keyed.select("dim", F.posexplode("keys").alias("t", "key")).groupBy("dim", "t", "key").agg(F.count("*").alias("n"))
    spread = tiled(keyed.select("*", F.posexplode("keys").alias("t", "key")), counts, ["dim", "t", "key"], "rep", tile_rows)
    found = materialize(tile_links(spread, threshold, tables), "links")
    parts = connected_components(found.where("dst IS NOT NULL"), "rep", "dst")
    summed = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        reps.join(summed, "rep", "left")
        .join(parts, F.col("rep") == parts["node"], "left")
        .select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.where("v IS NOT NULL").join(named, "v").select("id", "n_links", "component_id")
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
