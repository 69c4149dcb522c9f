"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.buckets import Forest, pairs, tiled, whole_groups
from cumulo.plans.graph import connected_components
from cumulo.plans.shared import materialize


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text (UTF-8): a bit is set if it is set in over half of the shingles' XXH64.

    A-Z is lower-cased; words are runs without the six ASCII white-space characters; repeated shingles count again.
    A text with fewer words is one shingle; a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - k + 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = hashes[i : i + 65536]
        votes += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(id_col, fp)``, fp a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x or b"", words_per_shingle, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"`{id_col}` long, fp long")


def block_masks(max_bits: int, n_blocks: int) -> list[int]:
    """Masks of every choice of n_blocks - max_bits of the blocks: fingerprints within max_bits agree under one at least."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, n_blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = 4, n_blocks: int = 8, tile_rows: int = 1000, task_rows: int = 20_000) -> DataFrame:
    """Spanning links ``(src, dst)`` between distinct fingerprints ``fp`` that differ in at most max_bits bits.

    Every bucket's own components are kept whole; the pairs themselves are not written.
    """
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(max_bits, n_blocks)]))
    # Every fingerprint becomes a row a mask, so a small table is dealt to more tasks first.
    rows = fps.select("fp").repartition(max(1, -(-fps.count() // task_rows)), "fp").select("fp", keys.alias("t", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, ["t", "key", "tile_a", "tile_b"]):
            own = t["fp"].to_numpy()
            fp, forest = own.view(np.uint64), Forest(t.num_rows)
            for i, j in pairs(groups):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                forest.join(i[near], j[near])
            at = np.flatnonzero(forest.root != np.arange(t.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[forest.root[at]])], names=["src", "dst"])

    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n"))
    return tiled(rows, sizes, ["t", "key"], "fp", tile_rows).mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, max_bits: int = 4, n_blocks: int = 8, seed: int = 42, tile_rows: int = 1000) -> DataFrame:
    """``(id_col, fp, component_id)``: documents linked, over any number of steps, by fingerprints at most max_bits apart.

    Equal fingerprints collapse to one node before any bucket is built, so groups of exact copies cost one row.
    component_id is the smallest id reachable, the row's own id included.  Every row is returned, repeated ids too; a row without
    an id takes part and links others by its text but can't be a component's name (null if the whole component has none).
    Empty or null texts share fingerprint 0.  Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words_per_shingle, seed), "fingerprints")
    least = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    parts = connected_components(links(least, max_bits, n_blocks, tile_rows))
    of = least.join(parts, least["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"), "least")
    named = of.groupBy("part").agg(F.min("least").alias("component_id")).join(of, "part").select(F.col("fp").alias("of"), "component_id")
    return fps.join(named, fps["fp"] == named["of"]).select(id_col, "fp", "component_id")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
