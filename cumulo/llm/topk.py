"""Exact top-k by inner product: a KD-tree for each shard, searched best box first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.vectors import finite
from cumulo.plans.shared import materialize


@dataclass
class Tree:
    """Nodes in an array: box of each, its rows' range, and its children (-1 at a leaf)."""

    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    span: np.ndarray
    child: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, leaf_rows: int) -> Tree:
    """Median splits along the widest side of each node's tight box; rows end up in leaf order, by id within a leaf."""
    order = np.argsort(ids, kind="stable")
    low, high, span, child = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        rows = order[a:b]
        box = points[rows]
        low.append(box.min(axis=0))
        high.append(box.max(axis=0))
        span.append((a, b))
        child.append([-1, -1])
        me = len(span) - 1
        if parent >= 0:
            child[parent][side] = me
        axis = int(np.argmax(high[me] - low[me]))
        if b - a > leaf_rows and high[me][axis] > low[me][axis]:
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(box[:, axis], half)]
            todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        else:
            order[a:b] = np.sort(rows)
    return Tree(ids[order], points[order], np.array(low), np.array(high), np.array(span), np.array(child))


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Each query's best (score, -id) found here that may still count: at least its ``kth`` score so far.

    A box's bound is the largest inner product that any point in it can have; a node is opened only if its bound reaches
    the k-th best score known, be it from here or from the shards before.  Numbers must be exact in their type.
    """
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = up @ tree.high.T + down @ tree.low.T
        for n in range(len(q)):
            own, floor, best = int(query_ids[at + n]), kth[at + n], []
            heap = [(-bounds[n, 0], 0)]
            while heap and -heap[0][0] >= floor:
                _, node = heapq.heappop(heap)
                left, right = tree.child[node]
                if left >= 0:
                    for c in (left, right):
                        if bounds[n, c] >= floor:
                            heapq.heappush(heap, (-bounds[n, c], int(c)))
                    continue
                a, b = tree.span[node]
                scores = tree.points[a:b] @ q[n]
                hit = np.flatnonzero(scores >= floor)
                hit = hit[tree.ids[a:b][hit] != own]
                if len(hit) > k:
                    hit = hit[np.lexsort((tree.ids[a:b][hit], -scores[hit]))][:k]
                best += [(int(scores[i]), -int(tree.ids[a + i])) for i in hit]
                if len(best) >= k:
                    best = heapq.nlargest(k, best)
                    floor = max(floor, best[-1][0])
            yield at + n, best


def _exact(points: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where every inner product stays a whole number below 2**53, else 64-bit integers."""
    most = np.abs(points).max(initial=0).astype(float) * np.abs(queries).max(initial=0).astype(float) * points.shape[1]
    return np.float64 if most < 2**53 else np.int64


#: Components of a shard's points, 8 bytes each, whatever their dimension; and bytes of trees that may be broadcast.
SHARD_COMPONENTS, BROADCAST_BYTES = 1 << 20, 64 << 20


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16_384, block_rows: int = 2048, leaf_rows: int = 128) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best candidates by integer inner product, ties to the smaller id.

    Both inputs are ``(vec_id long, point array<long>)``.  Rows are numbered and dealt by number, candidates to shards, queries
    to blocks, so equal rows never fill one of them.  Each shard's tree is built once and stays where it is: the blocks, a few
    hundredths of the rows, travel to the shards.  Shard 0 goes first for all blocks: its k-th scores are lower bounds
    that the other shards' searches start from.  Every row is a candidate, repeated ones too, but those with the query's own id;
    equal queries are one, and queries of one id and different points each have their ranks.  Points of another dimension
    than the query's take no part.  Shards and blocks hold fewer rows where points are long, ``SHARD_COMPONENTS`` at most on average.
    The first shard's tree is broadcast while it has at most ``BROADCAST_BYTES``, and shuffled like the others beyond.
    """

    def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        own = materialize(df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "point"), name)
        return own, own.count()

    candidates, n_candidates = numbered(candidates, "candidates")
    queries, n_queries = numbered(queries.select("vec_id", "point").distinct(), "queries")
    longest = candidates.agg(F.max(F.size("point"))).first()[0] or 1
    shard_rows, block_rows = (max(1, min(n, SHARD_COMPONENTS // longest)) for n in (shard_rows, block_rows))
    n_shards, n_blocks = max(1, -(-n_candidates // shard_rows)), max(1, -(-n_queries // block_rows))

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["point"].to_list()).astype(np.int64), leaf_rows)
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], **{n: [getattr(made, n).astype(np.int64).tobytes()] for n in ("ids", "points", "low", "high", "span", "child")}})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate(pdf["point"].to_list()).astype(np.int64)
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], **{n: [x.to_numpy(np.int64).tobytes()] for n, x in (("rows", pdf["row"]), ("query_ids", pdf["vec_id"]), ("kth", pdf["kth"]))}, "query_points": [points.tobytes()]})

    def hashed(df: DataFrame, n: int, name: str) -> DataFrame:
        return df.withColumn("dim", F.size("point")).withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))

    made = hashed(candidates, n_shards, "shard").groupBy("shard", "dim").applyInPandas(tree, "shard int, dim int, ids binary, points binary, low binary, high binary, span binary, child binary")
    trees = materialize(made, "trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                row = {name: b.column(name)[n].as_py() for name in b.schema.names}
                dim, get = row["dim"], lambda name: np.frombuffer(row[name], np.int64)  # noqa: B023
                points, asked, ids, rows = get("points").reshape(-1, dim), get("query_points").reshape(-1, dim), get("query_ids"), get("rows")
                kind = _exact(points, asked)
                t = Tree(get("ids"), points.astype(kind), get("low").reshape(-1, dim).astype(kind), get("high").reshape(-1, dim).astype(kind), get("span").reshape(-1, 2), get("child").reshape(-1, 2))
                out = [(int(rows[n]), int(ids[n]), -i, s) for n, best in search(t, asked.astype(kind), ids, get("kth"), k) for s, i in best]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    found = "query long, query_id long, vec_id long, score long"

    def scan(first_shard: int, last_shard: int, bounds: DataFrame | None) -> DataFrame:
        nothing = F.lit(np.iinfo(np.int64).min)
        asked = queries.withColumn("kth", nothing) if bounds is None else queries.join(bounds, "row", "left").withColumn("kth", F.coalesce("kth", nothing))
        asked = hashed(asked, n_blocks, "block").groupBy("block", "dim").applyInPandas(block, "block int, dim int, rows binary, query_ids binary, kth binary, query_points binary")
        asked = materialize(asked, "blocks")
        shards, n = trees.where(F.col("shard").between(first_shard, last_shard)), last_shard - first_shard + 1
        if n == 1 and (shards.agg(F.sum(F.octet_length("points") + F.octet_length("low") + F.octet_length("high"))).first()[0] or 0) <= BROADCAST_BYTES:
            return asked.repartition(n_blocks, "block", "dim").join(F.broadcast(shards), "dim").mapInArrow(run, found)
        sent = asked.withColumn("shard", F.explode(F.expr(f"sequence({first_shard}, {last_shard})"))).repartition(n, "shard", "dim")
        return shards.repartition(n, "shard", "dim").join(sent, ["shard", "dim"]).mapInArrow(run, found)

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = materialize(scan(0, 0, None), "first")
    bounds = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"))
    every = first.union(scan(1, n_shards - 1, bounds)) if n_shards > 1 else first
    ranked = every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, point)``: floor(scale * x) of each component as double; null, empty or non-finite vectors are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    return rows.where(finite("v") & F.col("vec_id").isNotNull()).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("point"))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))
