"""Passes over rows that happen to lie together, before the rounds that join them: fewer rounds, the same result.

A chunk is at most ``CHUNK`` rows of a partition, so memory is bounded whatever a partition holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 500_000


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index connected to each of ``n`` by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def _chunks(df: DataFrame, make: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """``make`` of the columns of each chunk."""
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            out = make(*(t[c].to_numpy() for c in names))
            return pa.RecordBatch.from_arrays([pa.array(c, t.schema.field(n).type) for c, n in zip(out, names)], names=names)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield made()
                held = []
        if held:
            yield made()

    return df.mapInArrow(run, schema)


def neighbours(placed: DataFrame, size: tuple[int, int, int], offsets: list[tuple[int, int, int]], rate: str) -> DataFrame:
    """``(u, v, ru, rv)``: voxels u that are their block's own and the voxels v at ``offsets`` from them that stand in the block too.

    ``placed`` is (bt, by, bx, t, y, x, id, r, own), each block's rows together: its own ``size`` cells, the step after and a row and a column on either side.
    ``rate`` is the type of r.  Places are looked up in the sorted places of a chunk of whole blocks, so time doesn't grow with how full a block is.
    """
    names = placed.columns
    deep, wide, long = size[0] + 1, size[1] + 2, size[2] + 2

    def made(t: pa.Table) -> pa.RecordBatch:
        col = {c: t[c].to_numpy() for c in names if c != "r"}
        new = np.r_[False, np.any([np.diff(col[c]) != 0 for c in ("bt", "by", "bx")], axis=0)] if t.num_rows else np.zeros(0, bool)
        at = [col[c].astype(np.int64) - col[b].astype(np.int64) * n + k for c, b, n, k in zip("tyx", ("bt", "by", "bx"), size, (0, 1, 1))]
        place = ((np.cumsum(new) * deep + at[0]) * wide + at[1]) * long + at[2]
        order = np.argsort(place, kind="stable")
        known, own = place[order], order[col["own"][order]]
        us, vs = [], []
        for a, b, c in offsets:
            to = place[own] + (a * wide + b) * long + c
            found = np.minimum(np.searchsorted(known, to), len(known) - 1)
            hit = known[found] == to
            us.append(own[hit])
            vs.append(order[found[hit]])
        u, v = np.concatenate(us), np.concatenate(vs)
        r = t["r"].combine_chunks()
        return pa.RecordBatch.from_arrays([pa.array(col["id"][u]), pa.array(col["id"][v]), r.take(pa.array(u)), r.take(pa.array(v))], names=["u", "v", "ru", "rv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            last = np.any([t[c].to_numpy() != t[c][-1].as_py() for c in ("bt", "by", "bx")], axis=0)
            whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last block may go on in the next batch
            if whole:
                yield made(t.slice(0, whole))
            held, n = t.slice(whole).to_batches(), t.num_rows - whole
        if n:
            yield made(pa.Table.from_batches(held))

    return placed.mapInArrow(run, f"u long, v long, ru {rate}, rv {rate}")


def stars(edges: DataFrame) -> DataFrame:
    """Two columns of edges -> edges from each node of a chunk to the least that it is connected to there; the components stay."""

    def make(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root = least_roots(len(nodes), code[: len(src)], code[len(src) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[moved], nodes[root[moved]]

    return _chunks(edges, make)


def shortened(pointers: DataFrame) -> DataFrame:
    """``(node, next)`` without cycles -> the same nodes, each pointing as far as the chunk leads.

    Two more columns hold a key; then each node's key becomes the least on its way.
    """

    def make(node: np.ndarray, onward: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(node, kind="stable")
        known, to, *key = (c[order] for c in (node, onward, *key))
        place = np.minimum(np.searchsorted(known, to), len(known) - 1)
        at = np.where(known[place] == to, place, -1)  # where the next node is, if it is here
        while True:
            inside = np.flatnonzero(at >= 0)
            if not len(inside):
                return known, to, *key
            step = at[inside]
            if key:
                first, second = key
                less = (first[step] < first[inside]) | ((first[step] == first[inside]) & (second[step] < second[inside]))
                first[inside], second[inside] = np.where(less, first[step], first[inside]), np.where(less, second[step], second[inside])
            to[inside], at[inside] = to[step], at[step]

    return _chunks(pointers, make)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Place of each node's best edge: highest saddle, then highest other end."""
    order = np.lexsort((height[b], s, a))
    return order[np.flatnonzero(np.r_[a[order][1:] != a[order][:-1], True])] if len(a) else order


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows by ``keys``, the first key first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _joined(a: np.ndarray, b: np.ndarray, s: np.ndarray, fixed: np.ndarray, height: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, next, saddle) of all nodes of ``own`` that the chunk's edges let join a higher one along their best saddle."""
    n = len(height)
    to, level = np.full(n, -1), np.full(n, -1)
    while True:
        best = _best(a, b, s, height)
        x, y = a[best], b[best]
        dies = own[x] & ~fixed[x] & (height[y] > height[x])
        if not dies.any():
            break
        x, y = x[dies], y[dies]
        to[x], level[x] = y, s[best][dies]
        root = np.where(to >= 0, to, np.arange(n))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b, s = (c[a != b] for c in (a, b, s))
        order = np.lexsort((s, b, a))
        a, b, s = a[order], b[order], s[order]
        last = np.r_[(a[1:] != a[:-1]) | (b[1:] != b[:-1]), True] if len(a) else np.zeros(0, bool)
        a, b, s = a[last], b[last], s[last]
    gone = np.flatnonzero(to >= 0)
    while True:  # what a node joined may have gone itself, at no lower saddle: its heir is meant
        at = to[gone]
        moved = (to[at] >= 0) & (level[at] >= level[gone])
        if not moved.any():
            return gone, to[gone], level[gone]
        to[gone[moved]] = to[at[moved]]


EDGE = ["a", "b", "sr", "sn", "fa", "ra", "fb", "rb"]


def joins(edges: DataFrame) -> DataFrame:
    """``(node, next, sr, sn)``: nodes that join a higher one along their best edge, as far as each chunk leads.

    ``edges``, both ways, are (a, b, saddle sr sn, whether a is fixed, its rate, the same of b), each node's rows together and in order.
    A node is judged where all its edges are; one with more edges than a chunk holds is left to the joined rounds.
    """
    schema = "node long, next long, sr double, sn long"

    def made(t: pa.Table) -> pa.RecordBatch:
        a, b, sr, sn, fa, ra, fb, rb = (t[c].to_numpy() for c in EDGE)
        nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        ca, cb = code[: len(a)], code[len(a) :]
        fixed, rate, own = np.zeros(len(nodes), bool), np.zeros(len(nodes)), np.zeros(len(nodes), bool)
        fixed[cb], rate[cb], fixed[ca], rate[ca], own[ca] = fb, rb, fa, ra, True
        s = _ranks(sr, sn)
        node, onward, level = _joined(ca, cb, s, fixed, _ranks(fixed, rate, -nodes), own)
        key = np.zeros((2, s.max(initial=0) + 1), object)
        key[0, s], key[1, s] = sr, sn
        out = [nodes[node], nodes[onward], key[0, level].astype(float), key[1, level].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["node", "next", "sr", "sn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skipped = [], None
        for b in batches:
            t = pa.Table.from_batches([*held, b])
            if skipped is not None:
                t = t.slice(int(np.searchsorted(t["a"].to_numpy(), skipped, "right")))
            held = t.to_batches()
            if t.num_rows < CHUNK:
                continue
            nodes = t["a"].to_numpy()
            first = int(np.searchsorted(nodes, nodes[-1]))
            if first:
                yield made(t.slice(0, first))
                held = t.slice(first).to_batches()
            else:
                skipped, held = nodes[-1], []
        if held:
            yield made(pa.Table.from_batches(held))

    return edges.mapInArrow(run, schema)
