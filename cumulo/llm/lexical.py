"""Ranked lexical search, exact: each item's best documents by a whole-number term score, as a threshold-seeded join.

Every term of the items keeps its k-th and its highest impact over all documents.  k documents reach an item's best k-th
impact, so its k-th score is at least that: the seed.  An item's terms stand by falling bound; a document that holds only
terms whose bounds together stay below the seed can't count, so those terms make no candidates.  The others are joined with
the documents' postings, what they give plus the bound of the rest decides who is a candidate, and candidates get their
exact score.  A task raises the seed to the k-th score that it has found itself.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.plans.ranking import ranked
from cumulo.plans.shared import materialize

#: Bytes of item texts that are searched at once: what goes to every task is bounded by it.
ITEM_BYTES = 1 << 20
#: Cells (document, item) that a task sums at once.
CELLS = 1 << 21
#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates terms.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """A text's terms, those of about ``piece`` bytes at a time."""
    clean, at = text.translate(TABLE), 0
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


@dataclass
class Asked:
    """Some items: their ids, how often each holds a term, and the terms' numbers, from 1."""

    ids: list[int | None]
    terms: list[dict[int, int]]
    vocabulary: dict[bytes, int]


def asked(rows: list) -> Asked:
    vocabulary: dict[bytes, int] = {}
    counts = [Counter(vocabulary.setdefault(t, len(vocabulary) + 1) for part in terms_of((r["text"] or "").encode()) for t in part) for r in rows]
    return Asked([r["item_id"] for r in rows], counts, vocabulary)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term: all its terms counted, those of the vocabulary listed."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = told.value.get
        for b in batches:
            ids, ns, ends, terms, tfs = [], [], [0], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                n, found = 0, array("i")
                for part in terms_of(text.as_py() or b""):
                    n += len(part)
                    found.extend(filter(None, map(number, part)))
                if n:
                    term, tf = np.unique(np.frombuffer(found, np.int32), return_counts=True)
                    ids.append(key)
                    ns.append(n)
                    ends.append(ends[-1] + len(term))
                    terms.append(term)
                    tfs.append(tf)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(b: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each posting's document in the batch, term, and impact before its term's weight."""
    lists = b.column(b.schema.get_field_index("terms"))
    sizes = np.asarray(lists.value_lengths(), np.int64)
    tf = b.column(b.schema.get_field_index("tfs")).flatten().to_numpy().astype(np.int64)
    m = np.array([25 + 75 * n * n_docs // n_terms for n in b.column(b.schema.get_field_index("n")).to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, lists.flatten().to_numpy().astype(np.int64), 10**9 * tf // (1000 * tf + 8 * m[doc])


def _first(k: int, by: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each value of ``by``, which come in the order given (first key first)."""
    place = np.lexsort((*order[::-1], by))
    by = by[place]
    start = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)
    return place[np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)])) < k]


def kept_impacts(table: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(term, df, kth, best)``: how many documents hold a term, its k-th impact (0 if fewer do) and its highest, before the weight.

    Tasks count and keep k impacts a term each; a term that stands everywhere costs k rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, term, impact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            _, t, g = impacts(b, n_docs, n_terms)
            held = np.bincount(t, minlength=len(df))
            held[: len(df)] += df
            df, term, impact = held, np.r_[term, t], np.r_[impact, g]
            top = _first(k, term, -impact)
            term, impact = term[top], impact[top]
        stands = np.flatnonzero(df)
        columns = [np.r_[stands, term], np.r_[df[stands], np.zeros(len(term), np.int64)], np.r_[np.zeros(len(stands), np.int64), impact]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "df", "impact"])

    parts = materialize(table.select("n", "terms", "tfs").mapInArrow(run, "term long, df long, impact long"), "impacts")
    best = parts.where("df = 0").withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("rank") <= k)
    tops = best.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("impact"))), F.lit(0)).alias("kth"), F.max("impact").alias("best"))
    return parts.groupBy("term").agg(F.sum("df").alias("df")).join(tops, "term")


@dataclass
class Bounds:
    """Seeds and the terms on either side: for each term, from ``at[0][term]`` to ``at[0][term + 1]``, items and weights that make candidates; ``at[1]`` the rest."""

    seed: np.ndarray
    rest: np.ndarray
    at: tuple[np.ndarray, np.ndarray]
    item: tuple[np.ndarray, np.ndarray]
    weight: tuple[np.ndarray, np.ndarray]


def bounds(items: Asked, stats: dict[int, tuple[int, int, int]], n_docs: int) -> Bounds:
    """``stats`` is term -> (df, kth, best).  Bounds are sums of whole numbers, so pruning by them loses nothing, ties included."""
    seed, rest, sides = [], [], ([], [])
    for i, terms in enumerate(items.terms):
        rows = []
        for t, q in terms.items():
            df, kth, best = stats.get(t, (0, 0, 0))
            if df and (w := q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))):
                rows.append((w * best, t, w, w * kth))
        rows.sort(reverse=True)
        seed.append(max([1, *(r[3] for r in rows)]))
        after, rest_bound = sum(r[0] for r in rows), 0
        for bound, t, w, _ in rows:
            spare = after < seed[-1]
            sides[spare].append((t, i, w))
            rest_bound += bound * spare
            after -= bound
        rest.append(rest_bound)
    made = []
    for side in sides:
        rows = np.array(sorted(side), np.int64).reshape(-1, 3)
        made.append((np.searchsorted(rows[:, 0], np.arange(len(items.vocabulary) + 2)), rows[:, 1], rows[:, 2]))
    return Bounds(np.array(seed, np.int64), np.array(rest, np.int64), *(tuple(m[c] for m in made) for c in range(3)))


def _summed(b: Bounds, side: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """What the postings give to each document and item through the terms of one side."""
    first = b.at[side][term]
    n = b.at[side][term + 1] - first
    at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    out = np.zeros(shape[0] * shape[1], np.int64)
    np.add.at(out, np.repeat(doc, n) * shape[1] + b.item[side][at], np.repeat(impact, n) * b.weight[side][at])
    return out.reshape(shape)


def candidates(table: DataFrame, found: Bounds, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: the exact scores of all documents that may be among an item's first k, at most k an item and task."""
    told, n_items = table.sparkSession.sparkContext.broadcast(found), len(found.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, floor = told.value, told.value.seed.copy()
        kept = np.zeros((4, 0), np.int64)  # item, score, whether the id is missing, id
        for whole in batches:
            for start in range(0, whole.num_rows, max(1, CELLS // max(n_items, 1))):
                part = whole.slice(start, max(1, CELLS // max(n_items, 1)))
                ids = part.column(0)
                doc, term, impact = impacts(part, n_docs, n_terms)
                shape = (part.num_rows, n_items)
                score = _summed(b, 0, doc, term, impact, shape)
                may = (score > 0) & (score + b.rest >= floor)
                some = may.any(axis=1)[doc]
                score += _summed(b, 1, doc[some], term[some], impact[some], shape)
                row, item = np.nonzero(may & (score >= floor))
                missing = ids.is_null().to_numpy(zero_copy_only=False)[row].astype(np.int64)
                new = np.stack([item, score[row, item], missing, ids.fill_null(0).to_numpy()[row]])
                kept = np.concatenate([kept, new], axis=1)
                kept = kept[:, _first(k, kept[0], -kept[1], kept[2], kept[3])]
                full = np.flatnonzero(np.bincount(kept[0], minlength=n_items) >= k)
                ends = np.searchsorted(kept[0], full, "right") - 1
                floor[full] = np.maximum(floor[full], kept[1][ends])
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[3], mask=kept[2] > 0), pa.array(kept[1])], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k best documents with a score above 0, equal scores by rising id, missing ids last.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case; a null text has
    none.  Every row of ``docs`` is a document, repeated rows and rows without an id too.  Equal items are one; items of
    one id and different texts each have their ranks; an item without a term that some document holds has no rows.  Items
    are searched in blocks of ``item_bytes`` of text, each block against all documents.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    given = given.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    dealt = materialize(ranked(given, [F.asc_nulls_last("item_id"), F.col("text")], running="bytes").select("item_id", "text", F.floor((F.col("running") - F.col("bytes")) / item_bytes).alias("block")), "items")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for row in dealt.select("block").distinct().orderBy("block").collect():
        block = asked(dealt.where(F.col("block") == row["block"]).select("item_id", "text").collect())
        table = materialize(postings(texts, block.vocabulary), "postings")
        size = table.agg(F.count("*").alias("n"), F.sum("n").alias("all")).first()
        n_docs, n_terms = size["n"], int(size["all"] or 1)
        stats = {r["term"]: (r["df"], r["kth"], r["best"]) for r in kept_impacts(table, n_docs, n_terms, k).collect()}
        best = candidates(table, bounds(block, stats, n_docs), n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        out.append(materialize(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found"))
    return reduce(DataFrame.union, out)


def op13(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
