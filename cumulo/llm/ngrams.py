"""Language-model scores by deleted interpolation of n-gram estimates.

p(w | v) = a(b) c(v w) / c(v) + l(b) c(w) / N + u(b) / (V + 1), with a + l + u = 1 for each bucket b of context counts c(v).
The weights are learned by expectation-maximisation on counts from texts that were left out of the estimates they
judge (the deleted part); the scores then use the counts of all training texts.

Texts become blocks of about a million tokens, written once.  A block asks for each of its different words and word
pairs a single time, so a word that stands everywhere costs a few bytes a block; requests and answers are sorted arrays, packed in
binary columns and dealt by key range.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.llm.packed import packed, unpacked
from cumulo.plans.shared import materialize, release

BLOCK_TOKENS = 1_000_000
BUCKET_KEYS = 600_000
#: Context counts by powers of two; the last is for contexts never seen in training.
BUCKETS = 42
UNSEEN = BUCKETS - 1
#: Held-out events are summed in cells of an eighth of a power of two of either estimate; at most BUCKETS * 321**2 cells.
LEVELS, DEEPEST = 8, 40
FIT, TUNE, REST = 0, 1, 2


class _Codes(dict):
    """word -> number by first use; 0 is the end of a text."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class _Open:
    """A block that still takes texts."""

    def __init__(self) -> None:
        self.vocabulary, self.codes, self.ids, self.folds, self.sizes = _Codes(), array("I"), [], [], []

    def add(self, key: int | None, text: bytes, fold: int) -> None:
        before = len(self.codes)
        self.codes.extend(map(self.vocabulary.__getitem__, text.lower().split()))
        self.codes.append(0)
        self.ids.append(key)
        self.folds.append(fold)
        self.sizes.append(len(self.codes) - before)

    def row(self, tune: bool) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        words = np.r_[np.uint64(xxhash.xxh64_intdigest(b"\n")), hashes]
        number = int.from_bytes(os.urandom(8), "little") >> 1
        row = [[number], [tune], [len(self.codes)], [self.ids], [packed(np.array(self.folds))], [packed(np.array(self.sizes))], [packed(np.frombuffer(self.codes, np.uint32))], [words.tobytes()]]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=["block", "tune", "n", "ids", "folds", "sizes", "codes", "words"])


def blocks(docs: DataFrame, id_col: str, text_col: str, fold: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(block, tune, n, ids, folds, sizes, codes, words)``: texts as numbers of their block's words, and those words' 64-bit hashes.

    Texts that tune the weights have blocks of their own.
    """
    schema = "block long, tune boolean, n long, ids array<long>, folds binary, sizes binary, codes binary, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {True: _Open(), False: _Open()}
        for b in batches:
            for key, text, part in zip(*(c.to_pylist() for c in b.columns)):
                tune = part == TUNE
                opened[tune].add(key, text or b"", part)
                if len(opened[tune].codes) >= block_tokens:
                    yield opened[tune].row(tune)
                    opened[tune] = _Open()
        for tune, block in opened.items():
            if block.ids:
                yield block.row(tune)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), fold.cast("int").alias("fold"))
    return own.mapInArrow(run, schema)


class Block:
    """A block's tokens, its different word pairs, and the order of their keys."""

    def __init__(self, row: dict) -> None:
        self.ids = row["ids"]
        self.folds, self.sizes, self.codes = (unpacked(row[c]).astype(np.int64) for c in ("folds", "sizes", "codes"))
        words = np.frombuffer(row["words"], np.uint64)
        self.n_words = len(words)
        before = np.r_[0, self.codes[:-1]]  # a text follows an end
        self.pairs, self.pair_of = np.unique(before * self.n_words + self.codes, return_inverse=True)
        self.first, self.second = np.divmod(self.pairs, self.n_words)
        mixed = words[self.first] * np.uint64(0x9E3779B97F4A7C15) + words[self.second]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        # Words have even keys, pairs odd ones.
        keys = np.concatenate([words & ~np.uint64(1), (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, folds: tuple[int, ...]) -> np.ndarray:
        """How often each key stands in texts of these folds, in key order."""
        chosen = np.repeat(np.isin(self.folds, folds), self.sizes)
        words = np.bincount(self.codes[chosen], minlength=self.n_words)
        pairs = np.bincount(self.pair_of[chosen], minlength=len(self.pairs))
        return np.concatenate([words, pairs])[self.order]

    def placed(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers in key order -> counts of words and of pairs."""
        out = np.empty(len(answers), np.int64)
        out[self.order] = answers
        return out[: self.n_words], out[self.n_words :]


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as a flag, the first and 6-byte steps; all 8 bytes where a step is too long."""
    steps = np.diff(keys)
    if len(keys) and steps.max(initial=0) < 2**48:
        return b"\1" + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\0" + keys.tobytes()


def _keys(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    out = steps.reshape(-1).view(np.uint64).copy()
    out[0] = np.frombuffer(data, np.uint64, 1, offset=1)[0]
    return np.cumsum(out, dtype=np.uint64)


def requests(made: DataFrame, n_buckets: int) -> DataFrame:
    """``(bucket, block, tune, keys, train, fit)``: what each block adds to its keys, by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                train, fit = block.counts((FIT, TUNE)), block.counts((FIT,))
                bucket = ((block.keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                cuts = [(k, slice(edges[k], edges[k + 1])) for k in np.flatnonzero(np.diff(edges)).tolist()]
                for at in range(0, len(cuts), 64):
                    out = [(k, row["block"], row["tune"], _deltas(block.keys[s]), packed(train[s]), packed(fit[s])) for k, s in cuts[at : at + 64]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 3])], names=["bucket", "block", "tune", "keys", "train", "fit"])

    return made.mapInArrow(run, "bucket int, block long, tune boolean, keys binary, train binary, fit binary")


def answers(asked: DataFrame) -> DataFrame:
    """``(block, bucket, tune, train, fit)``: the whole corpus' counts of each block's keys, in its order; ``fit`` for tuning blocks only.

    A row with a null block sums a bucket: ``tokens``, ``fit_tokens`` and ``types`` of training words.
    """
    names = ["block", "bucket", "tune", "train", "fit", "tokens", "fit_tokens", "types"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [_keys(r["keys"]) for r in rows]
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        train, fit = (np.bincount(at, np.concatenate([unpacked(r[n]) for r in rows]), len(unique)).astype(np.int64) for n in ("train", "fit"))
        word = unique & np.uint64(1) == 0
        ends = np.cumsum([len(k) for k in keys])
        out = []
        for r, k, e in zip(rows, keys, ends.tolist()):
            own = at[e - len(k) : e]
            out.append((r["block"], r["bucket"], r["tune"], packed(train[own]), packed(fit[own]) if r["tune"] else None, 0, 0, 0))
        out.append((None, rows[0]["bucket"], None, None, None, int(train[word].sum()), int(fit[word].sum()), int((train[word] > 0).sum())))
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 3]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, tune boolean, train binary, fit binary, tokens long, fit_tokens long, types long")


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Number of the bucket of each context count."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), UNSEEN - 1), UNSEEN)


def _answered(block_table: pa.Table, answer_table: pa.Table, name: str) -> tuple[Block, np.ndarray, np.ndarray]:
    block = Block(block_table.to_pylist()[0])
    rows = sorted(answer_table.select(["bucket", name]).to_pylist(), key=lambda r: r["bucket"])
    return block, *block.placed(np.concatenate([unpacked(r[name]).astype(np.int64) for r in rows]))


def events(made: DataFrame, found: DataFrame, fit_tokens: int) -> DataFrame:
    """``(bucket, pair_level, word_level, n, pair_sum, word_sum)`` of the tuning texts' tokens, estimates from the fit texts.

    A level is an eighth of a power of two (-1: the estimate is zero); the sums of the estimates give each cell's mean.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "pair_level", "word_level", "n", "pair_sum", "word_sum"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.float64() if "sum" in n else pa.int64()) for n in names})
        block, words, pairs = _answered(left, right, "fit")
        tune = np.repeat(block.folds == TUNE, block.sizes)
        n = np.bincount(block.pair_of[tune], minlength=len(block.pairs))
        used = np.flatnonzero(n)
        context = words[block.first[used]]
        p2, p1 = pairs[used] / np.maximum(context, 1), words[block.second[used]] / max(fit_tokens, 1)
        level = lambda p: np.where(p > 0, np.clip(-np.log2(np.maximum(p, 2.0**-DEEPEST)) * LEVELS, 0, DEEPEST * LEVELS).astype(np.int64), -1)
        span = DEEPEST * LEVELS + 2
        cell = (bucket_of(context) * span + level(p2) + 1) * span + level(p1) + 1
        cells, at = np.unique(cell, return_inverse=True)
        sums = [np.bincount(at, n[used] * w, len(cells)) for w in (1.0, p2, p1)]
        out = [cells // span // span, cells // span % span - 1, cells % span - 1, sums[0].astype(np.int64), sums[1], sums[2]]
        return pa.table(dict(zip(names, map(pa.array, out))))

    each = made.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "bucket long, pair_level long, word_level long, n long, pair_sum double, word_sum double")
    return each.groupBy("bucket", "pair_level", "word_level").agg(F.sum("n").alias("n"), F.sum("pair_sum").alias("pair_sum"), F.sum("word_sum").alias("word_sum"))


def weights(cells: pd.DataFrame, types: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket, by expectation-maximisation on held-out cells.

    A bucket without events gets the weights of all events together; without any events each estimate counts a third.
    Unseen contexts have no pair estimate; without training words there is the uniform one only.
    """
    if not types:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    p = np.stack([cells["pair_sum"] / cells["n"], cells["word_sum"] / cells["n"], np.full(len(cells), 1 / (types + 1))], axis=1).astype(float)
    n, bucket = cells["n"].to_numpy(float), cells["bucket"].to_numpy(np.int64)

    def learned(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds if len(n) else 0):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        return w

    out = np.tile(learned(p, n), (BUCKETS, 1))
    for b in np.unique(bucket).tolist():
        out[b] = learned(p[bucket == b], n[bucket == b])
    out[UNSEEN] = out[UNSEEN] * [0, 1, 1] if out[UNSEEN][1:].sum() > 0 else [0, 0.5, 0.5]
    out[UNSEEN] /= out[UNSEEN].sum()
    return np.maximum(out, 1e-9) / np.maximum(out, 1e-9).sum(axis=1, keepdims=True)


def scores(made: DataFrame, found: DataFrame, mix: np.ndarray, tokens: int, types: int) -> DataFrame:
    """``(id, fold, n_tokens, n_known, base_score, score)`` of each text, log10."""
    names = ["id", "fold", "n_tokens", "n_known", "base_score", "score"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        block, words, pairs = _answered(left, right, "train")
        context = words[block.first]
        w = mix[bucket_of(context)]
        p = w[:, 0] * pairs / np.maximum(context, 1) + w[:, 1] * words[block.second] / max(tokens, 1) + w[:, 2] / (types + 1)
        starts = np.r_[0, np.cumsum(block.sizes)[:-1]]
        by_text = lambda per_token: np.add.reduceat(per_token, starts)
        base = np.log10((words + 0.5) / (tokens + 0.5 * (types + 1)))
        out = [block.ids, block.folds.astype(np.int32), block.sizes, by_text((words > 0).astype(np.int64)[block.codes]), by_text(base[block.codes]), by_text(np.log10(p)[block.pair_of])]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds)})

    return made.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "id long, fold int, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``(id, fold, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text.

    ``fold`` says what a text is for: 0 its counts are estimates and fit the weights, 1 its counts are estimates and tune the weights,
    2 it is only scored.  A-Z is lower-cased; tokens are runs without the six ASCII white-space characters, then one end,
    which also stands before a text's first token.  base_score is the add-half unigram score.  Null text counts as empty and
    has one token; null and repeated ids are just rows.  Without training texts every score is 0.  Words are known by a
    64-bit hash, of which n different words share one with a chance of about n**2 / 2**64.
    """
    spark = docs.sparkSession
    made = materialize(blocks(docs, id_col, text_col, fold), "blocks")
    size = made.agg(F.sum("n")).first()[0] or 0
    found = materialize(answers(requests(made, max(24, -(-int(size) // bucket_keys)))), "answers")
    release(spark)
    total = found.where("block IS NULL").agg(F.sum("tokens"), F.sum("fit_tokens"), F.sum("types")).first()
    tokens, fit_tokens, types = (int(x or 0) for x in total)
    cells = events(made.where("tune"), found.where("tune").select("block", "bucket", "fit"), fit_tokens).toPandas()
    release(spark)
    mix = weights(cells, types)
    told = found.where("block IS NOT NULL").select("block", "bucket", "train")
    return scores(made, told, mix, tokens, types).withColumn("train_tokens", F.lit(tokens).cast("long"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    fold = F.when(part == 1, REST).when(part == 2, TUNE).otherwise(FIT)
    return score(docs, fold).select(F.col("id").alias("doc_id"), (F.col("fold") == REST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
