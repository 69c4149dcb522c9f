"""Substring dedup: content-defined chunks by a gear hash, deduplicated by digest.

Each text is chunked once.  Many documents form a block, written once; a block asks for each of its different
digests a single time, with the first of its documents that holds it, so a chunk that a third of all documents share costs one
entry a block and no task holds its places.  Requests are dealt by range of digest.  What comes back is one bit a digest: whether
the block's own first place is the first of all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cumulo.llm.packed import packed, unpacked
from cumulo.plans.shared import materialize, release

#: A pseudo-random 32-bit number for each byte.
GEAR = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)
#: The hash looks back over this many bytes.
WINDOW = 16
SEGMENT = 1 << 20
BLOCK_CHUNKS = 200_000
BUCKET_KEYS = 400_000


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: h = (h << 2) + GEAR[byte], so it depends on the last 16 bytes; by doubling windows."""
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[w:] += h[:-w] << np.uint32(2 * w)
        h = shifted
    return h


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _chosen(data: np.ndarray, word_in: int, other_bits: int, long_word: int, long_in: int) -> Iterator[list[int]]:
    """Ends that the hash chooses, a segment at a time, so that a very long text takes a segment's memory."""
    last_white = -1
    for s in range(0, len(data), SEGMENT):
        back, e = max(0, s - WINDOW + 1), min(len(data), s + SEGMENT)
        h = gear(data[back:e])[s - back :]
        part = data[s:e]
        white = _white(part)
        starts_char = np.ones(e - s, bool)
        after = data[s + 1 : e + 1]
        starts_char[: len(after)] = (after & 0xC0) != 0x80
        place = np.arange(s, e, dtype=np.int64)
        seen = np.maximum.accumulate(np.where(white, place, last_white))
        last_white = int(seen[-1])
        chosen = (white & (h < np.uint32(2**32 // word_in))) | (starts_char & (h >> np.uint32(32 - other_bits) == 0))
        chosen |= (place - seen > long_word) & starts_char & (h < np.uint32(2**32 // long_in))
        yield (np.flatnonzero(chosen) + s + 1).tolist()


def ends(text: bytes, least: int = 16, most: int = 256, word_in: int = 5, other_bits: int = 10, long_word: int = 32, long_in: int = 21) -> list[int]:
    """Where the chunks of a UTF-8 text end.

    A chunk ends after white space where the hash is in its lowest ``word_in``-th (about every fifth word), elsewhere between
    characters where its top ``other_bits`` are zero, or, over ``long_word`` bytes behind the last white space, where it is in
    its lowest ``long_in``-th (about every 64 bytes of Chinese or Thai); never before ``least`` bytes, and after ``most`` at the
    latest, then at the last white space if there is any.  The same words get the same cuts wherever they stand, 16 bytes
    after their start, or ``long_word`` where there is no white space.
    """
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    out, last = [], 0
    for cuts in (*_chosen(data, word_in, other_bits, long_word, long_in), [len(text)]):
        for c in cuts:
            while c - last > most:
                at = np.flatnonzero(_white(data[last + least : last + most]))
                if not len(at):
                    at = np.flatnonzero((data[last + least + 1 : last + most + 1] & 0xC0) != 0x80)
                last += least + int(at[-1]) + 1
                out.append(last)
            if c - last >= least or c == len(text) and c > last:
                out.append(c)
                last = c
    return out


class _Open:
    """A block that still takes texts."""

    def __init__(self) -> None:
        self.ids, self.ties, self.counts, self.digests, self.sizes, self.chars, self.words = [], [], [], [], [], [], []
        self.chunks = 0

    def add(self, key: int | None, tie: int, text: bytes) -> None:
        stops = ends(text)
        if not stops:
            return
        self.ids.append(key)
        self.ties.append(tie)
        self.counts.append(len(stops))
        self.chunks += len(stops)
        last = 0
        for e in stops:
            self.digests.append(blake2b(text[last:e], digest_size=16).digest())
            last = e
        data, at = np.frombuffer(text, np.uint8), np.array([0, *stops[:-1]])
        gap = np.r_[True, _white(data)]
        self.sizes.append(np.diff([0, *stops]))
        self.chars.append(np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64))
        self.words.append(np.add.reduceat(gap[:-1] & ~gap[1:], at, dtype=np.int64))

    def row(self) -> pa.RecordBatch:
        counts = np.array(self.counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(self.chunks) - np.repeat(np.cumsum(counts) - counts, counts)
        digest = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        rank = _ranks(self.ids, self.ties)[doc]
        order = np.lexsort((at, rank, digest[:, 1], digest[:, 0]))
        sorted_ = digest[order]
        new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)]
        index = np.empty(self.chunks, np.int64)
        index[order] = np.cumsum(new) - 1
        first = order[new]
        own = (rank == rank[first][index]) & (at == at[first][index])
        number = int.from_bytes(os.urandom(8), "little") >> 1
        flat = [packed(x) for x in (counts, *(np.concatenate(x) for x in (self.sizes, self.chars, self.words)), index)]
        row = [[number], [int(new.sum())], [self.ids], [np.array(self.ties, np.int64).tobytes()], *[[x] for x in flat], [np.packbits(own).tobytes()], [sorted_[new].tobytes()], [packed(doc[first])]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 9])], names=BLOCK)


BLOCK = ["block", "keys", "ids", "ties", "counts", "sizes", "chars", "words", "index", "own", "digests", "holders"]


def _ranks(ids: list[int | None], ties: list[int]) -> np.ndarray:
    """Dense ranks of documents by id, null last, then by the hash of the text: equal for rows with the same id and text."""
    places = {k: n for n, k in enumerate(sorted(set(zip(map(_ordered, ids), ties))))}
    return np.array([places[_ordered(i), t] for i, t in zip(ids, ties)])


def _ordered(key: int | None) -> int:
    """An id as an unsigned number in the order of ids, null last."""
    return 2**64 - 1 if key is None else key + 2**63


def blocks(docs: DataFrame, id_col: str, text_col: str, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Blocks of chunked documents: their ids and text hashes, sizes of chunks in bytes, characters and words, different
    digests in order with the document that has each first, and each chunk's number among the digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Open()
        for b in batches:
            for s in range(0, b.num_rows, 500):
                for key, tie, text in zip(*(c.to_pylist() for c in b.slice(s, 500).columns)):
                    block.add(key, tie, text or b"")
                    if block.chunks >= block_chunks:
                        yield block.row()
                        block = _Open()
        if block.chunks:
            yield block.row()

    own = docs.select(F.col(id_col).cast("long").alias("id"), _tie(text_col).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "block long, keys long, ids array<long>, " + ", ".join(f"{n} binary" for n in BLOCK[3:]))


def _tie(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def requests(made: DataFrame, n_buckets: int) -> DataFrame:
    """``(bucket, block, digests, ids, ties)``: a block's different digests by range, and who has each first there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A block at a time: those of a batch together may be many times a block's size.
            for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                digest = np.frombuffer(row["digests"], np.uint64).reshape(-1, 2)
                holder = unpacked(row["holders"]).astype(np.int64)
                ids = np.array(list(map(_ordered, row["ids"])), np.uint64)[holder]
                ties = np.frombuffer(row["ties"], np.int64)[holder]
                bucket = ((digest[:, 0] >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s = slice(edges[k], edges[k + 1])
                    out = [[k], [row["block"]], [digest[s].tobytes()], [packed(ids[s])], [ties[s].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), pa.int64(), *[pa.binary()] * 3])], names=["bucket", "block", "digests", "ids", "ties"])

    return made.select("block", "ids", "ties", "digests", "holders").mapInArrow(run, "bucket int, block long, digests binary, ids binary, ties binary")


def answers(asked: DataFrame) -> DataFrame:
    """``(block, bucket, n, first)``: a bit for each digest of a request, set where no block has it in an earlier document."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "bucket"]).to_pylist()
        digests = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 2) for x in table["digests"]]
        digest = np.concatenate(digests)
        ids = np.concatenate([unpacked(x.as_py()).astype(np.uint64) for x in table["ids"]])
        ties = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["ties"]])
        order = np.lexsort((ties, ids, digest[:, 1], digest[:, 0]))
        new = np.r_[True, (digest[order[1:]] != digest[order[:-1]]).any(axis=1)]
        least = order[new][np.cumsum(new) - 1]
        first = np.empty(len(order), bool)
        first[order] = (ids[order] == ids[least]) & (ties[order] == ties[least])
        parts = np.split(first, np.cumsum([len(d) for d in digests])[:-1])
        out = [[r["block"] for r in rows], [r["bucket"] for r in rows], list(map(len, parts)), [np.packbits(p).tobytes() for p in parts]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.binary()])], names=["block", "bucket", "n", "first"])

    return asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, n long, first binary")


def repeated_runs(made: DataFrame, found: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """``(id, tie, n_cut, spans)``: of each document with any, the runs of repeated chunks that are long enough, in code points."""
    names = ["id", "tie", "n_cut", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
            first = np.concatenate([np.unpackbits(np.frombuffer(r["first"], np.uint8), count=r["n"]) for r in parts]).astype(bool)
            counts, sizes, chars, words, index = (unpacked(row[c]).astype(np.int64) for c in ("counts", "sizes", "chars", "words", "index"))
            own = np.unpackbits(np.frombuffer(row["own"], np.uint8), count=len(index)).astype(bool)
            again = ~(own & first[index])
            doc = np.repeat(np.arange(len(counts)), counts)
            # Runs begin where a repeated chunk follows none, or a document begins.
            begins = again & ~np.r_[False, again[:-1] & (doc[1:] == doc[:-1])]
            stops = again & ~np.r_[again[1:] & (doc[1:] == doc[:-1]), False]
            a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            total = lambda x: np.r_[0, np.cumsum(x)][b] - np.r_[0, np.cumsum(x)][a]
            chosen = (total(words) >= min_words) | (total(sizes) >= min_bytes)
            a, b = a[chosen], b[chosen]
            starts_at = np.r_[0, np.cumsum(chars)]
            before = starts_at[np.r_[0, np.cumsum(counts)[:-1]]]
            ties = np.frombuffer(row["ties"], np.int64)
            edges = np.searchsorted(doc[a], np.arange(len(counts) + 1))
            for d in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[d], edges[d + 1])
                spans = np.stack([starts_at[a[s]] - before[d], starts_at[b[s]] - before[d]], axis=1)
                out.append((row["ids"][d], int(ties[d]), int((b[s] - a[s]).sum()), spans.tolist()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names=names)

    narrow = made.select("block", "ids", "ties", "counts", "sizes", "chars", "words", "index", "own")
    return narrow.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "id long, tie long, n_cut long, spans array<array<int>>")


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without their spans of code points."""

    def cut(t: str | None, found) -> str | None:
        if t is None or found is None:
            return None
        out, place = [], 0
        for a, b in found:
            out.append(t[place:a])
            place = b
        return "".join([*out, t[place:]])

    return pd.Series([cut(t, s) for t, s in zip(text, spans)], dtype=object)


#: Not pushed below with a filter on the new text: each task would cut twice, in two Python processes that stay with the executor.
_without = _cut.asNondeterministic()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, min_bytes: int = 150, bucket_keys: int = BUCKET_KEYS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``, and ``n_cut``, ``cut_spans``.

    Consecutive chunks that all occurred before form a run; a run in which at least ``min_words`` words begin, or of ``min_bytes``
    bytes where words are long or not spaced, is cut, shorter ones stay, so common phrases and single boilerplate lines are left
    alone.  The first place of each chunk, by id (null last), hash of the text and position, keeps it.  n_cut counts cut chunks;
    cut_spans lists start:end of the runs in code points of the old text.  Null and empty texts stay as they are.  Rows with
    equal id and equal text are one document and are cut alike; with equal ids and different texts they are two, and so are rows
    with a null id and different texts.  Every row and column stays; columns of the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_cut", "cut_spans")]
    made = materialize(blocks(docs, id_col, text_col, block_chunks), "chunks")
    keys = made.agg(F.sum("keys")).first()[0] or 0
    found = materialize(answers(requests(made, max(12, -(-int(keys) // bucket_keys)))), "repeats")
    release(docs.sparkSession)
    cuts = repeated_runs(made, found, min_words, min_bytes).withColumn("key", F.coalesce("id", F.lit(0))).withColumn("nameless", F.col("id").isNull())
    key = ["key", "nameless", "tie"]
    cuts = materialize(cuts.dropDuplicates(key).select(*key, "n_cut", "spans"), "cuts")
    release(docs.sparkSession)
    # The row travels as one struct, so no name of its own can clash with a helper's.
    own = F.col(id_col).cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(own, F.lit(0)).alias("key"), own.isNull().alias("nameless"), _tie(text_col).alias("tie"))
    joined = whole.join(cuts, key, "left")
    old = F.col("row").getField(text_col)
    new = F.when(F.col("spans").isNull(), old).otherwise(_without(F.when(F.col("spans").isNotNull(), old), F.col("spans")))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    joined = joined.withColumn("new", new)
    same = [(F.col("new") if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    return joined.select(*same, F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut"), F.coalesce(listed, F.lit("")).alias("cut_spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_cut", "cut_spans", F.coalesce("text", F.lit("")).alias("text"))
