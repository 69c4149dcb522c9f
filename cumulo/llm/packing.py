"""Best-fit packing of token pieces into sequences, with lower bounds that certify a partition's bin count."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from cumulo.plans.shared import materialize


class ByteVocabulary:
    """Ids of a byte-level BPE ``tokenizers`` file; by the same ranks where its merges are in the order of ids."""

    def __init__(self, path: str, pattern: str) -> None:
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.literal = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ids = [vocab[a + b] for a, b in merges]
        self.ranked = None
        if ids == sorted(ids) and (not ids or min(ids) > 255) and spec.get("normalizer") is None:
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in self.literal}
            self.ranked = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is None or any(t in text for t in self.literal):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranked.encode_to_numpy(text, disallowed_special=())


@lru_cache(2)
def load(path: str, pattern: str) -> ByteVocabulary:
    return ByteVocabulary(path, pattern)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones behind a first that may be shorter."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32)`` of every whole text followed by ``end_id``; null text counts as empty."""
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = load(vocabulary, pattern), np.array([end_id], "<u4")
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate([model.ids(text or ""), end]).astype("<u4", copy=False)
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cuts(len(ids), length))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for these lengths: the best of several dual feasible functions.

    A dual feasible function maps sizes so that whatever fits one bin still sums to at most one; so the mapped total bounds
    the bins.  Used: 0 / size / 1 with cut-offs e and 1 - e, and floor((k+1)x)/k where (k+1)x isn't whole (k to 20).
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    mass, many = np.cumsum(count * size), np.cumsum(count)
    best = -(-int(mass[-1]) // capacity)
    for e in range(1, capacity // 2 + 1):
        large = int(many[capacity] - many[capacity - e])
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        mapped = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # of capacity * k
        best = max(best, -(-int((count * mapped).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's free space; longest first, each into the fullest bin that it fits."""
    bins, offsets, free = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s: some bin has s free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = open_spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
        else:
            space, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i], left = b, capacity - space, space - n
        free[b] = left
        if left:
            by_space[left].append(b)
            open_spaces |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def pack(items: DataFrame, capacity: int = 1024, group_rows: int = 2000, rounds: int = 2, slack: int = 64) -> DataFrame:
    """``items`` with ``sequence_id``, ``offset`` and ``certified``, from a column ``length`` of 1..capacity.

    Rows are numbered and dealt by number to partitions of about ``group_rows``, so equal rows never share one by that; each
    runs best-fit decreasing.  A partition whose bins equal its lower bound is certified.  The others give up the documents of
    bins with more than ``slack`` free; those meet in new partitions and are packed again, kept where that saves a bin,
    ``rounds`` times.  Every row stays, with all its columns; columns of the three names are replaced; an empty table stays empty.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "certified")]
    # The row travels as one struct, so no name of its own can clash with a helper's.
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    placed = "sequence_id long, offset long, certified boolean, loose boolean"
    schema = StructType([*items.select(F.monotonically_increasing_id().alias("number"), whole, F.col("length").cast("long").alias("size")).schema, *StructType.fromDDL(placed)])

    def kernel(round_no: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("number")
            lengths, group = table["size"].to_numpy(), table["part"][0].as_py()
            bins, offsets, free = best_fit_decreasing(lengths, capacity)
            certified = len(free) == bins_needed(lengths, capacity)
            if round_no == 0 or len(free) < pc.count_distinct(table["sequence_id"]).as_py():
                places, loose = [pa.array((round_no << 58) + (group << 24) + bins), pa.array(offsets)], free[bins] > slack
            else:
                places, loose = [table["sequence_id"], table["offset"]], np.ones(len(lengths), bool)
            marks = [pa.array(np.full(len(lengths), certified)), pa.array(loose & (not certified))]
            return pa.Table.from_arrays([*(table[c] for c in ("number", "row", "size")), *places, *marks], names=schema.names)

        return run

    def dealt(df: DataFrame, round_no: int) -> DataFrame:
        parts = max(1, -(-df.count() // group_rows))
        key = F.pmod(F.xxhash64("number", F.lit(round_no)), F.lit(parts))
        return df.withColumn("part", key).groupBy("part").applyInArrow(kernel(round_no), schema)

    numbered = materialize(items.select(F.monotonically_increasing_id().alias("number"), whole, F.col("length").cast("long").alias("size")), "numbered")
    packed = materialize(dealt(numbered, 0), "packed")
    settled = packed.where("NOT loose")
    for r in range(1, rounds + 1):
        again = materialize(dealt(packed.where("loose"), r), "repacked")
        settled = settled.union(again.where("NOT loose") if r < rounds else again)
        packed = again
    return settled.select("row.*", "sequence_id", "offset", "certified")


def op10(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The packing of whole documents with the installed 50k byte-level vocabulary; see :func:`pieces` and :func:`pack`."""
    import public_tokenizers as tokenizers

    return pack(pieces(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN))
