"""Byte-level BPE by automaton: longest matches, stepped back where neighbours could not stand side by side.

A sequence of vocabulary tokens is the merge procedure's result exactly when each
adjacent pair is (no merge across their border would have come first), and only one
such sequence exists.  So the encoder walks left to right, takes the longest match,
and on an incompatible neighbour tries the next shorter prefix or steps back; a bit
per position keeps it from trying a dead end twice, which bounds the work linearly.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 500_000  # of each memo in a Python worker; a full memo is emptied, results don't change


class BytePairs:
    """Tables of one vocabulary: rank -> bytes, the pair that each token is merged from, and the automaton."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.parts = [(r, r) for r in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.longest_prefix = [-1] * self.size
        reachable = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = self._merge(token, below=rank)
                if len(halves) != 2:
                    continue  # the merge procedure never makes it
                self.parts[rank] = halves
                self.merged[halves] = rank
            reachable.append(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.rank_of = {token.decode("latin-1"): ranks[token] for token in reachable}
        self.longest = max(map(len, reachable))
        self.width = [len(x) for x in self.bytes_of]
        known = set(reachable)
        for token in reachable:
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in known:
                    self.longest_prefix[ranks[token]] = ranks[token[:n]]
                    break
        self._fits: dict[int, bool] = {}
        self.words = _Words(self)

    def _merge(self, piece: bytes, below: int) -> tuple[int, ...]:
        """Merges of least rank first, leftmost among equals, using ranks under ``below`` only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((r, i) for i, (a, b) in enumerate(pairwise(parts)) for r in (self.ranks.get(a + b, below),))
            if best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merge procedure leaves these two tokens side by side; memoised."""
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' last merges, again and again; a border merge that came earlier joins them."""
        bound = self.size
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, inner = left, self.parts[left][1]
                if inner == left:  # a single byte: only the right token is left to undo
                    bound, inner = right + 1, self.parts[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                bound, inner = right + 1, self.parts[right][0]
                if inner == right:
                    bound, inner = left, self.parts[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        end, fits, known, size = len(text), self.fits, self._fits.get, self.size
        width, shorter = self.width, self.longest_prefix
        dead = set()  # positions from which the rest can't be reached
        out: list[int] = []
        pos, rank, last = 0, self._longest(text, 0), -1
        while True:
            to = pos + width[rank]
            if to not in dead:
                if last < 0 or (ok := known(last * size + rank)) or ok is None and fits(last, rank):
                    out.append(rank)
                    if to == end:
                        return out
                    pos, last, rank = to, rank, self._longest(text, to)
                    continue
            rank = shorter[rank]
            while rank < 0:
                dead.add(pos)
                rank = out.pop()
                pos -= width[rank]
                last = out[-1] if out else -1
                rank = shorter[rank]

    def _longest(self, text: str, pos: int) -> int:
        """The longest token that begins at ``pos``: the automaton's trie bounds its length, shorter ones follow."""
        tail = text[pos : pos + self.longest]
        n, get = self.automaton.longest_prefix(tail), self.rank_of.get
        while (rank := get(tail[:n])) is None:
            n -= 1
        return rank

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; each match of the pattern by itself."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), np.int32)


class _Words(dict):
    """Memo: pre-token -> its ids as little-endian 32-bit bytes."""

    def __init__(self, model: BytePairs) -> None:
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        ids = array("i", self.model.encode_piece(word.encode())).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(2)
def load(path: str, pattern: str) -> BytePairs:
    """The vocabulary in a file of ``base64 rank`` lines; kept for the worker's later tasks."""
    return BytePairs(_ranks(path), pattern)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def token_bytes(path: str) -> pa.Array:
    """The bytes of each rank, all that decoding needs."""
    ranks = _ranks(path)
    found = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return pa.array(found, pa.large_binary())


def decoded(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Bytes of each list of ids."""
    flat = ids.flatten()
    if pa.types.is_null(flat.type) or not len(flat):
        return pa.array([b""] * len(ids), pa.binary())
    data = tokens.take(flat)
    ends = np.frombuffer(data.buffers()[1], np.int64)[: len(flat) + 1]
    at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends[at])), data.buffers()[2]])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids_col)``: each whole text's token ids, array<int>; null text counts as empty, an empty text has no ids.

    Special tokens' strings are ordinary text.  ``vocabulary`` is a path that every executor can open (installed with the
    tokenizers).  Rows keep their partition; other columns are dropped, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [model.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, ids_col])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, `{ids_col}` array<int>")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``(id_col, ids_col, bytes_col)``: the bytes that each list of ids stands for; a null list counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(vocabulary)
        for b in batches:
            ids = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decoded(known, ids).cast(pa.binary())], names=[id_col, ids_col, bytes_col])

    own = tokens.select(id_col, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(ids_col))
    return own.mapInArrow(run, f"`{id_col}` long, `{ids_col}` array<int>, `{bytes_col}` binary")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    vocabulary = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = decode(encode(docs, vocabulary, tokenizers.PATTERN), vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
