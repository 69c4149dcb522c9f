"""Vectors as short codes: product quantisation with whole numbers, its codebooks found by Lloyd rounds that use Hamerly's bounds.

Each part of a vector keeps, from round to round, an upper bound of the distance to its entry and a lower bound of that to the
second nearest.  When the entries have moved, the bounds move with them; only where the upper one is no longer strictly
below the lower one are all entries compared, in whole numbers, lower indexes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.llm.vectors import finite
from cumulo.plans.shared import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers that a task compares at once.
CELLS = 1 << 22
#: What doubles may be off by, with room to spare.
EPS = 1e-12
LONGEST = 2**63 - 1

Books = dict[int, np.ndarray]


def _kind(dim: int, *numbers: np.ndarray) -> type:
    """A type in which squared distances of ``dim`` components are exact: doubles, 64-bit integers or, for huge components, Python's."""
    most = max(map(_most, numbers))
    return np.float64 if 4 * dim * most**2 < 2**53 else np.int64 if 4 * dim * most**2 < 2**63 else object


def _points(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column(b.schema.get_field_index("point")).flatten().to_numpy().reshape(-1, dim)


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its distance, the second nearest's distance), compared exactly; equal ones by lower index."""
    kind = _kind(x.shape[1], x, book)
    c, near, first, second = book.astype(kind), [], [], []
    step = max(1, CELLS // book.size)
    for at in range(0, len(x), step):
        d = ((x[at : at + step, None].astype(kind) - c) ** 2).sum(axis=2)
        rows, best = np.arange(len(d)), d.argmin(axis=1)
        near.append(best)
        first.append(np.sqrt(d[rows, best].astype(float)))
        others = d.astype(float)
        others[rows, best] = np.inf
        second.append(np.sqrt(others.min(axis=1)))
    return tuple(map(np.concatenate, (near, first, second))) if near else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to their entries."""
    kind = _kind(x.shape[1], x, entries)
    return ((x.astype(kind) - entries.astype(kind)) ** 2).sum(axis=1)


def moved(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after entries went from ``old`` to ``new``: up by the own entry's way, down by the longest way of another."""
    way = np.sqrt(((new.astype(object) - old.astype(object)) ** 2).sum(axis=1).astype(float))
    most = np.sort(way)[::-1]
    other = np.where(code == way.argmax(), most[1] if len(way) > 1 else 0.0, most[0])
    return upper + way[code] + EPS * (upper + way[code]), lower - other - EPS * (np.where(np.isfinite(lower), lower, 0) + other)


def assigned(rows: DataFrame, books: Books, old: Books | None = None, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``codes`` (a byte a part), ``upper``, ``lower`` (a double a part), ``scans`` and ``error``.

    Without ``old``, every part is compared with all entries.  With it, ``rows`` hold codes and bounds for those codebooks, and ``scans``
    says for how many parts of the vector the bounds didn't hold.  ``error`` is the exact squared distance.
    """
    names = ["codes", "upper", "lower", "scans", "error"]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    kept = [c for c in rows.columns if c not in names]

    def one(b: pa.RecordBatch, dim: int) -> list[pa.Array]:
        x, width, n = _points(b, dim), dim // parts, b.num_rows
        book = books[dim]
        code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
        scans, error = np.zeros(n, np.int32), np.zeros(n, object)
        if old is not None:
            get = lambda name, kind: np.frombuffer(b"".join(b.column(b.schema.get_field_index(name)).to_pylist()), kind).reshape(n, parts)
            code, upper, lower = get("codes", np.uint8).astype(np.int64), get("upper", np.float64).copy(), get("lower", np.float64).copy()
        for p in range(parts):
            own = slice(p * width, (p + 1) * width)
            part, entries = x[:, own], book[:, own]
            open_ = np.arange(n)
            if old is not None:
                upper[:, p], lower[:, p] = moved(code[:, p], upper[:, p], lower[:, p], old[dim][:, own], entries)
                open_ = np.flatnonzero(~(upper[:, p] < lower[:, p]))
                upper[open_, p] = np.sqrt(squared(part[open_], entries[code[open_, p]]).astype(float)) * (1 + EPS)
                open_ = open_[~(upper[open_, p] < lower[open_, p])]
            near, first, second = scanned(part[open_], entries)
            code[open_, p], upper[open_, p], lower[open_, p] = near, first * (1 + EPS), second * (1 - EPS)
            scans[open_] += 1
            error += squared(part, entries[code[:, p]]).astype(object)
        made = [[r.tobytes() for r in a] for a in (code.astype(np.uint8), upper, lower)]
        return [pa.array(v, k) for v, k in zip([*made, scans, [min(int(e), LONGEST) for e in error]], kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(whole.schema.get_field_index("dim"))
            for dim in dims.unique().to_pylist():
                b = whole.filter(pc.equal(dims, dim))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *one(b, dim)], names=[*kept, *names])

    schema = rows.select(*kept).schema
    for name, kind in zip(names, ("binary", "binary", "binary", "integer", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def updated(rows: DataFrame, books: Books, parts: int = PARTS) -> Books:
    """Codebooks with each entry at the floor of its parts' mean; unused ones stay.  Tasks send a sum an entry and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            dims = whole.column(whole.schema.get_field_index("dim"))
            for dim in dims.unique().to_pylist():
                b = whole.filter(pc.equal(dims, dim))
                x, width = _points(b, dim), dim // parts
                code = np.frombuffer(b"".join(b.column(b.schema.get_field_index("codes")).to_pylist()), np.uint8).reshape(-1, parts)
                kind = np.int64 if _most(x) * len(x) < 2**63 else object
                entries = len(books[dim])
                got = sums.setdefault(dim, np.zeros((entries, dim, 2), object))
                for p in range(parts):
                    own = slice(p * width, (p + 1) * width)
                    total = np.zeros((entries, width), kind)
                    np.add.at(total, code[:, p], x[:, own].astype(kind))
                    got[:, own, 0] += total
                    got[:, own, 1] += np.bincount(code[:, p], minlength=entries)[:, None]
        for dim, got in sums.items():
            entry, place = np.indices(got.shape[:2]).reshape(2, -1)
            columns = [np.full(len(entry), dim, np.int32), entry.astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(got[..., 1].ravel().tolist(), pa.int64()), pa.array(got[..., 0].ravel().tolist(), pa.decimal128(38, 0))], names=["dim", "entry", "place", "n", "total"])

    each = rows.select("dim", "point", "codes").mapInArrow(run, "dim int, entry int, place int, n long, total decimal(38,0)")
    out = {dim: book.copy() for dim, book in books.items()}
    for r in each.groupBy("dim", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).where("n > 0").toLocalIterator():
        out[r["dim"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def digest(book: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of the components by part, entry and place, joined by commas."""
    by_part = book.reshape(len(book), parts, -1).transpose(1, 0, 2)
    return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(rows, codebooks): ``(vec_id, label, dim, point, codes, upper, lower, scans, error)``, and each dimension's entries after ``rounds`` updates.

    Null vectors and those with null or non-finite components are left out.  A component is floor(scale * x), at most 64 bits; beyond
    them it stops at the end of their range, as an error does.  Vectors of each dimension have codebooks of their own, whose entries start as the ``entries``
    (256 at most) rows first by id, missing ids last, then by components; fewer rows make fewer entries.  A dimension that
    ``parts`` doesn't divide, and no component at all, has null codes and errors.  The driver holds the codebooks only: ``entries`` vectors a dimension.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    point = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = rows.where(finite("v") | (F.size("v") == 0)).select("vec_id", "label", F.size("v").alias("dim"), point.alias("point"))
    rows = materialize(rows, "points")
    whole = rows.where((F.col("dim") > 0) & (F.col("dim") % parts == 0))
    order = Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id"), "point")
    books: dict[int, list] = {}
    for r in whole.select("dim", "vec_id", "point").withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries).orderBy("dim", "k").collect():
        books.setdefault(r["dim"], []).append(r["point"])
    now = {dim: np.array(b, np.int64) for dim, b in books.items()}
    state = materialize(assigned(whole, now, parts=parts), "codes")
    for _ in range(rounds):
        old, now = now, updated(state, now, parts)
        last, state = state, materialize(assigned(state, now, old, parts), "codes")
        discard(last)
    others = rows.where((F.col("dim") == 0) | (F.col("dim") % parts != 0))
    return state.unionByName(others, allowMissingColumns=True), now


def op11(spark, sf_dir: str) -> DataFrame:
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = sums.select(F.col("label").alias("of"), F.least("sum", F.lit(LONGEST)).cast("long").alias("label_error"))
    digests = spark.createDataFrame([(dim, digest(book)) for dim, book in books.items()], "dim int, codebooks_sha256 string")
    every = rows.join(sums, rows["label"].eqNullSafe(sums["of"]), "left").join(F.broadcast(digests), "dim", "left")
    return every.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")
