"""Mixing sources to target weights: complete passes over a source first, then a weighted sample of its documents.

The sample is Efraimidis and Spirakis': each document draws an exponential key, divided by its quality weight, and the
smallest keys come first.  Keys are hashes of seed, id and text, so reruns agree.  Documents are dealt by range of source and key; sums of
the parts, a row for each source that a part holds, shift the running sums inside it, so no task holds a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.plans.ranking import ranked
from cumulo.plans.shared import materialize

WEIGHTS = (5, 2, 1)
SEED = 20
#: Quality weights of documents that a label calls good, of those without a label, and of those that one calls bad.
GOOD, UNKNOWN, BAD = 4.0, 1.0, 0.25


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``(doc_id, no_source, source, size, draw)``: words of the whole text, and an even draw from 0 to 1, both ends excluded.

    Equal rows draw the same; that only makes them neighbours in the order.  A missing source is one of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, draws = [], []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py() or b""
                sizes.append(len(text.split()))
                drawn = hashlib.md5(b"%d|%s|%s" % (seed, b"" if key is None else b"%d" % key, text)).hexdigest()
                draws.append((int(drawn[:13], 16) + 0.5) / 2**52)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("no_source"), b.column("source"), pa.array(sizes, pa.int64()), pa.array(draws, pa.float64())], names=["doc_id", "no_source", "source", "size", "draw"])

    source = F.col(source_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, no_source boolean, source string, size long, draw double")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(no_source, source, source_size, target)``: words that each source should give.

    Sources in code point order, the missing one last, weigh ``weights`` again and again and share ``share`` of all words.  A
    target stops at ``most`` times its source's size; the rest shares the excess by weight, until none is above.
    """
    sizes = materialize(rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), "sources")
    place = ranked(sizes, [F.col("no_source"), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    place = materialize(place.select("no_source", "source", "source_size", weight.alias("weight")), "sources")
    level, full = 0.0, -1
    while True:
        stops = F.col("weight") * level >= F.col("source_size") * most if full >= 0 else F.lit(False)
        row = place.agg(F.sum("source_size").alias("all"), F.sum(F.when(stops, F.col("source_size"))).alias("held"), F.sum(F.when(~stops, F.col("weight"))).alias("weight"), F.sum(stops.cast("long")).alias("n")).first()
        if not row["weight"] or row["n"] == full:
            break
        level, full = (share * row["all"] - most * (row["held"] or 0)) / row["weight"], row["n"]
    return place.select("no_source", "source", "source_size", F.least(F.col("weight") * level, F.col("source_size") * most).alias("target"))


def mix(rows: DataFrame, wanted: DataFrame, quality: Column) -> DataFrame:
    """``rows`` (:func:`sized`) with ``source_size``, ``target`` and ``taken``, the words that the mix takes of each document.

    A target of one or two times the source's size takes every document that often.  What is left of it goes to
    documents by rising key -ln(draw) / ``quality`` until it is spent; the last one gives its first words only, so a source gives
    its target rounded down.  A weight that is null or not above 0 puts a document last.
    """
    key = F.when(quality > 0, -F.log("draw") / quality).otherwise(F.lit(float("inf")))
    order = [F.col("key"), F.asc_nulls_last("doc_id"), F.col("size")]
    parts = rows.withColumn("key", F.coalesce(key, F.lit(float("inf")))).select("doc_id", "no_source", "source", "size", "key")
    parts = materialize(parts.repartitionByRange("no_source", "source", *order).withColumn("part", F.spark_partition_id()), "ranged")
    by = ["no_source", "source"]
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("part", *by).agg(F.sum("size").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    shifts = shifts.join(wanted, by).withColumn("passes", passes).withColumn("budget", F.floor(F.col("target") - F.col("passes") * F.col("source_size")))
    inside = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = parts.join(shifts, ["part", *by]).withColumn("sooner", F.col("earlier") + F.sum("size").over(inside) - F.col("size"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("sooner")))
    source = F.when(~F.col("no_source"), F.col("source")).alias("source")
    return running.select("doc_id", source, "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``quality``, the highest label of their id; a row without an id or a label has none."""
    best = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = rows.where("doc_id IS NOT NULL").join(best, "doc_id", "left").select(*rows.columns, "quality")
    return known.union(rows.where("doc_id IS NULL").withColumn("quality", F.lit(None).cast("int")))


def op12(spark, sf_dir: str) -> DataFrame:
    rows = materialize(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    labelled = with_labels(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    quality = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(UNKNOWN)
    return mix(labelled, targets(rows), quality).select("doc_id", "size", "source_size", "target", "taken")
