"""From raw documents to packed sequences: each stage works on what the one before kept, and its decisions take effect.

Stages 1 to 4 return the columns of ``documents``; the last returns the packing.  A row without an id is compared by text
with other such rows only; an empty or null text has no language and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulo.llm.chunks import without_repeats
from cumulo.llm.language import dictionaries, held_out, identify
from cumulo.llm.packing import packed_documents
from cumulo.llm.pii import personal_data
from cumulo.llm.simhash import near_duplicates
from cumulo.plans.shared import materialize


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of ``docs``, with the text of another column and its length."""
    new = docs.withColumn("text", F.col(text))
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.length("text").cast("long"))
    return new.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the rest, with narrow margins or no letter, go."""
    known = identify(docs, dictionaries(docs.where(~held_out())))
    return known.where("NOT lang_rejected").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    first = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"])).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing is left go."""
    cut = without_repeats(docs)
    return _with_text(cut.where("n_cut = 0 OR trim(text) <> ''"), docs.columns, "text")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced or removed."""
    return _with_text(personal_data(docs), docs.columns, "pii_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences."""
    return packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, chunking and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
