"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN = "und"
#: A text is encoded whole, in segments of this many bytes, so that its dictionary is always within reach of the window.
SEGMENT = 8192


def dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 100, dict_bytes: int = 32_768) -> dict[str, bytes]:
    """Raw dictionary content of each language: at most ``docs_per_lang`` of its different texts in lower case, cut at ``dict_bytes``.

    The sample is the texts of least hash, those of 200 to 20,000 characters first; rows with null text or language teach
    nothing, ids don't matter, copies count once.  Hashes are ranked without their texts, in parts of a language first, so a
    language that has most rows is no task's burden; the driver gets docs_per_lang texts a language, each cut at dict_bytes.
    """
    own = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    usual = F.length(text_col).between(200, 20_000).alias("usual")
    named = [F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h")]
    least = own.select(*named, usual).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):  # a language's least are among those of its parts, of which each is another task's
        order = Window.partitionBy(*by).orderBy(F.desc("usual"), "h")
        least = least.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang).drop("n")
    ranked = least.select("lang", "h")
    texts = own.select(*named, F.substring(text_col, 1, dict_bytes).alias("text")).join(F.broadcast(ranked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    found: dict[str, list[bytes]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        found.setdefault(row["lang"], []).append(row["text"].lower().encode())
    return {lang: content for lang, t in sorted(found.items()) if len(content := b" ".join(t)[:dict_bytes]) >= 8}


class Encoders:
    """A compressor for each language; made in the task that uses them."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.each = []
        for lang, content in contents.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            window = max(len(content) + SEGMENT, 1024).bit_length()
            how = zstandard.ZstdCompressionParameters(window_log=window, hash_log=15, chain_log=16, search_log=4, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            known.precompute_compress(compression_params=how)
            self.each.append((lang, zstandard.ZstdCompressor(dict_data=known, compression_params=how)))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """(encoded size of the whole text in lower case, language), smallest first."""
        data = text.lower().encode()
        parts = [data[k : k + SEGMENT] for k in range(0, len(data), SEGMENT)]
        return sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self.each)

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, margin): how much smaller the best encoding is than the second, as a share of the second."""
        if not text or not self.each or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        return sizes[0][1], 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, contents: dict[str, bytes], text_col: str = "text", min_margin: float = 0.005) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``lang_rejected``.

    Only the text is looked at.  Null text, a text without a letter and an empty set of dictionaries give ``und``, score 0,
    rejected; a margin under ``min_margin`` is rejected too but keeps its best guess.  Equal sizes go to the language that
    sorts first.  All columns and rows stay; columns of the three names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_rejected")]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(contents)
        for b in batches:
            found = [encoders.best(t.as_py()) for t in b.column(at)]
            lang, margin = [x[0] for x in found], [x[1] for x in found]
            rejected = [k == UNKNOWN or m < min_margin for k, m in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "lang_rejected"])

    schema = StructType([*docs.select(*names).schema, *StructType.fromDDL("lang_pred string, score double, lang_rejected boolean")])
    return docs.select(*names).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = dictionaries(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")
