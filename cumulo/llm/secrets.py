"""Secrets: pattern spans, and long tokens that a character model calls random rather than an identifier.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, give each token
a log-likelihood ratio.  Counting, smoothing and scoring are DataFrame and SQL functions.
"""

from __future__ import annotations

import json
import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.llm.spans import apart, count, joined, replaced, spans, where_present

KINDS = ("assign", "access", "hex")
ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/_=.-"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_TOKEN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}+"


def base_spans(text: Column) -> Column:
    """The pattern spans of a text without nulls, by start and then kind."""
    low = F.lower(text)
    keyword = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    assigned = F.filter(spans(text, "assign", 0, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    access = F.filter(spans(text, "access", 1, ACCESS), lambda s: F.length(s["value"]) >= 16)
    found = F.concat(
        where_present(assigned, keyword),
        where_present(access, F.contains(text, F.lit("AKIA"))),
        where_present(spans(text, "hex", 2, HEX), text.rlike(HEX)),
    )
    return F.sort_array(found)


def _secret(s: Column) -> Column:
    """The secret itself in a pattern span."""
    return F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])


def drawn(n: int, seed: int) -> list[str]:
    """Labelled random strings as generators of keys write them: hex, base 36, base 62, base64 and URL-safe base64."""
    rng = random.Random(seed)
    sets = ("0123456789abcdef", string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/", string.digits + string.ascii_letters + "-_")
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 64))) for i in range(n)]


def learn(docs: DataFrame, text_col: str = "text", sample_docs: int = 2000, drawn_strings: int = 2000, prior: float = 10.0, seed: int = 11) -> list[float]:
    """Log-likelihood ratio of each character pair, random against identifier; index (size of the alphabet + 1) * previous + next, 0 for the start and for characters outside of it.

    Labelled samples: random are ``drawn_strings`` drawn strings and the secrets found by pattern, identifiers the tokens of six or more
    characters outside of them; both from the ``sample_docs`` texts of least hash, which bounds what is fitted on.  Counts
    are one aggregation of at most 2 * 69**2 rows.  A pair's probability backs off to its second character's own with the
    weight of ``prior`` observations, so that a character which identifiers rarely hold counts after any other.
    """
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    least = own.select("h").distinct().orderBy("h").limit(sample_docs)
    sample = own.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).withColumn("base", base_spans(F.col("text")))
    plain = F.transform(apart(spans(F.col("text"), "token", 0, _TOKEN % 6), F.col("base")), lambda s: F.struct(F.lit(0).alias("random"), s["value"].alias("token")))
    secret = F.transform("base", lambda s: F.struct(F.lit(1).alias("random"), _secret(s).alias("token")))
    tokens = sample.select(F.explode(F.concat(plain, secret)).alias("x")).select("x.random", "x.token")
    made = docs.sparkSession.createDataFrame([(1, t) for t in drawn(drawn_strings, seed)], "random int, token string")
    codes = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all("token", F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c)))
    steps = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.struct(F.get("codes", i - 1).alias("a"), F.get("codes", i).alias("b")))
    counted = tokens.union(made).where("length(token) > 0").select("random", codes.alias("codes")).select("random", F.explode(steps).alias("s")).groupBy("random", "s.a", "s.b").count()
    size = len(ALPHABET) + 1
    table = [[[0] * size for _ in range(size)] for _ in range(2)]
    for r in counted.collect():
        table[r["random"]][r["a"]][r["b"]] += r["count"]

    def model(seen: list[list[int]]) -> list[list[float]]:
        n = sum(map(sum, seen))
        single = [(sum(row[b] for row in seen) + 0.5) / (n + 0.5 * size) for b in range(size)]
        return [[(row[b] + prior * single[b]) / (sum(row) + prior) for b in range(size)] for row in seen]

    plain, made = model(table[0]), model(table[1])
    return [math.log(made[a][b] / plain[a][b]) for a in range(size) for b in range(size)]


def mean_ratio(token: Column, ratios: list[float]) -> Column:
    """The token's log-likelihood ratio for each character, the first included."""
    weights = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    size = len(ALPHABET) + 1
    codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    first = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(codes, first, lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.get(weights, acc["last"] * size + c)).alias("sum")), lambda acc: acc["sum"])
    return total / F.length(token)


def secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", least_chars: int = 20, threshold: float = 1.0) -> DataFrame:
    """``docs`` with ``secret_spans`` (start, rank, end, kind, value; code points, end exclusive) and ``secret_text``.

    Spans are the pattern kinds and ``random``: tokens of at least ``least_chars`` characters, a letter and a digit among them,
    whose mean log-likelihood ratio reaches ``threshold`` and that overlap no pattern span.  Sorted by start, then kind.
    In the text each span becomes [SECRET].  Null text has no spans and stays null.  Every row and column stays; columns of
    the two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("secret_spans", "secret_text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("old"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, long = F.col("text"), _TOKEN % least_chars
    candidate = F.filter(where_present(spans(text, "random", len(KINDS), long), text.rlike(long)), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = rows.withColumn("base", base_spans(text)).withColumn("long", candidate)
    more = F.filter(apart(F.col("long"), F.col("base")), lambda s: mean_ratio(s["value"], ratios) >= threshold)
    rows = rows.withColumn("found", F.when(F.size("long") > 0, F.sort_array(F.concat("base", more))).otherwise(F.col("base")))
    clean = F.when(F.size("found") > 0, replaced(F.col("old"), F.col("found"), lambda s: F.lit("[SECRET]"))).otherwise(F.col("old"))
    return rows.withColumn("clean", clean).select("row.*", F.col("found").alias("secret_spans"), F.col("clean").alias("secret_text"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets(docs, learn(docs)).withColumn("base", F.filter("secret_spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
