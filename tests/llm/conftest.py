import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators themselves make, to clash with.
CLASHES = ("fp", "rep", "component_id", "node", "rank", "h", "terms", "spans", "_h", "_terms", "pii_spans", "secret_spans", "score", "lang_pred", "n_cut", "dups", "bucket", "block", "part", "sequence_id", "offset", "length")


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: nulls, empty and blank ones, copies, near copies, a shared passage, a very long one."""
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(1, 120))) for i in range(60)]
    base = words(rng, 200)
    rows += [(100 + i, base) for i in range(5)]
    for i in range(6):
        w = base.split()
        w[rng.randrange(200)] = "changed"
        rows.append((200 + i, " ".join(w)))
    passage = words(rng, 70)
    rows += [(300 + i, f"{words(rng, 40)} {passage} {words(rng, 40)}") for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One"), (404, "Ünï ÇOMBİ 日本語 👍 é"), (405, words(rng, 9000)), (None, "no id"), (None, "no id"), (59, rows[59][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in texts], NAMES).repartition(5)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
