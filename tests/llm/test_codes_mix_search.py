"""Vector codes, source mixing and lexical search against plain versions, on nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from cumulo.llm import codes, lexical, mixing

from .conftest import words

# --- codes -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label string, point string, codes string, dim string, error string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    near = rng.integers(-3, 4, (9, 32)) / 16
    out = [(i, [float(x) for x in np.float32(near[i % 9] + rng.normal(scale=0.02, size=32))], "ab"[i % 2]) for i in range(300)]
    out += [(400 + i, out[7][1], None) for i in range(40)] + [(7, out[7][1], "a"), (7, out[8][1], "a"), (None, out[9][1], None)]
    out += [(500, [0.25 * (k % 2) for k in range(32)], "c")] * 2
    out += [(600, None, "a"), (601, [], "a"), (602, [float("nan")] * 32, "a"), (603, [None] + [0.0] * 31, "a"), (604, [float("inf")] * 32, "b"), (605, [1.0] * 7, "b")]
    out += [(700 + i, [float(i), -float(i)] * 8, "two") for i in range(5)]
    return out


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{dim: (books, [(vec_id, label, codes, error)])} by comparing all entries each round, in Python's integers."""
    by_dim = {}
    for i, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            by_dim.setdefault(len(v), []).append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = {}
    for dim, own in by_dim.items():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w = dim // parts
        cut = [[tuple(p[k * w : k * w + w]) for k in range(parts)] for _, p, _ in own]
        books = [[c[k] for c in cut[:entries]] for k in range(parts)]
        near = lambda k, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), n) for n, e in enumerate(books[k]))  # noqa: B023, E731
        for _ in range(rounds):
            held = [{} for _ in range(parts)]
            for c in cut:
                for k, v in enumerate(c):
                    held[k].setdefault(near(k, v)[1], []).append(v)
            books = [[tuple(sum(x) // len(x) for x in zip(*held[k][n])) if n in held[k] else e for n, e in enumerate(books[k])] for k in range(parts)]
        found = [[near(k, v) for k, v in enumerate(c)] for c in cut]
        out[dim] = books, [(i, label, bytes(n for _, n in f), sum(d for d, _ in f)) for (i, _, label), f in zip(own, found)]
    return out


@pytest.mark.parametrize("entries", [64, 5, 1])
def test_codes_are_full_scans(spark, rows, entries):
    table = spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], VECTORS).repartition(5)
    found, books = codes.compressed(table, entries=entries)
    got, wanted = found.collect(), plain_codes(rows, entries=entries)
    for dim, (plain, want) in wanted.items():
        mine = [(r.vec_id, r.label, bytes(r.codes), r.error) for r in got if r.dim == dim]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
        flat = ",".join(str(x) for book in plain for e in book for x in e)
        assert codes.digest(books[dim]) == hashlib.sha256(flat.encode()).hexdigest()
    others = [(r.vec_id, r.codes, r.error) for r in got if r.dim not in wanted]
    assert sorted(others) == [(601, None, None), (605, None, None)]


def test_bounds_save_scans_and_hold(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in (i % 64) * 4 + rng.integers(0, 2, 16)], 0) for i in range(2000)]
    found, _ = codes.compressed(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4), rounds=3)
    got = found.collect()
    assert sum(r.scans for r in got) < 0.2 * 16 * len(got)
    assert all(np.frombuffer(r.upper).min() >= 0 and r.error == round(sum(u**2 for u in np.frombuffer(r.upper))) for r in got if r.scans == 16)


def test_codes_of_huge_numbers_and_nothing(spark):
    table = spark.createDataFrame([(i, [s * 10.0**e] * 16, 0) for i, (s, e) in enumerate([(1, 3), (1, 9), (-1, 9), (1, 16), (1, 300), (-1, 300), (1, 9)])], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (bytes(r.codes), r.error) for r in codes.compressed(table, entries=6)[0].collect()}
    assert got[6] == got[1] == (bytes([1] * 16), 0) and got[5] == (bytes([5] * 16), 0)
    none, books = codes.compressed(table.where("false"))
    assert none.count() == 0 and books == {}


# --- mixing ----------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    full = set()
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return {s: most * sizes[s] for s in order}
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


@pytest.fixture(scope="module")
def sources(spark, texts):
    rows = [(i, t, ["s1", "s10", "S2", None, "é", ""][n % 6] if n % 3 else "s1") for n, (i, t) in enumerate(texts)]
    rows += [(900, "", "blank"), (901, None, "blank"), (902, " \n", "blank")]
    df = spark.createDataFrame([(*r, 1, "x", "x", 0.5) for r in rows], "doc_id long, text string, source string, size int, target string, part string, draw double").repartition(4)
    return rows, df


def test_mix_meets_its_targets(spark, sources):
    from pyspark.sql import functions as F

    rows, df = sources
    sized = mixing.sized(df).cache()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in sized.collect()) == Counter((i, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    wanted = plain_targets(sizes)
    got = mixing.mix(sized, mixing.targets(sized), F.lit(1.0)).collect()
    taken = {}
    for r in got:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        # Whole passes come first: at least that often each document, and part of one more for one document at most.
        assert r.taken >= int(r.target // max(r.source_size, 1)) * r.size
    assert taken == {s: pytest.approx(wanted[s], abs=1) for s in sizes} and sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))
    partial = [r.source for r in got if r.size and r.taken % r.size]
    assert len(partial) == len(set(partial))
    again = mixing.mix(mixing.sized(df.repartition(2)), mixing.targets(sized), F.lit(1.0)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(sized.where("false"), mixing.targets(sized.where("false")), F.lit(1.0)).count() == 0


def test_quality_weighs_the_sample(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a b c d", "one") for i in range(3000)] + [(None, "a", "one"), (5000, "x", "one")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, q, None) for i in range(2000) for q in {int(i < 1000), 0}] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.sized(df)
    got = mixing.with_labels(rows, labels)
    assert {r.quality: r["count"] for r in got.groupBy("quality").count().collect()} == {1: 1000, 0: 1000, None: 1002}
    quality = F.when(F.col("quality") == 1, 4.0).when(F.col("quality") == 0, 0.25).otherwise(1.0)
    mixed = mixing.mix(got, mixing.targets(rows, share=0.5), quality).collect()
    share = lambda a, b: sum(r.taken for r in mixed if r.doc_id is not None and a <= r.doc_id < b) / 4000
    # In expectation the earliest half of the keys: 1 - exp(-4x), 1 - exp(-x / 4) and 1 - exp(-x) average a half at x = 0.6.
    assert share(0, 1000) == pytest.approx(0.909, abs=0.03) and share(1000, 2000) == pytest.approx(0.139, abs=0.04) and share(2000, 3000) == pytest.approx(0.451, abs=0.05)
    nothing = mixing.mix(got, mixing.targets(rows, share=0.5), F.lit(None).cast("double")).agg(F.sum("taken")).first()[0]
    assert nothing == 6001


# --- lexical search --------------------------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    known = [(i, Counter(terms(t))) for i, t in docs]
    known = [(i, c) for i, c in known if c]
    n_docs, every = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in known:
            m = 25 + 75 * sum(c.values()) * n_docs // every
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def asked(texts):
    some = [t for _, t in texts[:8]] + [texts[60][1], texts[66][1][:300]]
    return [*enumerate(some), (3, some[1]), (3, some[1]), (50, None), (51, ""), (52, "nowhere-to-be-found"), (None, "日本語 One É"), (53, "a b " * 40 + "ünï one ONE"), (54, "the 9 x9")]


@pytest.mark.parametrize(("k", "item_bytes"), [(10, 1 << 20), (2, 200), (300, 1 << 20)])
def test_search_scores_every_document(spark, docs, texts, asked, k, item_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 60)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id long, text string, rank string, score int").repartition(3)
    found = lexical.search(docs, items, k, item_bytes=item_bytes).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search(texts, asked, k)


def test_seeds_prune_and_ties_stay(spark):
    import random

    rng = random.Random(1)
    common = [(i, f"the of {words(rng, 6)} {'rare' if i % 40 == 0 else ''}") for i in range(800)]
    ties = [(2000 - i, "rare the of") for i in range(30)]
    docs = spark.createDataFrame(common + ties, "doc_id long, text string").repartition(4)
    items = [(1, "the of rare"), (2, "the"), (3, "rare rare of")]
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain_search(common + ties, items)
    block = lexical.asked([{"item_id": i, "text": t} for i, t in items])
    table = lexical.postings(docs.selectExpr("doc_id", "CAST(text AS binary) text"), block.vocabulary).cache()
    n, size = table.count(), table.selectExpr("sum(n)").first()[0]
    stats = {r.term: (r.df, r.kth, r.best) for r in lexical.kept_impacts(table, n, size, 10).collect()}
    bounds = lexical.bounds(block, stats, n)
    made = {(t, i) for t in range(1, 4) for i in bounds.item[0][bounds.at[0][t] : bounds.at[0][t + 1]].tolist()}
    assert made == {(3, 0), (1, 1), (3, 2)}  # of the first and the third item only "rare" makes candidates


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(empty, items).count() == 0 and lexical.search(docs, items.where("false")).count() == 0


def test_terms_of_pieces():
    text = ("Ab-cd ÀÉ x9\x7fy " * 50).encode()
    for piece in (1, 7, 1 << 20):
        assert [t for part in lexical.terms_of(text, piece) for t in part] == [t.encode() for t in ["ab", "cd", "ÀÉ", "x9", "y"]] * 50
