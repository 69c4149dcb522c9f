"""The pipeline's stages on whole tables: what stays, what goes, and that the columns are those of documents."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from cumulo.llm import language, packing, simhash
from cumulo.plans.shared import materialize
from tests.llm import test_text_operators as plain

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= set(before)
        assert all(r.n_chars == len(r.text) for r in kept[name].values())
        before = kept[name]
    assert len(kept["language_id"]) >= 0.9 * 200
    fps = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (%s)" % ",".join(map(str, kept["language_id"])))).collect()
    assert set(kept["simhash_near_dedup"]) == {r.component_id for r in fps}
    assert "@mail" not in "".join(r.text for r in kept["pii"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == set(kept["pii"]) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run_is_plain_stages(spark):
    """Every stage as loops over all documents, each on what the plain stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoders = language.Encoders(language.dictionaries(docs.where(~language.held_out())))
    best = [(r.doc_id, r.text, *encoders.best(r.text)) for r in docs.collect()]
    rows = [(i, t) for i, t, lang, margin in best if lang != "und" and margin >= 0.005]
    parts = {(i, fp): c for i, fp, c in plain.plain_components([(i, plain.plain_fingerprint(t)) for i, t in rows], 4)}
    rows = [(i, t) for i, t in rows if parts[i, plain.plain_fingerprint(t)] == i]
    cut = dict(plain.plain_cut(rows))
    rows = [(i, cut[i]) for i, t in rows if cut[i] == t or cut[i].strip(" ")]
    _, terms = plain.plain_terms(rows)
    rows = [(i, plain.plain_private(t, known)) for (i, t), known in zip(rows, terms)]
    exact, wanted = Tokenizer.from_file(plain.JSON), []
    for i, t in rows:
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 2], "<u4")
        wanted += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids), 1024))]
    found = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == sorted(wanted) and len({w[0] for w in wanted}) > 100


def test_odd_rows_pass_every_stage(spark, docs, texts, empty):
    for rows in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = materialize(stage(spark, rows, SF), name)
            assert rows.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, SF).count()


def test_texts_are_cut_once(spark):
    """The filter on what is left of a text doesn't cut it a second time: one Python process a task, not two."""
    passage = " ".join(f"word{i}" for i in range(200))
    rows = [(1, passage, "en", "web", len(passage)), (2, passage, "en", "web", len(passage)), (3, "short", "en", "web", 5), (4, None, "en", "web", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert got._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text for r in got.collect()} == {1: passage, 3: "short", 4: None}
