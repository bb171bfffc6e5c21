from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, toxicity
from millrace.llm.common import table

from .fixtures import documents, no_documents
from .test_near_dedup import brute


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents").limit(400).union(table(spark, sf_dir, "documents").limit(20))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    kept = stage["language_id"](spark, docs, sf_dir).cache()
    labelled = {(r.doc_id, r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE) for r in langid.identify(docs, langid.train(langid.learn_fold(docs))).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, ok in labelled if ok}
    clean = stage["toxicity"](spark, kept, sf_dir).cache()
    marks = toxicity.score(kept, toxicity.train(kept, toxicity.learn_fold(table(spark, sf_dir, "labels")))).collect()
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in marks if not r.predicted}
    alone = stage["exact_dedup"](spark, clean, sf_dir).cache()
    last = {}
    for r in clean.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert alone.columns == docs.columns and sorted(r.doc_id for r in alone.collect()) == sorted(last.values())
    far = stage["near_dedup"](spark, alone, sf_dir).cache()
    groups, _ = brute([(r.doc_id, r.text) for r in alone.collect()], 5, 80)
    assert far.columns == docs.columns and sorted(r.doc_id for r in far.collect()) == sorted(i for i, g in groups.items() if i == g)
    packed = stage["packing"](spark, far, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in far.collect()}


def test_edge_rows_pass_all_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0
        assert name == "packing" or docs.columns == before.columns


def test_stages_take_any_further_columns(spark):
    names = ["lang_pred", "Score", "predicted", "keep_id", "id", "sha", "sha2", "_id", "_hot", "_salt", "_letter", "c0", "c5"]
    docs = documents(spark)
    docs = docs.withColumns({n: F.lit(k) for k, n in enumerate(names) if n.lower() not in {c.lower() for c in docs.columns}})
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0
        assert name == "packing" or docs.columns == before.columns
        if name == "near_dedup":
            assert docs.select("_hot", "sha2", "c5").distinct().collect() == [(names.index("_hot"), names.index("sha2"), names.index("c5"))]


def test_stages_take_an_empty_table(spark):
    docs = no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() == 0
        assert name == "packing" or docs.columns == before.columns
