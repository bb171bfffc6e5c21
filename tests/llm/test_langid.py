import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.common import crc_mod, table
from millrace.llm.langid import _grams, _grams_by_text, document_frequencies, identify, learn_fold, train

from .fixtures import documents, no_documents


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = identify(docs, train(learn_fold(docs))).where(crc_mod(F.col("doc_id"), 4) == 2).collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    docs = documents(spark, extra=["123 !?", "\0\0", "ab\0c"])
    got = identify(docs, train(learn_fold(docs))).collect()
    assert len(got) == docs.count()
    for r in got:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == letter
        assert letter or r.score == 0
        assert r.kept in ("clash", None)
    assert identify(no_documents(spark), train(no_documents(spark))).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}


def test_slices_give_the_same_grams(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", "a", "ab", *("".join(rng.choice(list("abcé ß"), n)) for n in (3, 50, 400, 1000))]

    def sums():
        out = np.zeros((len(texts), langid.BUCKETS), np.int64)
        for first, found, starts in _grams(texts):
            for k, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(found)))):
                out[first + k] += np.bincount(found[a:b], minlength=langid.BUCKETS)
        by_text = np.zeros_like(out)
        for k, found, _ in _grams_by_text(texts):
            by_text[k] += np.bincount(found, minlength=langid.BUCKETS)
        assert (by_text == out).all()
        return out

    whole = sums()
    assert [int(r.sum()) for r in whole] == [sum(max(0, len(t) - n + 1) for n in (1, 2, 3)) for t in texts]
    for size in (60, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        assert (sums() == whole).all()


def test_document_frequencies_count_all_rows(spark):
    docs = spark.createDataFrame([("aa",), ("ab",), (None,), ("ab",)], "text string")
    n, df = document_frequencies(docs)
    assert n == 4
    # a 3, b 2, aa 1, ab 2
    assert sorted(df[df > 0]) == [1, 2, 2, 3]


def plain_prediction(model, text):
    """The score of a text by the definition, one n-gram after the other in plain Python."""
    def bucket(gram):
        h = len(gram) * 0x27D4EB2F & 0xFFFFFFFF
        for c, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            h ^= ord(c) * m & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return (h ^ h >> 13) % langid.BUCKETS

    low = text.lower().replace("\0", " ")
    grams = [low[k : k + n] for n in (1, 2, 3) for k in range(len(low) - n + 1)]
    logits = [(langid.SCALE * sum(float(model.table[bucket(g), c]) for g in grams) / max(1, len(grams)) + model.bias[c]) / model.temperature for c in range(len(model.languages))]
    top = max(logits)
    p = [math.exp(x - top) for x in logits]
    best = max(range(len(p)), key=lambda c: p[c])
    return (model.languages[best], p[best] / sum(p)) if any(ch.isalpha() for ch in text) else ("und", 0.0)


def test_predictions_against_plain_python(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = train(learn_fold(docs))
    short = docs.where("n_chars < 500 OR n_chars IS NULL").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    rows = identify(short, model).collect()
    assert len(rows) > 150
    for r in rows:
        lang, score = plain_prediction(model, r.text or "")
        assert abs(r.score - score) < 1e-3 and (r.lang_pred == lang or abs(score - 0.5) < 1e-2)
