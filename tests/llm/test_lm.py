import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm.common import crc_mod, table
from millrace.llm.lm import END, Gru, Head, Table, fit, score
from millrace.llm.textvec import word_hashes

from .fixtures import documents, no_documents


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def checked(docs, train):
    counts = Counter()
    for r in train.collect():
        counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), len(tokens(r.text)), sum(counts[t] > 0 for t in tokens(r.text)), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 4)) for r in docs.collect())
    got = score(docs, train).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)
    return got


def test_counts_and_base(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text")
    checked(docs, docs.where(crc_mod(docs.doc_id, 7) != 2))
    checked(docs, docs.limit(0))
    assert score(no_documents(spark), no_documents(spark)).count() == 0
    # with a head of a few words, counts come from the join
    import millrace.llm.lm as lm

    monkeypatch.setattr(lm, "HEAD", 3)
    checked(docs, docs.where(crc_mod(docs.doc_id, 7) != 2))


@pytest.fixture(scope="module")
def scored(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    return docs, {n: checked(docs.repartition(n), docs.where(crc_mod(docs.doc_id, 7) != 2).repartition(n)) for n in (4, 32)}


def test_the_model_beats_the_base_on_held_out_text(scored):
    for rows in scored[1].values():
        held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
        assert len(held) > 100
        gain = sum(r.score - r.base_score for r in held)
        assert gain > -0.03 * sum(r.base_score for r in held)


def test_scores_depend_on_the_rows_alone(scored):
    docs, by = scored
    four, many = ({r.doc_id: r.score for r in by[n]} for n in (4, 32))
    again = {r.doc_id: r.score for r in score(docs, docs.where(crc_mod(docs.doc_id, 7) != 2)).collect()}
    for other in (many, again):
        assert all(abs(other[i] - x) <= 1e-5 * abs(x) for i, x in four.items())


def test_shards_do_not_touch_what_is_sent():
    model = Head(np.array([5, 6, END.astype(np.int64)]), np.array([9, 5, 20]), 34, 3).gru()
    before = {k: v.copy() for k, v in model.p.items()}
    model.copy().run([np.array([0, 1, 2]), np.array([2, 1])], 2, 0.4)
    assert all((model.p[k] == v).all() for k, v in before.items())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = Gru(np.sort(rng.integers(1, 500, 60))[::-1], classes=7, hidden=5)
    for k in model.p:
        model.p[k] = model.p[k] + 0.3 * rng.standard_normal(model.p[k].shape).astype(np.float32)
    h = rng.standard_normal((3, 5)).astype(np.float32)
    for row in h:
        got, _ = model.losses(np.repeat(row[None], 60, axis=0), np.arange(60))
        assert abs(np.exp(got).sum() - 1) < 1e-4


def test_gradients_against_differences(monkeypatch):
    import millrace.llm.lm as lm

    rng = np.random.default_rng(1)
    model = Gru(np.arange(12, 0, -1), classes=3, hidden=4)
    model.p = {k: v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    x = rng.integers(0, 12, (5, 2))
    y = rng.integers(0, 12, (5, 2))

    def forward(grads=None):
        h, kept, hs = np.zeros((2, 4)), [], []
        for t in range(5):
            new, *rest = model.step(h, x[t])
            kept.append((h, np.zeros(2, bool), *rest))
            h = new
            hs.append(h)
        out, dh = model.losses(np.concatenate(hs), y.ravel(), grads)
        if grads is not None:
            model.back(x, kept, dh.reshape(5, 2, 4), grads)
        return out.sum()

    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    forward(grads)
    for k, v in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in v.shape)
            old = v[at]
            v[at] = old + 1e-5
            up = forward()
            v[at] = old - 1e-5
            down = forward()
            v[at] = old
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-3 * max(1, abs(grads[k][at])), k


def test_lanes_and_windows_do_not_matter(monkeypatch):
    import millrace.llm.lm as lm

    rng = random.Random(2)
    head = Head(np.array([5, 6, 7, END.astype(np.int64)]), np.array([9, 5, 3, 20]), 40, 6)
    model = head.gru()
    docs = [head.ids(np.array([rng.choice([5, 6, 7, 99]) for _ in range(rng.randint(0, 150))], np.uint64))[0] for _ in range(30)]
    end = int(head.place[head.end])
    one = model.run(docs, end)
    monkeypatch.setattr(lm, "LANES", 3)
    monkeypatch.setattr(lm, "WINDOW", 7)
    assert np.allclose(one, model.run(docs, end), atol=1e-3)
    assert np.allclose(one, [model.run([d], end)[0] for d in docs], atol=1e-3)


def test_table_of_colliding_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    t = Table(keys, np.arange(len(keys)))
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1 << 63)) == -1).all()
    assert (Table(keys[:0], keys[:0].astype(np.int64)).find(keys) == -1).all()


def test_every_training_document_reaches_the_weights(spark):
    for doc_id in range(5):
        text = f"one two three four{doc_id} one two"
        keys, counts = np.unique(next(iter(word_hashes([text.encode()]))), return_counts=True)
        head = Head(np.append(keys, END).view(np.int64), np.append(counts, 1), int(counts.sum()) + 1, len(keys) + 1)
        model = fit(spark.createDataFrame([(doc_id, text)], "doc_id long, text string"), head)
        assert np.abs(model.p["wc"]).max() > 0
