import math
import random
import re

import numpy as np

from millrace.llm.common import table
from millrace.llm.textvec import span_hashes
from millrace.llm.toxicity import INSULTS, PREFIXES, SECOND_PERSON, BoostedTrees, isotonic, learn_fold, score, train

from .fixtures import documents, no_documents

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 200))]
        if toxic:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot,", "MORON", "grubblex", "grubbley!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    held = {r.doc_id for r in marks.collect()} - {r.doc_id for r in learn_fold(marks).collect()}
    got = [r for r in score(docs, train(docs, learn_fold(marks))).collect() if r.doc_id in held]
    assert len(got) > 200
    wrong = [r for r in got if r.predicted != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 0.02 * len(got)


def test_edge_cases(spark):
    docs = documents(spark)
    for labels in ([], [(1, 0, 1)], [(1, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (None, 1, 1), (5, 1, None), (6, 0, 2), (999, 0, 1)]):
        got = score(docs, train(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.kept in ("clash", None) for r in got)
    assert score(no_documents(spark), train(no_documents(spark), spark.createDataFrame([], LABELS))).count() == 0


def test_isotonic_is_the_least_squares_fit():
    x, y = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert y.tolist() == [0, 0.5, 1] and (np.diff(x) > 0).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    margin = BoostedTrees().fit(x, y).margin(rng.random((0, 4)).reshape(0, 4))
    assert margin.shape == (0,)
    assert ((BoostedTrees().fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_isotonic_counts_rows_by_weight():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.array([19.0, 1, 19, 1]))
    assert np.allclose(x, [1, 2.95, 4]) and np.allclose(y, [0, 0.05, 1])


def test_scores_do_not_depend_on_the_sample(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(12000):  # 5 % toxic; of the documents with an insult, 30 %
        toxic = i % 20 == 0
        text = [rnd.choice(words) for _ in range(12)]
        if rnd.random() < (0.8 if toxic else 0.1):
            text.insert(rnd.randrange(12), "idiot")
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame(labels, LABELS)
    insulting = {i for i, text in rows if "idiot" in text}
    means = []
    for sample in (10**6, 2400):
        got = {r.doc_id: r.score for r in score(docs, train(docs, marks, sample)).collect()}
        means.append((np.mean(list(got.values())), np.mean([got[i] for i in insulting])))
    (whole, whole_bad), (drawn, drawn_bad) = means
    assert abs(whole - 0.05) < 0.015 and abs(drawn - whole) < 0.03
    assert abs(whole_bad - 0.3) < 0.08 and abs(drawn_bad - whole_bad) < 0.15


def plain_features(lexicon, text):
    """The features of a text by their definitions, one word after the other in plain Python."""
    signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
    lower = lambda t: "".join(c.lower() if c < "\x7f" else c for c in t)
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(" " if c in signs else c for c in lower(text)))
    leet = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
    hidden_words = re.findall(r"[^\x20\x09-\x0D]+", "".join(leet.get(c, "" if c in signs else c) for c in lower(text)))
    odds_of = dict(zip(lexicon.keys.tolist(), lexicon.odds.tolist()))
    key = lambda w: int(span_hashes(w.encode(), ())[0][0])
    found, whole, fixed, you = [], 0, [], []
    for k, w in enumerate(words):
        best = key(w) if key(w) in odds_of else None
        whole += best is not None
        for first in span_hashes(w.encode(), PREFIXES)[1]:
            f = int(first[0])
            if f in odds_of and (best is None or odds_of[f] > odds_of[best]):
                best = f
        found += [(k, best)] if best is not None else []
        fixed += [k] if w in INSULTS else []
        you += [k] if w in SECOND_PERSON else []
    odds = [odds_of[b] for _, b in found]
    places = {k for k, _ in found} | set(fixed)
    near = sum(any(abs(k - y) <= 5 for y in you) for k in places)
    seen = sum(w in INSULTS for w in hidden_words) + sum(key(w) in odds_of for w in hidden_words)
    hidden = max(0, seen - len(fixed) - whole)
    raw, d = text.encode(), max(1, len(words))
    upper, low = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    size = max(1, len(raw))
    marks, digits, high = sum(chr(c) in signs for c in raw), sum(48 <= c <= 57 for c in raw), sum(c >= 128 for c in raw)
    return [
        math.log1p(len(words)), len(found), len(found) / d, sum(odds), sum(odds) / d, max(odds, default=0), sum(o > 3 for o in odds), len({b for _, b in found}), len(fixed), len(fixed) / d,
        len(you) / d, near, near / d, upper / max(1, upper + low), marks / size, raw.count(b"!") / size, digits / size, hidden, hidden / d, high / size,
    ]


def plain_score(model, x):
    margin = model.trees.base
    for feature, value, leaves in model.trees.trees:
        node = 0
        for _ in range(model.trees.depth):
            node = 2 * node + 1 + (x[feature[node]] > value[node])
        margin += leaves[node - len(feature)]
    xs, ys = model.knots
    k = sum(a <= margin for a in xs)
    step = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (margin - xs[k - 1]) / (xs[k] - xs[k - 1])
    return min(1, max(0, 0.999 * step + 0.001 / (1 + math.exp(-margin))))


def test_scores_against_plain_python(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    model = train(docs, learn_fold(table(spark, "/root/testdata/sf0.01", "labels")))
    odd = ["", "YOU are a m0r0n!! idiot?", "st_upid l0ser " * 40, "ñ é ü 123", "w" * 5000, "you " + "x " * 5 + "idiot", "you " + "x " * 6 + "idiot"]
    rows = [(r.doc_id, r.text or "") for r in docs.where("length(text) < 900").collect()] + [(10**6 + k, t) for k, t in enumerate(odd)]
    for size in (1 << 20, 50):  # in slices too: distances run over their edges
        monkeypatch.setattr("millrace.llm.toxicity.SLICE_BYTES", size)
        some = rows if size > 50 else rows[-60:]
        for _, t in some:
            assert np.allclose(model.lexicon.features(t), plain_features(model.lexicon, t), atol=1e-9), t[:80]
    got = {r.doc_id: (r.score, r.predicted) for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) > 100
    for i, t in rows:
        want = plain_score(model, plain_features(model.lexicon, t))
        assert abs(got[i][0] - want) < 1e-6 and (got[i][1] == (want >= 0.7) or abs(want - 0.7) < 1e-6)
