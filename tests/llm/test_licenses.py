import random
import re
from itertools import combinations

from millrace.llm.licenses import TEMPLATES, _longest, align, scan_licenses

from .fixtures import documents, no_documents


def test_edge_cases_and_changed_words(spark):
    apache, gpl = TEMPLATES["Apache-2.0"], TEMPLATES["GPL-3.0"]
    filler = "lorem ipsum dolor sit amet the of and " * 400
    extra = [apache, f"{filler} {apache} {filler}", gpl.replace("work", "thing"), f"{gpl.upper()}\n{apache}", apache.replace("Licensed under the", "by")]
    docs = documents(spark, extra=extra)
    got = {}
    for r in scan_licenses(docs).collect():
        text = next(x.text for x in docs.where(docs.doc_id == r.doc_id).collect())
        got.setdefault(text, set()).add((r.license, round(r.coverage, 2)))
    assert got[extra[0]] == got[extra[1]] == {("Apache-2.0", 1.0)}
    assert got[extra[2]] == {("GPL-3.0", 0.92)}
    assert got[extra[3]] == {("GPL-3.0", 1.0), ("Apache-2.0", 1.0)}
    assert set(got) == set(extra[:4])
    twice = docs.where(docs.text == extra[0])
    assert scan_licenses(twice.union(twice)).count() == 2 * scan_licenses(twice).count() > 0
    assert scan_licenses(no_documents(spark)).count() == 0


def test_alignments_are_increasing_matches():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.randrange(9) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(align(list(range(50)), list(range(50)))) == 50


def test_longest_chain_against_all_chains():
    rnd = random.Random(7)
    for _ in range(100):
        js = rnd.sample(range(20), 8)
        pairs = list(enumerate(js))
        best = max(n for n in range(1, 9) for c in combinations(pairs, n) if all(x[1] < y[1] for x, y in zip(c, c[1:])))
        got = _longest(pairs)
        assert len(got) == best and all(x[1] < y[1] for x, y in zip(got, got[1:]))
    assert _longest([]) == []


def naive(text):
    """Every window of every template over the whole text is aligned."""
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    words, found = lower(text), []
    for name, template in TEMPLATES.items():
        t = lower(template)
        for s in range(0, len(words), len(t) // 2 + 1):
            q = max(1, len(t) // 4)
            for a, b in [(s, s + 2 * len(t)), *((s + k * q, s + k * q + len(t) + q) for k in range(4))]:
                pairs = align(words[a:b], t)
                if 5 * len(pairs) >= 4 * len(t):
                    found.append((2 * len(pairs) - len(t), len(pairs) / len(t), a + pairs[0][0], a + pairs[-1][0], name))
    kept = []
    while found:
        best = min(found, key=lambda x: (-x[0], -x[1], x[3] - x[2], x[4], x[2]))
        kept.append(best)
        found = [x for x in found if x[3] < best[2] or best[3] < x[2]]
    return sorted((x[2], x[3], x[4], round(x[1], 6)) for x in kept)


def test_scans_against_all_windows(spark):
    rnd = random.Random(12)
    filler = [w for t in TEMPLATES.values() for w in t.split()] + [f"w{k}" for k in range(60)]
    names, texts = sorted(TEMPLATES), []
    for _ in range(60):
        out = []
        for _ in range(rnd.randint(0, 4)):
            out += [rnd.choice(filler) for _ in range(rnd.randint(0, 40))]
            out += [w if rnd.random() > 0.08 else rnd.choice(filler) for w in TEMPLATES[rnd.choice(names)].split()]
        texts.append(" ".join(out))
    got = {}
    for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.last_word, r.license, round(r.coverage, 6)))
    assert sum(map(len, got.values())) > 80
    for k, text in enumerate(texts):
        assert sorted(got.get(k, [])) == naive(text)


def test_variants_are_told_apart(spark):
    texts = [TEMPLATES[n] for n in sorted(TEMPLATES)]
    rows = scan_licenses(spark.createDataFrame([(k, f"a b {t} c {t}") for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in rows) == sorted([(k, n, 1.0) for k, n in enumerate(sorted(TEMPLATES))] * 2)
