import random
import re

import pytest

from millrace.llm.common import table
from millrace.llm.near_dedup import near_duplicates

from .fixtures import documents, no_documents


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + min(width, len(words))]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingles(t, width))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def agree(docs, width, percent):
    want, sizes = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width, percent)
    got = near_duplicates(docs, width, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], r.doc_id == want[r.doc_id])


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_edge_cases(spark, width, percent):
    agree(documents(spark), width, percent)
    assert near_duplicates(no_documents(spark), width, percent).count() == 0


def test_whole_small_table(spark, sf_dir):
    agree(table(spark, sf_dir, "documents"), 3, 85)


def test_chains_and_stars_of_copies(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(220)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[rnd.randrange(len(words))] = f"c{rnd.randrange(10**6)}"
        return words

    star = [changed(base, k % 8) for k in range(120)]
    chain = [changed([f"q{rnd.randrange(10**6)}" for _ in range(150)], 0)]
    for _ in range(40):
        chain.append(changed(chain[-1], 5))
    passage = [f"p{k}" for k in range(80)]
    shared = [[f"u{rnd.randrange(10**6)}" for _ in range(60)] + passage for _ in range(60)]
    texts = [" ".join(w) for w in [*star, *chain, *shared]]
    rnd.shuffle(texts)
    agree(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_large_groups(spark, width, percent):
    """One group of near copies around the threshold, one whose copies are cut short, one passage in texts that differ: all links, no false ones."""
    rnd = random.Random(23)
    vocabulary = [f"v{k}" for k in range(4000)]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            at = rnd.randrange(len(out))
            out[at : at + 1] = rnd.choice([[], draw(1), [out[at], *draw(1)]])
        return out

    base, long_base, passage = draw(150), draw(400), draw(70)
    near = [edited(base, rnd.randint(0, 14)) for _ in range(350)]
    near += [edited(x, rnd.randint(0, 3)) for x in rnd.sample(near, 80)]
    short = [edited(long_base[: rnd.randint(250, 400)], rnd.randint(0, 3)) for _ in range(120)]
    around = [[*draw(rnd.randint(2, 60)), *passage, *draw(rnd.randint(2, 60))] for _ in range(200)]
    texts = [" ".join(x) for x in [*near, *short, *around, *(draw(90) for _ in range(100))]]
    rnd.shuffle(texts)
    agree(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7), width, percent)


def test_rows_that_share_an_id_are_one_document(spark):
    rnd = random.Random(4)
    first, second = (" ".join(f"{c}{rnd.randrange(999)}" for _ in range(40)) for c in "xy")
    rows = [(1, first), (1, second), (1, second), (2, first), (3, second), (4, None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    # the text with the smallest digest stands for document 1
    assert got in ({(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}, {(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True)})


def test_sketches_share_what_is_counted_on():
    from millrace.llm.near_dedup import MISS, _least_table

    table = _least_table(64, 80)
    assert table[0] == 0 and table[1] == 1 and table[10] == 8  # sketches of so few values are the sets: 8 of them at least
    assert (table[1:] >= 1).all() and (table[1:65] <= range(1, 65)).all() and table[-1] <= table[200] and MISS < 1e-6
