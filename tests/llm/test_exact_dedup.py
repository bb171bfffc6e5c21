import hashlib
from collections import defaultdict

from millrace.llm.exact_dedup import exact_dedup, grace

from .fixtures import documents, no_documents


def test_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    got = exact_dedup(docs, budget=2000).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text or ""]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not r.kept or r.doc_id == best
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(no_documents(spark)).count() == 0


def test_equal_hashes_need_equal_contents_and_buckets_are_split():
    records = [(h, bytes([c]) * 50, 1, i) for i, (h, c) in enumerate([(7, 1), (7, 2), (7, 1), (1 << 63, 3), (1 << 63, 1), (7, 2)] * 200)]
    for budget in (1, 200, 1 << 20):
        got = sorted(grace(records, budget))
        assert [(h, c[0], n) for h, c, n, _ in got] == [(7, 1, 400), (7, 2, 400), (1 << 63, 1, 200), (1 << 63, 3, 200)]
        assert [k for *_, k in got] == [1196, 1199, 1198, 1197]
