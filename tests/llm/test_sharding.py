import zlib
from collections import Counter

from millrace.llm.common import table
from millrace.llm.sharding import shard_by_bytes

from .fixtures import documents, no_documents


def checked(docs, n_shards):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    got = shard_by_bytes(docs, n_shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for s in range(n_shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    return [sum(r["size"] for r in got if r.shard == s) for s in range(n_shards)], max((r["size"] for r in got), default=0)


def test_edge_cases(spark):
    checked(documents(spark), 5)
    checked(no_documents(spark), 5)


def test_near_equal_bytes(spark, sf_dir):
    sizes, largest = checked(table(spark, sf_dir, "documents"), 8)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_a_hot_text_is_split_and_the_rest_stays_together(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 5000)] + [(i, f"text {i - 2000}") for i in range(5000, 5020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, largest = checked(docs, 10)
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 10 + 2 * largest
    shard = {r.doc_id: r.shard for r in shard_by_bytes(docs, 10).collect()}
    assert all(shard[i] == shard[i - 2000] for i in range(5000, 5020))
