import math

import numpy as np

from millrace.llm.common import table
from millrace.llm.embedding_dedup import embedding_near_duplicates


def brute(rows, least=0.98):
    def fine(r):
        return r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)

    n, up = len(rows), {}
    links = [0] * n

    def root(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    vectors = [np.array(r.embedding, float) if fine(r) else None for r in rows]
    for i in range(n):
        for j in range(i + 1, n):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or rows[i].label != rows[j].label or len(a) != len(b):
                continue
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i] += 1
                links[j] += 1
                x, y = root(rows[i].vec_id), root(rows[j].vec_id)
                up[max(x, y)] = min(x, y)
    return sorted((str(r.vec_id), k, str(root(r.vec_id))) for r, k in zip(rows, links))


def agree(df, tile):
    got = embedding_near_duplicates(df, tile=tile).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(df.collect())
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        v = rng.normal(size=6)
        for e in (0, 0.05, 0.1, 0.15, 0.2):
            rows.append((len(rows), [float(x) for x in v + e * rng.normal(size=6)], k % 3, "clash"))
    rows += [(200 + i, rows[0][1], 0, "copy") for i in range(20)]
    rows += [(300, None, 0, ""), (301, [], 0, ""), (302, [0.0] * 6, 0, ""), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (304, [float("nan")] * 6, 0, ""), (305, [float("inf"), *[0.0] * 5], 0, ""), (306, rows[0][1], None, ""), (None, rows[0][1], 0, ""), (307, [1.0, 2.0], 0, ""), (308, [2.0, 4.0], 0, ""), (309, [-0.0, 1.0], 0, ""), (310, [0.0, 1.0], 0, ""), (311, [3.0], 0, ""), (312, [1e-300, 0.0], 1, ""), (313, [1e300, 0.0], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    agree(df.where("vec_id IS NULL OR vec_id NOT IN (312, 313)"), 7)
    got = {r.vec_id: r for r in embedding_near_duplicates(df, tile=7).collect()}
    assert got[312].component_id == got[313].component_id == 312
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_whole_small_table(spark, sf_dir):
    agree(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 64)
