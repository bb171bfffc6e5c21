"""Small tables with nulls, ties, repeated rows, empty and long texts, and columns that clash with the results'."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, shard string"


def documents(spark, extra=(), n=60, seed=5):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "it's", "x1", "ñandú", "größe", "été", "--", "42"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(n)]
    texts = [*base, *base[:5], base[0], base[0], None, None, "", " \n\t ", "a", "A", " ".join(rnd.choice(words) for _ in range(9000)), "no spaces" * 3000, *extra]
    rows = [(i, t, rnd.choice(["en", "fr", None]), "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "text without id", "en", None, None, None, None, None), (None, base[1], None, None, None, None, None, None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
