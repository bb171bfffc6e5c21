import random

from millrace.operators import journal as J


def bucket(history, limit):
    tokens, last, allowed, limited = limit, None, 0, 0
    for _, at in sorted(history):
        last = at if last is None else last
        come = (at - last) * limit // 60_000 if at - last >= 1000 else 0
        tokens, last = min(limit, tokens + come), at if come else last
        allowed, limited, tokens = (allowed + 1, limited, tokens - 1) if tokens > 0 else (allowed, limited + 1, tokens)
    return allowed, limited, tokens


def segments(history, target):
    n, length, largest = 1, 0, 0
    for _, size in sorted(history):
        if length and length + size > target:
            n, length = n + 1, 0
        length += size
        largest = max(largest, length)
    return n, length, largest


def test_histories_stream_over_batches(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), k, rnd.randrange(90_000)) for k in range(600)]
    rnd.shuffle(rows)
    held = {k: [r[1:] for r in rows if r[0] == k] for k in (1, 2, 3, None)}
    df = spark.createDataFrame(rows, "k long, n long, v long").repartition(5)
    clock = df.selectExpr("k", "n", "n * 700 as t")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, packed = J.token_bucket(clock, ["k"], ["n"], "t", 2), J.pack_segments(df, ["k"], "n", "v", 100_000)
        assert {r.k: tuple(r)[1:] for r in got.collect()} == {k: bucket([(n, n * 700) for n, _ in h], 2) for k, h in held.items()}
        assert {r.k: tuple(r)[1:] for r in packed.collect()} == {k: segments(h, 100_000) for k, h in held.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_history_is_gathered_in_a_row(spark):
    df = spark.createDataFrame([], "k long, n long, v long")
    at = "struct<segment:long,offset:long,length:long,generation:long>"
    entries = spark.createDataFrame([], f"shard int, id string, journal long, offset long, kind int, location {at}, attempts int, next_attempt_ms long, remaining array<string>, last_error string, new_location {at}")
    for out in (J.token_bucket(df, ["k"], ["n"], "v", 2), J.pack_segments(df, ["k"], "n", "v", 9), J.fold(entries)):
        assert "collect_list" not in out._jdf.queryExecution().toString()
        assert out.collect() == []


def test_gaps_and_prefixes(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 2), ("b", 3), ("c", 1)], "k string, n int")
    assert [tuple(r) for r in J.gaps(rows, ["k"], "n").collect()] == [("b", 2, 0)]
    assert {tuple(r) for r in J.valid_prefix(rows, ["k"], "n").collect()} == {("a", 3), ("b", 1), ("c", 0)}
