"""Literal cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import addresses as A
from millrace.functions import delivery as D
from millrace.operators import journal as J
from millrace.plans.registry import allow_deny


def values(spark, column, rows, schema):
    return [r.v for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + schema).select("k", column.alias("v")).orderBy("k").collect()]


def test_domains(spark):
    # built from the grammar: a dot-atom, one @, labels of letters, digits and inner hyphens; brackets and blanks around are free
    atoms, labels = ["k", "r+7", "o'v", "#_!"], ["n-4", "Dock", "TEST"]
    local, host = ".".join(atoms), ".".join(labels)
    wraps = ["{}", "<{}>", "\t{} ", "Kim R <{}>"]
    broken_locals = ["", f".{local}", f"{local}.", local.replace(".", "..", 1), "k r", "k(r)", "k,r"]
    broken_hosts = ["", f".{host}", host.replace(".", "..", 1), "n 4.test", f"x@{host}", "n_4.test"]
    good = [w.format(f"{local}@{host}") for w in wraps]
    bad = [f"<{x}@{host}>" for x in broken_locals] + [f"<{local}@{x}>" for x in broken_hosts] + [local, "<>", ""]
    quoted = f'<"k, r {atoms[1]}"@{host}>'
    assert values(spark, A.domain(F.col("x")), [(x,) for x in [*good, *bad, quoted]], "x string") == [host.lower()] * len(good) + [None] * (len(bad) + 1)
    assert values(spark, A.quoted_domain(F.col("x")), [(quoted,)], "x string") == [host.lower()]
    assert values(spark, A.routing_domain(F.col("x")), [(f"<{local}@{host}>",), (local,), (f"k@r@{host}",)], "x string") == [host, local, host]
    assert values(spark, A.metric_domain(F.col("x")), [("Dock.TEST..",), ("dock",), ("",)], "x string") == ["dock.test", "dock", ""]


def test_mx_patterns(spark):
    rows = [("MAIL.EXAMPLE.COM.", "mail.example.com"), ("mail.example.com", "*.example.com"), ("example.com", "*.example.com"), ("a.b.example.com", "*.example.com"), ("mail.example.net", "*.example.com")]
    assert values(spark, A.mx_matches(F.col("m"), F.col("p")), rows, "m string, p string") == [True, True, False, False, False]


def test_outcomes_and_times(spark):
    rows = [(True, False, 421), (True, False, None), (False, True, 550), (False, True, 521), (False, True, 555), (False, True, None), (False, False, None)]
    assert values(spark, D.classify(F.col("t"), F.col("p"), F.col("c")), rows, "t boolean, p boolean, c int") == ["defer"] * 4 + ["bounce"] * 2 + ["defer"]
    assert values(spark, D.backoff_s(F.col("a")), [(0,), (1,), (10,), (11,), (24,), (90,)], "a int") == [60, 120, 61_440, 86_400, 86_400, 86_400]
    assert values(spark, D.age_text(F.col("a")), [(45_000,), (192_000,), (3_840_000,), (183_600_000,), (-5,)], "a long") == ["45s", "3m12s", "1h4m", "2d3h", "0s"]
    assert values(spark, D.shard_of(F.col("i"), 7), [(bytes(14) + bytes([3, 2]),)], "i binary") == [(3 + 512) % 7]


def test_header_text(spark):
    head = "From: a\nBcc: x@y\n folded\nbcc: z\nTo: b"
    assert values(spark, A.without_bcc(F.col("h")), [(head,)], "h string") == ["From: a\n folded\nTo: b"]
    signed = values(spark, A.with_signature(F.col("h"), F.lit("DKIM-Signature: new")), [("A: 1\r\nDKIM-Signature: old\r\nB: 2\r\n",)], "h string")
    assert signed == ["A: 1\r\nB: 2\r\nDKIM-Signature: new\r\n\r\n"]
    assert values(spark, A.unstuffed(F.col("b")), [("..leading\r\n.x\r\nplain .dot\r\n",)], "b string") == [".leading\r\nx\r\nplain .dot\r\n"]
    assert values(spark, A.subject_of(F.col("m")), [("To: a\r\nSubject: one\r\n two\r\n\r\nSubject: body",), ("To: a\r\n\r\nSubject: body",)], "m string") == ["one two", None]


def test_policies(spark):
    good = "version: STSv1\nmode: enforce\nmx: *.x.org\nmax_age: 31557600\n"
    rows = [(good,), (good.replace("\n", "\r\n"),), (good.replace("STSv1", "STSv2"),), (good.replace("enforce", "maybe"),), (good.replace("31557600", "31557601"),), (good.replace("mx: *.x.org\n", ""),), ("version: STSv1\nmode: none\nmax_age: 1",)]
    assert values(spark, D.sts_policy_error(F.col("t")), rows, "t string") == [None, None, "version", "mode", "max_age", "mx", None]


@pytest.mark.parametrize(("rules", "want"), [([], ["accept"] * 3), ([("deny", "A.x")], ["reject", "accept", "accept"]), ([("allow", "a.x")], ["accept", "reject", "reject"]), ([("allow", "a.x"), ("deny", "a.x")], ["reject"] * 3)])
def test_rules(spark, rules, want):
    rows = spark.createDataFrame([(0, "a.x"), (1, "b.x"), (2, None)], "k int, domain string")
    got = allow_deny(rows, spark.createDataFrame(rules, "action string, domain string")).orderBy("k").collect()
    assert [r.verdict for r in got] == want


def test_bucket_and_exposition(spark):
    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate([0, 0, 0, 500, 30_000, 30_001, 100_000])], "k string, n int, t long")
    assert J.token_bucket(rows, ["k"], ["n"], "t", 2).first()[1:] == (4, 3, 1)
    samples = spark.createDataFrame([("m_total", {"b": 'x"y', "a": "1"}, 2.0), ("g", {}, 1.5)], "metric string, labels map<string,string>, value double")
    odd = spark.createDataFrame([("m", {"a": 'x\n"\\'}, 1.0)], samples.schema)
    assert [r.line for r in J.exposition(odd).collect()] == ['m{a="x\\n\\"\\\\"} 1.0']
    assert [r.line for r in J.exposition(samples).collect()] == ['m_total{a="1",b="x\\"y"} 2.0', "g 1.5"]


def test_enforcement(spark):
    rows = [(mode, hit) for mode in ("enforce", "testing", "none") for hit in (True, False)]
    assert values(spark, D.enforcement(F.col("m"), F.col("h")), rows, "m string, h boolean") == ["use", "skip", "use", "count", "use", "use"]
