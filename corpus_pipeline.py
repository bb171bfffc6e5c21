"""A training corpus in five stages: language, toxicity, exact copies, near copies, packed sequences.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, langid, near_dedup, packing, toxicity
from millrace.llm.common import table, written
from millrace.llm.queries import _tokenizer

#: A document goes when the language predicted is likelier wrong than right, by the calibrated probability, or when it has no letter.
LEAST_LANGUAGE = 0.5
TOXIC = 0.7
#: Most ids, of documents that go, that are broadcast; beyond it texts are shuffled.
SENT = 1 << 21


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names of its own for all columns but doc_id and text, so that none clashes with those of a result."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)))


def _named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, named so again."""
    return kept.select(*_plain(docs).columns).toDF(*docs.columns)


def _few(ids: DataFrame) -> DataFrame:
    """ids, written, and broadcast if there are few."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= SENT else ids


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages of the learned rows; null texts and those without a letter go, and so does all without learned rows."""
    model = langid.train(langid.learn_fold(docs))
    return _named(langid.identify(_plain(docs), model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)), docs)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are scored as toxic by their texts; the model is learned from the labels of what is left of documents (without both labels all stay)."""
    model = toxicity.train(docs, toxicity.learn_fold(table(spark, sf_dir, "labels")))
    return _named(toxicity.score(_plain(docs), model, TOXIC).where("predicted = 0"), docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id stays; of repeated rows, one.  A null doc_id is smaller than all others."""
    found = written(exact_dedup.exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "kept", "text_sha256"), "exact")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha2"), F.expr("doc_id <=> keep_id").alias("again"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    same = F.expr("doc_id <=> id AND sha = sha2")
    kept = _plain(docs).withColumn("sha", sha).join(_few(gone.where("NOT again").select("id", "sha2").distinct()), same, "left_anti")
    again = written(gone.where("again").select("id", "sha2").distinct(), "again")
    if not again.isEmpty():
        alone = kept.join(again, same, "left_anti")
        kept = alone.unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "sha"]))
    return _named(kept, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.  Empty texts and null doc_ids stay."""
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece of each row of docs; a null text is one of the end alone, and an empty table gives none."""
    return packing.pack(packing.token_pieces(docs, _tokenizer("byte_bpe_50k.tiktoken")))


STAGES = [("language_id", language_id), ("toxicity", toxic_filter), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packed)]

#: Models and a branch and bound: not for SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
