"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return score(docs, docs.where(~held_out)).withColumn("held_out", held_out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .langid import identify, learn_fold, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(learn_fold(docs)))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .toxicity import learn_fold, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, learn_fold(table(spark, sf_dir, "labels"))))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_minhash_near_dedup, op4_language_id, op5_byte_bpe, op6_license_scan, op7_toxicity, op8_exact_dedup, op9_best_fit_packing, op10_embedding_near_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
