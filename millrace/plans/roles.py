"""The driver's tables in the roles of a queue's.  They hold no mail: the operators are the point, not the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as journal entries; kinds: signup append, view deferred, click rate-limited, purchase delivered, error bounced."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "append", "view", "deferred", "click", "limited", "purchase", "delivered", "error", "bounced"))), F.col("event_type"))
    return e.select("event_id", (F.col("user_id") % 4).cast("int").alias("shard"), F.expr("event_id div 100").alias("segment"), F.col("user_id").alias("id"), kind.alias("kind"), millis("ts").alias("ts_ms"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


JOURNAL_SQL = """(SELECT event_id, CAST(user_id % 4 AS INT) AS shard, event_id // 100 AS segment, user_id AS id,
    CASE event_type WHEN 'signup' THEN 'append' WHEN 'view' THEN 'deferred' WHEN 'click' THEN 'limited' WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'bounced' END AS kind,
    epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value * 100) AS BIGINT) AS bytes FROM events)"""
