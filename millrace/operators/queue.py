"""The read-only views of a spool: list, show and stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import delivery as D
from ..sources import spool as S
from . import journal as J


def state(spark: SparkSession, spool: str) -> DataFrame:
    """The fold of each shard's journals over its checkpoint, from the checkpoint's place on; an error where a journal of the chain is missing."""
    jobs = S.checkpoint_jobs(spark, spool)
    marks = jobs.where("state = 'none'").select("shard", "replay_journal", "replay_offset")
    entries = S.state_entries(spark, spool, marks=marks).join(F.broadcast(marks), "shard", "left")
    fresh = entries.where("replay_journal IS NULL OR struct(journal, offset) >= struct(replay_journal, replay_offset)")
    return J.fold(fresh, jobs.where("state <> 'none'"))


def tombstones(spark: SparkSession, spool: str, folded: DataFrame) -> DataFrame:
    """shard, segment, id of every dead copy."""
    dead = folded.select("shard", "id", F.explode("dead").alias("d")).select("shard", F.col("d.segment").alias("segment"), "id")
    return dead.union(S.checkpoint_tombstones(spark, spool).select("shard", "segment", "id")).distinct()


def live_messages(spark: SparkSession, spool: str) -> DataFrame:
    """Ready and deferred messages of the state, and those that only the log from the checkpoint's cursor on has: of several copies, the first in the log."""
    folded = state(spark, spool)
    known = folded.where("state IS NOT NULL")
    heads = S.payload_records(spark, spool).select("shard", F.col("message_id").alias("id"), "segment", "offset", "enqueue_ms")
    cursors = S.checkpoint_jobs(spark, spool).where("state = 'none' AND cursor_segment IS NOT NULL").select("shard", "cursor_segment", "cursor_offset")
    fresh = heads.join(F.broadcast(cursors), "shard", "left").where("cursor_segment IS NULL OR struct(segment, offset) >= struct(cursor_segment, cursor_offset)")
    free = fresh.select(heads.columns).join(tombstones(spark, spool, folded), ["shard", "segment", "id"], "left_anti").join(known.select("shard", "id"), ["shard", "id"], "left_anti")
    found = free.groupBy("shard", "id").agg(F.min(F.struct("segment", "offset", "enqueue_ms")).alias("h"))
    found = found.select("shard", "id", F.lit("ready").alias("state"), F.col("h.segment").alias("segment"), F.col("h.offset").alias("offset"), F.lit(0).cast("long").alias("attempts"), F.col("h.enqueue_ms").alias("enqueue_ms"), F.lit(None).cast("long").alias("next_attempt_ms"))
    placed = known.select("shard", "id", "state", F.col("location.segment").alias("segment"), F.col("location.offset").alias("offset"), "attempts", "next_attempt_ms")
    times = heads.select("shard", "segment", "offset", "enqueue_ms")
    ready = placed.where("state = 'ready'").join(times, ["shard", "segment", "offset"], "left")
    deferred = placed.where("state = 'deferred'").withColumn("enqueue_ms", F.lit(None).cast("long"))
    return ready.unionByName(deferred).unionByName(found)


def queue_list(spark: SparkSession, spool: str, now_ms: int, only: str | None = None) -> DataFrame:
    """Oldest first, unknown ages last."""
    rows = live_messages(spark, spool)
    rows = rows.where(F.col("state") == only) if only else rows
    age = F.when(F.col("enqueue_ms").isNotNull(), D.age_text(F.lit(now_ms) - F.col("enqueue_ms"))).otherwise("-")
    return rows.orderBy(F.col("enqueue_ms").asc_nulls_last(), "id").select(F.hex("id").alias("message_id"), "state", age.alias("age"), "attempts", F.coalesce(D.rfc3339(F.col("next_attempt_ms")), F.lit("-")).alias("next_attempt"), "shard", "segment")


def queue_show(spark: SparkSession, spool: str, message_id: bytes) -> DataFrame:
    """One message of the first shard that has it, with its header."""
    rows = live_messages(spark, spool).where(F.col("id") == F.lit(message_id)).orderBy("shard").limit(1).drop("enqueue_ms")
    heads = S.payload_records(spark, spool).select("shard", "segment", "offset", "enqueue_ms", "generation", "sender", "recipients", "record_len")
    return rows.join(heads, ["shard", "segment", "offset"], "left")


def queue_stats(spark: SparkSession, spool: str) -> DataFrame:
    """Segment rows, shard totals and the grand total; all files count, the active ones too."""
    folded = state(spark, spool)
    dead = J.dead_by_segment(folded)
    rows = S.segments(spark, spool).join(dead, ["shard", "segment"], "left")
    sums = rows.rollup("shard", "segment").agg(F.sum("file_len").alias("total_bytes"), F.coalesce(F.sum("dead_bytes"), F.lit(0)).alias("dead_bytes"), F.coalesce(F.sum("dead_records"), F.lit(0)).alias("tombstones"))
    return sums.withColumn("dead_ratio", D.ratio_text(F.col("dead_bytes"), F.col("total_bytes"))).orderBy(F.col("shard").asc_nulls_last(), F.col("segment").asc_nulls_last())
