"""A spool's files as DataFrames.  Spark reads the bytes, so any store that it reads will do; tasks decode whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import codec

_PLACE = pa.struct([("shard", pa.int32()), ("segment", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("ordinal", pa.int64()), ("generation", pa.int64())])
PLACE = "struct<shard:int,segment:bigint,offset:bigint,length:bigint,ordinal:bigint,generation:bigint>"
SEGMENT_NAME, JOURNAL_NAME = r"segment-(\d{12})\.(log|open)$", r"journal-(\d{12})\.log$"

_RECORD = {"shard": pa.int32(), "segment": pa.int64(), "offset": pa.int64(), "message_id": pa.binary(), "message_ulid": pa.string(), "enqueue_ms": pa.int64(), "generation": pa.int64(), "ordinal": pa.int64(), "sender": pa.string(), "recipients": pa.list_(pa.string()), "record_len": pa.int64(), "header_len": pa.int64(), "payload_crc": pa.int64(), "body": pa.binary()}
RECORD = "shard int, segment long, offset long, message_id binary, message_ulid string, enqueue_ms long, generation long, ordinal long, sender string, recipients array<string>, record_len long, header_len long, payload_crc long, body binary"
_ENTRY = {"shard": pa.int32(), "journal": pa.int64(), "offset": pa.int64(), "kind": pa.int32(), "id": pa.binary(), "location": _PLACE, "attempts": pa.int64(), "next_attempt_ms": pa.int64(), "remaining": pa.list_(pa.string()), "last_error": pa.string(), "timestamp_ms": pa.int64(), "reason": pa.string(), "new_location": _PLACE}
ENTRY = f"shard int, journal long, offset long, kind int, id binary, location {PLACE}, attempts long, next_attempt_ms long, remaining array<string>, last_error string, timestamp_ms long, reason string, new_location {PLACE}"
_JOB = {"shard": pa.int32(), "replay_journal": pa.int64(), "replay_offset": pa.int64(), "cursor_segment": pa.int64(), "cursor_offset": pa.int64(), "state": pa.string(), "id": pa.binary(), "location": _PLACE, "attempts": pa.int64(), "enqueue_ms": pa.int64(), "next_attempt_ms": pa.int64(), "remaining": pa.list_(pa.string()), "last_error": pa.string()}
JOB = f"shard int, replay_journal long, replay_offset long, cursor_segment long, cursor_offset long, state string, id binary, location {PLACE}, attempts long, enqueue_ms long, next_attempt_ms long, remaining array<string>, last_error string"


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _decoded(files: DataFrame, number: str, kinds: dict, schema: str, rows) -> DataFrame:
    """Rows of each file, at most some thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                held = []
                for r in rows(f):
                    held.append(r | {"shard": f["shard"], number: f["number"]})
                    if len(held) == 4096:
                        yield _batch(held, kinds)
                        held = []
                yield _batch(held, kinds)

    return files.mapInArrow(run, schema)


def files(spark: SparkSession, spool: str, pattern: str, name: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """shard, number, kind, length and content of the files named so; names that only look alike are left out."""
    ship(spark)
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    reader = reader.format("binaryFile").option("pathGlobFilter", pattern)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    found = reader.load(f"{spool.rstrip('/')}/shard-*")
    number, shard = F.regexp_extract("path", name, 1), F.regexp_extract("path", r"/shard-(\d{4})/[^/]*$", 1)
    kind = F.when(F.col("path").endswith(".open"), "active").otherwise("sealed")
    return found.where((number != "") & (shard != "")).select(shard.cast("int").alias("shard"), number.cast("long").alias("number"), kind.alias("kind"), "length", "content")


def segments(spark: SparkSession, spool: str) -> DataFrame:
    """shard, segment, kind and file_len; the contents are not read."""
    return files(spark, spool, "segment-*", SEGMENT_NAME).select("shard", F.col("number").alias("segment"), "kind", F.col("length").alias("file_len"))


def payload_records(spark: SparkSession, spool: str, bodies: bool = False, tail: str = "stop", stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """The records of all segments.  A bad record in a sealed segment is an error; the active one ends there, if tail is `stop`.

    As a stream it takes sealed segments only, per_trigger files at a time.
    """
    pattern = "segment-*.log" if stream else "segment-*"
    found = files(spark, spool, pattern, SEGMENT_NAME, stream, per_trigger)
    return _decoded(found, "segment", _RECORD, RECORD, lambda f: (r | {"message_ulid": codec.ulid(r["message_id"])} for r in codec.records(f["content"], tail if f["kind"] == "active" else "fail", bodies)))


def record_at(spark: SparkSession, spool: str, shard: int, segment: int, offset: int) -> DataFrame:
    """The one record at a place, with its body and both checksums checked; no row where there is none.  Only that segment's file is read."""

    def one(f: dict) -> Iterator[dict]:
        found = codec.records(f["content"][offset:], "fail", True) if offset < len(f["content"]) else iter(())
        yield from ({**r, "offset": offset, "message_ulid": codec.ulid(r["message_id"])} for r in [next(found, None)] if r)

    found = files(spark, spool, f"segment-{segment:012d}.*", SEGMENT_NAME).where(F.col("shard") == shard)
    return _decoded(found, "segment", _RECORD, RECORD, one)


def journal_chain(spark: SparkSession, spool: str, marks: DataFrame | None = None) -> DataFrame:
    """shard, first, last, replay_journal and fault of the journals that a state needs: all, or those from its checkpoint's replay_journal on.

    fault is null, or says that an ordinal is missing or that the journal which the checkpoint goes on from is not there.  Only names are read.
    """
    found = files(spark, spool, "journal-*.log", JOURNAL_NAME).select("shard", F.col("number").alias("journal"))
    marks = marks if marks is not None else spark.createDataFrame([], "shard int, replay_journal long")
    found = found.join(F.broadcast(marks.select("shard", "replay_journal")), "shard", "left").where("journal >= coalesce(replay_journal, 0)")
    ends = found.groupBy("shard", "replay_journal").agg(F.min("journal").alias("first"), F.max("journal").alias("last"), F.countDistinct("journal").alias("n"))
    fault = F.expr("""CASE WHEN last - first + 1 <> n THEN concat('journals of shard ', shard, ' have a gap between ', first, ' and ', last)
        WHEN replay_journal > 0 AND first <> replay_journal THEN concat('the checkpoint of shard ', shard, ' goes on from journal ', replay_journal, ' but the oldest is ', first) END""")
    return ends.select("shard", "first", "last", "replay_journal", fault.alias("fault"))


def state_entries(spark: SparkSession, spool: str, tail: str = "stop", marks: DataFrame | None = None) -> DataFrame:
    """The entries of all journals, or of those from marks (shard, replay_journal) on; a torn tail ends the last journal of a shard (`stop`) or is an error (`fail`).

    A torn tail of an earlier journal and a fault of the chain are errors when the rows are read: a lost file must not give another state.
    """
    # a row a shard
    chain = journal_chain(spark, spool, marks).select("shard", "first", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault"))).otherwise(F.col("last")).cast("long").alias("last"))
    found = files(spark, spool, "journal-*.log", JOURNAL_NAME).join(F.broadcast(chain), "shard").where("number >= first")
    return _decoded(found, "journal", _ENTRY, ENTRY, lambda f: codec.entries(f["content"], tail if f["number"] == f["last"] else "fail"))


def checkpoint_jobs(spark: SparkSession, spool: str) -> DataFrame:
    """The ready and deferred jobs of the checkpoints, and one row (state `none`) for each, all with where it replays from and its scan cursor; no rows without checkpoints."""

    def jobs(f: dict) -> Iterator[dict]:
        cp = codec.decode_checkpoint(f["content"])
        segment, offset = cp["cursor"] or (None, None)
        at = {"replay_journal": cp["replay_from"][0], "replay_offset": cp["replay_from"][1], "cursor_segment": segment, "cursor_offset": offset}
        yield at | {"state": "none"}
        for state in ("ready", "deferred"):
            yield from (j | at | {"state": state} for j in cp[state])

    found = files(spark, spool, "checkpoint", r"(checkpoint)$").withColumn("number", F.lit(0).cast("long"))
    return _decoded(found, "number", _JOB, JOB, jobs)


def checkpoint_tombstones(spark: SparkSession, spool: str) -> DataFrame:
    found = files(spark, spool, "checkpoint", r"(checkpoint)$").withColumn("number", F.lit(0).cast("long"))
    kinds = {"shard": pa.int32(), "segment": pa.int64(), "id": pa.binary()}
    return _decoded(found, "number", kinds, "shard int, segment long, id binary", lambda f: ({"segment": s, "id": i} for s, ids in codec.decode_checkpoint(f["content"])["tombstones"] for i in ids))


def legacy_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the older store: a line with a format word and JSON, then the body; or JSON alone.  status is the folder's name."""
    spark_files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{folder.rstrip('/')}/*").where("path NOT LIKE '%.meta.json'")
    text = F.expr("try_validate_utf8(string(content))")
    head = F.regexp_extract("text", r"^[A-Z]+1 (\{[^\n]*\})\n", 1)
    body = F.expr("substring(text, locate('\n', text) + 1)")
    kind = "message_id string, from string, to array<string>, body string, queued_at timestamp"
    rows = spark_files.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("status"), text.alias("text")).withColumn("head", head)
    rows = rows.withColumn("m", F.from_json(F.when(F.col("head") != "", F.col("head")).otherwise(F.col("text")), kind))
    return rows.select("m.message_id", "m.from", "m.to", F.when(F.col("head") != "", body).otherwise(F.col("m.body")).alias("body"), "m.queued_at", "status")


def legacy_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("msg_id string, attempts long, last_attempt timestamp, next_attempt timestamp, last_error string").option("pathGlobFilter", "*.meta.json").json(f"{folder.rstrip('/')}/*")


def delivery_events(spark: SparkSession, path: str) -> DataFrame:
    """The structured log's delivery events: all strings under `fields`, cast here."""
    names = "job_id from_email recipient subject status smtp_response dest_ip queued_at logged_at delay_ms attempt".split()
    rows = spark.read.schema("timestamp string, level string, fields struct<message string, " + ", ".join(f"{n} string" for n in names) + ">").json(path)
    f = rows.where("fields.message = 'email delivery'").select("fields.*")
    return f.select(*names[:7], F.col("queued_at").try_cast("timestamp").alias("queued_at"), F.col("logged_at").try_cast("timestamp").alias("logged_at"), F.col("delay_ms").try_cast("long").alias("delay_ms"), F.col("attempt").try_cast("long").alias("attempt"))
