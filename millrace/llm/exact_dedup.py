"""Exact deduplication by Grace hashing: partitions, spill files and open-addressing tables that compare contents."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, written

#: (hash, content, copies, largest doc_id or None)
Record = tuple[int, bytes, int, "int | None"]
_FAN_BITS, _HASH_BITS = 4, 64
_HEAD = struct.Struct("<QIq?q")


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class ContentTable:
    """Open addressing with linear probing; equal hashes count as equal only where the complete contents are."""

    def __init__(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.records: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(slot, record number or -1)"""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := int(self.slots[at])) >= 0:
            if self.records[k][0] == h and self.records[k][1] == content:
                return at, k
            at = (at + 1) & mask
        return at, -1

    def put(self, at: int, record: Record) -> None:
        self.slots[at] = len(self.records)
        self.records.append(list(record))
        self.bytes += len(record[1]) + 100
        if 2 * len(self.records) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            mask = len(self.slots) - 1
            for k, (h, *_) in enumerate(self.records):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            h, size, n, known, keep = _HEAD.unpack(head)
            yield h, f.read(size), n, keep if known else None


def grace(records: Iterable[Record], budget: int, level: int = 0) -> Iterator[Record]:
    """One record per content.  Contents beyond the budget go to spill files by the hash's next bits, which are then done alike."""
    table, files, folder = ContentTable(), {}, None
    try:
        for r in records:
            at, k = table.find(r[0], r[1])
            if k >= 0:
                table.records[k][2] += r[2]
                table.records[k][3] = _larger(table.records[k][3], r[3])
            elif folder is None and (table.bytes < budget or (level + 1) * _FAN_BITS > _HASH_BITS):
                table.put(at, r)
            else:
                folder = folder or tempfile.TemporaryDirectory(prefix="grace-")
                bucket = r[0] >> (_HASH_BITS - (level + 1) * _FAN_BITS) & ((1 << _FAN_BITS) - 1)
                if bucket not in files:
                    files[bucket] = open(os.path.join(folder.name, str(bucket)), "wb")  # noqa: SIM115
                files[bucket].write(_HEAD.pack(r[0], len(r[1]), r[2], r[3] is not None, r[3] or 0) + r[1])
        yield from map(tuple, table.records)
        table = None
        for f in files.values():
            f.close()
        for f in files.values():
            yield from grace(_read(f.name), budget, level + 1)
            os.unlink(f.name)
    finally:
        for f in files.values():
            f.close()
        if folder:
            folder.cleanup()


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += weigh(r)
        if size > 4 << 20 or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def exact_groups(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """text_sha256, group_size and keep_id (largest doc_id) of each text that occurs more than once.

    Every task first merges the copies among its own records, so a hot text crosses the network once per task; the
    partitions of that shuffle are the first level of buckets, and a task recurses over its own spill files below it.
    """
    part = pa.schema([("bucket", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64())])
    group = pa.schema([("text_sha256", pa.string()), ("group_size", pa.int64()), ("keep_id", pa.int64())])

    def merge_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((xxhash.xxh3_64_intdigest(t), t, 1, i) for b in batches for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield from _batches(((h - (1 << 63), t, n, keep) for h, t, n, keep in grace(rows, budget)), part, lambda r: len(r[1]) + 40)

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h + (1 << 63), t, n, keep) for b in batches for h, t, n, keep in zip(*(c.to_pylist() for c in b.columns)))
        yield from _batches(((hashlib.sha256(t).hexdigest(), n, keep) for _, t, n, keep in grace(rows, budget) if n > 1), group, lambda _: 100)

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("content"), F.col("doc_id").cast("long"))
    parts = texts.mapInArrow(merge_local, "bucket long, content binary, n long, keep_id long")
    return parts.repartition("bucket").mapInArrow(merge_all, "text_sha256 string, group_size long, keep_id long")


def exact_dedup(docs: DataFrame, budget: int = 48 << 20) -> DataFrame:
    """All columns of docs, with keep_id, group_size, kept and text_sha256; text is compared unchanged, null as empty.

    Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than all others, and of several rows
    with the largest doc_id exactly one stays.  Columns of docs named like the new ones are replaced.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*new)
    groups = written(exact_groups(docs, budget), "copies")
    total = docs.count()
    rows = docs.withColumn("text_sha256", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    found = lookup(rows, groups, ["text_sha256"], "group_size", total)
    lone = F.col("group_size").isNull()
    found = found.withColumns({"keep_id": F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))})
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # the rows of a hot text that do not stay are spread by their own doc_id
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0))) == 1
    return found.withColumn("kept", best & first).select(*docs.columns, *new)
