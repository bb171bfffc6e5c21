"""The fold of a state journal into current messages and dead bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Kinds of journal entries.
DEFERRED, DELIVERED, BOUNCED, RELOCATED = 1, 2, 3, 4

LOCATION = "struct<segment:bigint,offset:bigint,length:bigint,generation:bigint>"
_STATE = f"state string, location {LOCATION}, attempts bigint, next_attempt_ms bigint, remaining array<string>, last_error string, dead array<{LOCATION}>"


def fold(entries: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The state of every (shard, id) after its entries in LSN order, and the copies that died on the way.

    entries: shard, id, journal, offset, kind, location, attempts, next_attempt_ms, remaining, last_error, new_location.
    initial (a checkpoint): shard, id, state, location, attempts, next_attempt_ms, remaining, last_error.
    Returns shard, id, state (deferred, ready or null), location, attempts, next_attempt_ms, remaining, last_error, dead.

    A deferral revives an ended message.  An end kills the copy.  A relocation moves a live message to a newer generation and
    kills the old copy, kills the new copy if it is not newer, kills both if either segment knows the message as ended, and else
    only the old one.  The entries of one id stream through one task in their order; what is held is its state and its dead copies.
    """
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(c)[f].cast("bigint").alias(f) for f in ("segment", "offset", "length", "generation")))).cast(LOCATION).alias(c)
    number = [F.col(c).cast("bigint").alias(c) for c in ("attempts", "next_attempt_ms")]
    rest = [F.col("remaining").cast("array<string>").alias("remaining"), F.col("last_error").cast("string").alias("last_error")]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = entries.select("shard", "id", F.lit(1).alias("_new"), "journal", "offset", "kind", place("location"), *number, *rest, place("new_location"), none("state", "string"))
    if initial is not None:
        kinds = {c: entries.schema[c].dataType for c in ("journal", "offset", "kind")}
        start = initial.select("shard", "id", F.lit(0).alias("_new"), *(none(c, t) for c, t in kinds.items()), place("location"), *number, *rest, none("new_location", LOCATION), F.col("state").cast("string").alias("state"))
        rows = rows.unionByName(start)

    def tomb(s: list, at: dict | None) -> bool:
        return bool(at) and at["segment"] is not None and any(d and d["segment"] == at["segment"] for d in s[6])

    def newer(at: dict | None, old: dict | None) -> bool:
        return bool(at and old) and None not in (at["generation"], old["generation"]) and at["generation"] > old["generation"]

    def step(s: list, e: list) -> None:
        kind, location, attempts, due, remaining, error, moved, state = e
        if kind == DEFERRED:
            s[:6] = "deferred", location, attempts, due, remaining, error
        elif kind in (DELIVERED, BOUNCED):
            s[:6] = [None] * 6
            s[6].append(location)
        elif kind == RELOCATED and s[0] is not None:
            if newer(moved, s[1]):
                s[1] = moved
                s[6].append(location)
            else:
                s[6].append(moved)
        elif kind == RELOCATED:
            s[1] = None
            s[6] += [location, moved] if tomb(s, location) or tomb(s, moved) else [location]
        elif state is not None:  # from the checkpoint: before all entries
            s[:6] = state, location, attempts, due, remaining, error

    return _replayed(rows, ["shard", "id"], 3, _STATE, lambda: [None] * 6 + [[]], step)


def dead_by_segment(folded: DataFrame) -> DataFrame:
    """shard, segment, dead_records, dead_bytes: a message counts once in a segment, its first copy there."""
    copies = folded.select("shard", "id", F.posexplode("dead").alias("at", "copy"))
    first = copies.groupBy("shard", F.col("copy.segment").alias("segment"), "id").agg(F.min_by("copy", "at").alias("copy"))
    return first.groupBy("shard", "segment").agg(F.count("*").alias("dead_records"), F.sum("copy.length").alias("dead_bytes"))


def first_copies(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose number does not follow the one before it."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(number))
    return rows.select(*keys, F.col(number).alias("number"), before.alias("before")).where("number - before <> 1")


def valid_prefix(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """How many rows of each key carry 0, 1, 2, … without a break."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number)) - 1
    return rows.withColumn("_place", place).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(number) != F.col("_place"), F.col("_place"))), F.count("*")).cast("long").alias("valid"))


def last_state(rows: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The columns of the last row of each key; only one row a key and task is shuffled."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("s")).select(*keys, "s.*")


def saturating_depth(rows: DataFrame, keys: list[str], order: str, delta: str) -> DataFrame:
    """The end of a gauge that never falls below zero.

    As min-plus prefix sums: the final depth is the total less the smallest running sum, where that is negative.  It is a window
    and two aggregates, so a hot key needs no array of its history.
    """
    running = F.sum(delta).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", running).groupBy(*keys).agg((F.sum(delta) - F.least(F.lit(0), F.min("_run"))).cast("long").alias("depth"))


def _replayed(rows: DataFrame, keys: list[str], order: int, result: str, start: Callable[[], list], step: Callable[[list, tuple], None]) -> DataFrame:
    """The state of each key after step() on its rows in order; rows: keys, as many columns of the order, then what step() takes (ties go by it).

    A key's rows come to one task, sorted by Spark, and stream through it: only the state of the current key is held.
    """
    n, skip = len(keys), len(keys) + order
    fields = [rows.schema[k] for k in keys]
    schema = StructType([*fields, *StructType.fromDDL(result).fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, []
        for b in batches:
            done = []
            columns = [c.to_pylist() for c in b.columns]
            for k, *e in zip(zip(*columns[:n]), *columns[skip:]):
                if k != key:
                    if key is not None:
                        done.append((*key, *state))
                    key, state = k, start()
                step(state, e)
            if done:
                yield batch(done)
        if key is not None:
            yield batch([(*key, *state)])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), types)], schema=types)

    return rows.repartition(*keys).sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


def token_bucket(rows: DataFrame, keys: list[str], order: list[str], at_ms: str, limit: int) -> DataFrame:
    """Replay of a bucket per key: allowed, limited and the tokens left.

    It starts full with `limit` tokens.  After a second or more, trunc(limit / 60 * seconds) tokens come; only when that is one or more
    does the refill time move, to now.
    """

    def step(a: list, e: list) -> None:
        (at,) = e
        last = at if a[3] is None else a[3]
        come = (at - last) * limit // 60_000 if at is not None and at - last >= 1000 else 0
        a[2], a[3] = min(limit, a[2] + come), at if come > 0 else last
        ok = a[2] > 0
        a[2] -= ok
        a[0 if ok else 1] += 1

    seq = rows.select(*keys, *(F.col(c).alias(f"_order_{k}") for k, c in enumerate(order)), F.col(at_ms).cast("long").alias("_at"))
    return _replayed(seq, keys, len(order), "allowed long, limited long, tokens long", lambda: [0, 0, limit, None], step)


def pack_segments(rows: DataFrame, keys: list[str], order: str, size: str, target: int) -> DataFrame:
    """Segments of each key when a new one begins where a record would pass the target, unless the segment is empty."""

    def step(a: list, e: list) -> None:
        (n,) = e
        if a[1] is None or n is None:  # an unknown size makes the length unknown from there on
            a[1] = None
            return
        full = a[1] > 0 and a[1] + n > target
        a[0] += full
        a[1] = n if full else a[1] + n
        a[2] = max(a[2], a[1])

    seq = rows.select(*keys, F.col(order).alias("_order"), F.col(size).cast("long").alias("_size"))
    return _replayed(seq, keys, 1, "segments long, active_bytes long, largest_segment long", lambda: [1, 0, 0], step)


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at each bound and at +Inf, and the sum, in one pass over the rows."""
    counts = rows.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"_{k}") for k, b in enumerate(bounds)), F.count(value).alias("_all"), F.sum(value).alias("total"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return counts.select(*keys, F.explode(cells).alias("c"), "total").select(*keys, "c.le", "c.n", "total")


def exposition(samples: DataFrame) -> DataFrame:
    """metric, labels (map) and value as lines of the Prometheus text format."""
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.regexp_replace(e["value"], r'(["\\\\])', r"\\$1"), F.lit("\n"), F.lit("\\n")), F.lit('"'))), ",")
    return samples.select(F.concat("metric", F.when(label != "", F.concat(F.lit("{"), label, F.lit("}"))).otherwise(""), F.lit(" "), F.format_string("%s", F.col("value"))).alias("line"))
