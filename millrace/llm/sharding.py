"""Range sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

_ZEROS = "0" * 16


def _hex(col: Column) -> Column:
    return F.lpad(F.hex(col), 16, "0")


def _splitters(sample: list[tuple[str, int]], n: int) -> list[str]:
    """Up to n - 1 quantiles of a weighted sample of keys, with no text's key split unless it fills more than a range."""
    sample.sort()
    total, at, seen, out = sum(w for _, w in sample), 1, 0, []
    for key, w in sample:
        seen += w
        if seen * n < at * total:
            continue
        at = seen * n // total + 1
        cut = key[:16] + _ZEROS
        cut = key if out and out[-1] >= cut else cut
        if not out or cut > out[-1]:
            out.append(cut)
    return out


def _range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are at most key, by binary search in one array literal."""
    bits = max(1, len(cuts).bit_length())
    padded = cuts + ["~"] * ((1 << bits) - len(cuts))
    bounds = F.split(F.lit(",".join(padded)), ",")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(bits))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at))


def _offsets(values: list[int]) -> Column:
    """The running sum before each of values, as an array literal."""
    out, total = [], 0
    for v in values:
        out.append(str(total))
        total += v
    return F.split(F.lit(",".join(out)), ",")


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 128, oversample: int = 16, rounds: int = 4) -> DataFrame:
    """Deal documents to shards of near-equal bytes, equal texts side by side.

    The key is a hash of the text, then one of doc_id.  A sample in which a record's weight is its size gives splitters;
    they cut the keys into ranges, of which the overfull ones are sampled again and subdivided.  A range holds about
    1/ranges_per_shard of a shard; copies of a text that lie in one range stay together, and only a text whose copies fill
    more than a range is split, by doc_id.  A range's first byte in key order decides its shard.  The driver holds at most
    about oversample * ranges keys, with ranges bounded by 65,536.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard (null).  A null text has
    size 16 and the checksum of the empty text; rows with equal doc_id and text get different slots; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = written(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(F.lit(17), "doc_id"))).alias("key")), "shard_keys")
    count, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not count:
        return slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    n_ranges = min(1 << 16, max(n_shards * ranges_per_shard, count // 100_000))
    chance = F.pmod(F.xxhash64("key", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def drawn(rows: DataFrame, rate: Column) -> list[tuple[str, int]]:
        got = rows.select("key", F.floor(F.col("size") * rate + chance).alias("w")).where("w > 0").groupBy("key").agg(F.sum("w").alias("w"))
        return [(r.key, r.w) for r in got.collect()]

    cuts = _splitters(drawn(slim, F.lit(n_ranges * oversample / total)), n_ranges)
    sizes: list[tuple[int, int]] = []
    for k in range(rounds):
        ranged = slim.withColumn("range", _range_of(F.col("key"), cuts))
        found = {r.range: (r.bytes, r.rows) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        sizes = [found.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        full = {i: b for i, (b, rows) in enumerate(sizes) if b * n_ranges > 2 * total and rows > 1}
        if not full or k == rounds - 1:
            break
        again = drawn(ranged.where(F.col("range").isin(*full)), F.lit(4 * n_ranges * oversample / total))
        more: set[str] = set(cuts)
        for i, b in full.items():
            low, high = cuts[i - 1] if i else "", cuts[i] if i < len(cuts) else "~"
            inside = [(key, w) for key, w in again if low <= key < high]
            if inside:
                more |= {c for c in _splitters(inside, 2 * -(-b * n_ranges // total)) if low < c < high}
        if len(more) == len(cuts):
            break
        cuts = sorted(more)

    ranged = slim.withColumn("range", _range_of(F.col("key"), cuts))
    order = Window.partitionBy("range").orderBy("key", "doc_id")
    piece = Window.partitionBy("range", "text_key").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranged.withColumns({"before": before, "place": F.row_number().over(order) - 1, "text_key": F.substring("key", 1, 16)})
    placed = placed.withColumns({"first": F.min("before").over(piece), "whole": F.sum("size").over(piece)})
    middle = F.get(_offsets([b for b, _ in sizes]), F.col("range")).cast("long") + F.col("first") + F.expr("whole div 2")
    rank = F.get(_offsets([r for _, r in sizes]), F.col("range")).cast("long") + F.col("place")
    shard = F.least(F.floor(middle.cast("double") * n_shards / total), F.lit(n_shards - 1)).cast("int")
    dealt = written(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), rank.alias("rank")), "shards")
    rows_of = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    first = F.get(_offsets([rows_of.get(i, 0) for i in range(n_shards)]), F.col("shard")).cast("long")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
