"""Near-duplicate documents: bottom-k sketches, inverted lists of retained values, union-sketch filter, exact Jaccard."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, connected_components, lookup
from .textvec import shingle_set, word_hashes

#: Smallest hash values that a sketch keeps.
SKETCH = 64
#: Chance that two sets exactly at the threshold share fewer sketch values than is counted on; it falls fast above the threshold.
MISS = 1e-7
#: Similarity from which a document is near to a home.
NEAR = 0.4
#: Most rows (three longs each) that are broadcast to pick documents by; beyond it texts are shuffled.
SENT = 1 << 21
#: Documents that are compared with one copy of their home's set.
PART = 256


@functools.cache
def _least_table(k: int, percent: int, cut: int = 2048) -> np.ndarray:
    """Per set size n (the last for all larger ones), the values that sketches of a linked pair share at least, but for MISS.

    Of a union of u values, of which percent are shared, the union sketch draws min(k, u) without replacement: hypergeometric.
    Drawn from more than cut values it is bounded by the binomial, which spreads more.  A set of n has unions from n to 100 n / percent.
    """
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * cut + 2)))])
    choose = lambda n, r: np.where((r < 0) | (r > n), -np.inf, logs[n] - logs[np.clip(r, 0, n)] - logs[np.clip(n - r, 0, None)])
    x = np.arange(k + 1)
    floors = np.zeros(cut + 1, np.int64)
    for u in range(1, cut + 1):
        both, draws = -(-percent * u // 100), min(k, u)
        p = np.exp(choose(both, x) + choose(u - both, draws - x) - choose(u, np.array(draws)))
        floors[u] = np.searchsorted(np.cumsum(p), MISS, side="right")
    share = percent / 100
    p = np.exp(choose(k, x) + x * np.log(share) + (k - x) * np.log1p(-share)) if share < 1 else (x == k) * 1.0
    far = int(np.searchsorted(np.cumsum(p), MISS, side="right"))
    least = [0] + [min(int(floors[n : 100 * n // percent + 1].min()), far if 100 * n // percent > cut else k) for n in range(1, cut)]
    return np.maximum(np.array([*least, far]), np.array([0, *[1] * cut]))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def sketches(docs: DataFrame, width: int, percent: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null if empty), its key, least and sketch, the k smallest of its hash values in order.

    least is what the sketch shares at least with that of any set that the document links with.
    """
    table = _least_table(k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, keys, lows = [], [], [], []
            for words in word_hashes(_texts(b)):
                found = shingle_set(words, width)
                n.append(len(found))
                digest = _digest(found)
                digests.append(digest)
                keys.append(_key(digest))
                lows.append((found[:k] >> np.uint64(1)).astype(np.int64))
            least = table[np.minimum(n, len(table) - 1)].astype(np.int32) if n else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(least), pa.array(lows, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "key", "least", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, key long, least int, sketch array<long>")


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _key(digest: bytes | None) -> int | None:
    return int.from_bytes(digest[:8], "little", signed=True) if digest else None


def _compared(texts: DataFrame, pairs: DataFrame, width: int, scratch: Scratch, near: float | None = None) -> DataFrame:
    """a, b, na, nb, shared of the distinct pairs (a, b), by their whole sets; delta: for pairs at least `near`, what only one of them has.

    texts has doc_id, text and key (of the text that stands for its doc_id; null: any).  Each a meets its b's in parts of about PART: its
    set comes first in the part's sorted rows and stays in memory while those of the b's stream by, so one set crosses the network for a pair.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, key, words in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), word_hashes(_texts(b))):
                found = shingle_set(words, width)
                if key is None or key == _key(_digest(found)):
                    out.append((i, found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["id", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, x, last = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for a, part, second, i, y in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "second", "id", "set"))):
                y = np.frombuffer(y, np.uint64)
                if at_part != (a, part):
                    at_part, x, last = (a, part), y, None
                if not second or i == last:  # of rows that repeat one counts
                    continue
                last = i
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                alike = x[at] == y
                shared = int(alike.sum())
                delta = None
                if near is not None and shared >= near * (len(x) + len(y) - shared):
                    lacks = np.ones(len(x), bool)
                    lacks[at[alike]] = False
                    delta = np.concatenate([x[lacks], y[~alike]]).view(np.int64)
                out.append((a, i, len(x), len(y), shared, delta))
            kinds = [*[pa.int64()] * 5, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=["a", "b", "na", "nb", "shared", "delta"])

    total = pairs.count()
    sizes = scratch.written(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).alias("parts")), "homes")
    second = lookup(pairs.select("a", "b"), sizes, ["a"], "n", total).select(F.col("b").alias("id"), "a", F.expr("pmod(xxhash64(b), parts)").alias("part"), F.lit(True).alias("second"))
    first = sizes.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("second"))
    wanted = scratch.written(second.unionByName(first), "wanted")
    ids = wanted.select(F.col("id").alias("doc_id")).distinct()
    if wanted.count() <= SENT:
        ids, wanted = F.broadcast(ids), F.broadcast(wanted)
    found = texts.join(ids, "doc_id", "left_semi").mapInArrow(sets, "id long, set binary").join(wanted, "id")
    dealt = found.repartition("a", "part").sortWithinPartitions("a", "part", "second", "id")
    return dealt.select("a", "part", "second", "id", "set").mapInArrow(compare, "a long, b long, na long, nb long, shared long, delta array<long>")


def _rare_first(entries: DataFrame, key: list[str], owner: list[str], scratch: Scratch) -> DataFrame:
    """entries (owner, key and what else depends on owner) whose key occurs twice, with members, its number, mine, the owner's number of such, and place among them, rarest first."""
    entries = scratch.written(entries, "entries")
    common = scratch.written(entries.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1"), "common")
    found = lookup(entries, common, key, "members", entries.count()).where("members IS NOT NULL")
    own = Window.partitionBy(*owner)
    return found.withColumns({"mine": F.count("*").over(own), "place": F.row_number().over(own.orderBy("members", *key)), "score": F.sum("members").over(own)})


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles.  Equal sets are one
    class, of which the smallest doc_id stands for all.  A class's k smallest hash values are its sketch.  Two linked sketches
    share at least `least` values (see _least_table), so they share one of their rarest values even without the `least` - 1 most
    frequent: only those get inverted lists, and passages of many documents get none.

    A document first meets its home, the centre with the most company among its lists, and that one's home, no one else.  Those near to one
    home are a circle.  Only two kinds of pairs can still link two components:
    - those in one list but in no common circle, by their union sketches;
    - those of one circle.  With delta the symmetric difference to the home's set and n the size of a set, x and y link only if
      |delta x & delta y| >= (|delta x| + |delta y| - s (nx + ny)) / 2, where s = (100 - percent) / (100 + percent).  As one of the two is not
      linked to the home, that is over 0; so they share one of the rarest elements of their deltas, and again only those get lists.
    So groups of copies do not make all their pairs.  The exact sets decide on all pairs found.

    Empty and null texts have n_shingles 0 and link with nothing.  A null doc_id has a null component and is kept.  Rows
    that share a doc_id count as one document: of their sets, the one with the smallest digest.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    written = scratch.written
    rows = written(sketches(docs, width, percent, k), "sketches")
    live = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("key"))
    twice = written(live.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"), "twice")
    named_by = F.col("digest")
    if not twice.isEmpty():
        live = written(lookup(live, twice, ["doc_id"], "n", rows.count()).where("first IS NULL OR first = key").drop("n"), "live")
        texts = lookup(texts.drop("key"), twice.withColumnRenamed("first", "key"), ["doc_id"], "n", rows.count()).drop("n")
        chosen = live.where("first IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("chosen")).join(twice.drop("first"), "doc_id")
        rows, named_by = lookup(rows, written(chosen, "chosen"), ["doc_id"], "n", rows.count()), F.coalesce("chosen", "digest")
    one = live.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "least", "sketch")).alias("m"), F.count("*").alias("copies"))
    classes = written(one.select("digest", "copies", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.least").alias("least"), F.col("m.sketch").alias("sketch")), "classes")
    slim = classes.select("id", "sketch", "least")

    def likely(pairs: DataFrame, test: str) -> DataFrame:
        """The distinct pairs (a, b) whose union sketch passes the test."""
        both = pairs.select("a", "b").distinct().join(slim.toDF("a", "x", "la"), "a").join(slim.toDF("b", "y", "lb"), "b")
        return written(both.where(test).select("a", "b"), "candidates")

    union = f"slice(sort_array(array_union(x, y)), 1, {k})"
    may_link = f"size(array_intersect(x, y)) >= greatest(la, lb) AND size(array_intersect({union}, array_intersect(x, y))) >= greatest(la, lb)"
    may_be_near = f"size(array_intersect({union}, array_intersect(x, y))) >= {NEAR - 0.1} * size({union})"

    kept = F.least("n", F.lit(k))
    lists = _rare_first(classes.select("id", "n", "least", F.explode("sketch").alias("v")), ["v"], ["id"], scratch)
    lists = lists.where(kept - F.col("mine") + F.col("place") <= kept - F.col("least") + 1)
    lists = written(lists.select("v", "id", "n", "score"), "lists")
    n_lists = lists.count()

    # the centre of a list is its member of the highest score; a document's home, the best centre of its lists
    centre = written(lists.groupBy("v").agg(F.max(F.struct("score", (-F.col("id")).alias("low"))).alias("c"), F.count("*").alias("m")).where("m > 1"), "centres")
    home = lookup(lists, centre, ["v"], "m", n_lists).where("c IS NOT NULL").groupBy("id").agg(F.max("c").alias("c")).select("id", (-F.col("c.low")).alias("home"))
    home = written(home, "homes")
    # a home may have a better one itself: two tries a document
    above = home.select(F.col("id").alias("home"), F.col("home").alias("top"))
    tries = home.join(above, "home", "left").select(F.explode(F.array_distinct(F.array(F.coalesce("top", "home"), "home"))).alias("a"), F.col("id").alias("b")).where("a <> b")
    near = written(_compared(texts, likely(tries, may_be_near), width, scratch, NEAR).where("delta IS NOT NULL"), "near")
    near = near.withColumn("linked", F.expr(f"100 * shared >= {percent} * (na + nb - shared)"))
    links = written(near.where("linked").select("a", "b"), "links")
    components = written(connected_components(links, scratch), "components")

    def placed(df: DataFrame) -> DataFrame:
        """Adds c, the component of id: its own id where it has no link."""
        return df.join(components.withColumnRenamed("component_id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))

    size = f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    s = (100 - percent) / (100 + percent)

    # pairs of one list; the circle with the most members of a list need not be paired within itself
    close = near.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("close"))  # one or two
    circle = F.coalesce(F.array_min("close"), F.col("id"))
    member = written(placed(lists.select("v", "id", "n").join(close, "id", "left")).withColumn("circle", circle).withColumn("close", F.expr("array_append(coalesce(close, cast(array() AS array<bigint>)), id)")), "members")
    most = member.groupBy("v", "circle").agg(F.count("*").alias("m")).groupBy("v").agg(F.max(F.struct("m", "circle")).alias("m"), F.count("*").alias("parts"), F.sum("m").alias("all")).where("parts > 1")
    most = written(most.select("v", F.col("m.circle").alias("main"), "all"), "main")
    member = written(lookup(member, most, ["v"], "all", n_lists).where("main IS NOT NULL"), "members")
    odd = member.where("circle <> main").selectExpr("v", "id AS ix", "n AS nx", "c AS cx", "circle AS gx", "close AS hx")
    other = member.selectExpr("v AS v2", "id AS iy", "n AS ny", "c AS cy", "circle AS gy", "close AS hy", "circle = main AS in_main")
    by_list = odd.join(other, F.expr(f"v = v2 AND gx <> gy AND cx <> cy AND (in_main OR ix < iy) AND {size} AND NOT arrays_overlap(hx, hy)")).select(F.col("ix").alias("a"), F.col("iy").alias("b"))

    # pairs of one circle
    inside = placed(near.select("a", F.col("b").alias("id"), F.col("nb").alias("n"), "linked", F.size("delta").alias("d"), "delta")).withColumn("rest", F.col("d") - s * F.col("n"))
    inside = written(inside, "inside")
    open_ = inside.groupBy("a").agg(F.min(F.when(~F.col("linked"), F.col("rest"))).alias("low_x"), F.min("rest").alias("low"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("low_x IS NOT NULL AND c0 <> c1")
    open_ = written(open_.select("a", "low_x", "low", "m"), "open")
    inside = lookup(inside, open_, ["a"], "m", inside.count()).where("low IS NOT NULL")
    deltas = _rare_first(inside.select("a", "id", "n", "linked", "d", "c", "rest", "low_x", "low", F.explode("delta").alias("w")), ["a", "w"], ["a", "id"], scratch)
    deltas = deltas.withColumn("at", F.col("d") - F.col("mine") + F.col("place")).where("at <= d + 1 - greatest(1, ceil((rest + low) / 2 - 1e-9))")
    deltas = written(deltas.select("a", "w", "id", "n", "linked", "d", "c", "rest", "at", F.expr("at <= d + 1 - greatest(1, ceil((rest + low_x) / 2 - 1e-9))").alias("as_y")), "deltas")
    x = deltas.where("NOT linked").selectExpr("a", "w", "id AS ix", "n AS nx", "d AS dx", "c AS cx", "rest AS rx", "at AS px")
    y = deltas.where("as_y").selectExpr("a AS a2", "w AS w2", "id AS iy", "n AS ny", "d AS dy", "c AS cy", "rest AS ry", "at AS py", "linked AS ly")
    need = "greatest(1, ceil((rx + ry) / 2 - 1e-9))"
    by_delta = x.join(y, F.expr(f"a = a2 AND w = w2 AND cx <> cy AND (ly OR ix < iy) AND {size} AND px <= dx + 1 - {need} AND py <= dy + 1 - {need}")).select(F.col("ix").alias("a"), F.col("iy").alias("b"))
    pairs = by_list.unionByName(by_delta).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = likely(pairs, may_link)
    if not more.isEmpty():
        found = _compared(texts, more, width, scratch).where(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")
        components = connected_components(written(links.unionByName(found), "links"), scratch)

    named = written(classes.select("digest", "copies", "id").join(components, "id", "left").select("digest", "copies", F.coalesce("component_id", "id").alias("component_id")), "named")
    out = lookup(rows.select("doc_id", "n_shingles", F.coalesce(named_by, F.lit(b"")).alias("digest")), named, ["digest"], "copies", rows.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = Scratch(docs.sparkSession).written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    scratch.clear()
    return result
