"""Best-fit packing of token pieces by bin completion over the histogram of their lengths."""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import POSSESSIVE_PATTERN, read_ranks
from .common import written

#: (lengths of one filling, largest first; number of sequences filled so)
Plan = list[tuple[tuple[int, ...], int]]

log = logging.getLogger(__name__)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts of equal lengths: sequences with equal contents move together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                held, n, room = (), left, capacity
            else:
                held, n = next(iter(open_[room].items()))
            took = min(n, left)
            if held:
                open_[room][held] -= took
                if not open_[room][held]:
                    del open_[room][held]
                if not open_[room]:
                    del open_[room]
                into = open_.setdefault(room - size, {})
                into[(*held, size)] = into.get((*held, size), 0) + took
            else:
                each = 1 if 2 * size > capacity else capacity // size
                for k, bins in ((each, took // each), (took % each, 1)):
                    if k and bins:
                        into = open_.setdefault(capacity - k * size, {})
                        into[(size,) * k] = into.get((size,) * k, 0) + bins
            left -= took
    return [(held, n) for group in open_.values() for held, n in group.items()]


def _fillings(sizes: list[int], counts: Counter, room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, fullest first, then those of fewer and larger pieces.

    A filling is dropped when a larger unused piece could take the place of one of its pieces, or when a further piece fits.
    The search stops after `most` fillings or at once when one leaves no room.
    """
    out: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def search(at: int, left: int, held: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        fits = False
        for k in range(at, len(sizes)):
            size = sizes[k]
            if size > left or counts[size] <= held.count(size):
                continue
            fits = True
            if search(k, left - size, (*held, size)) or len(out) >= most or steps > 50 * most:
                return True
        if not fits:
            smaller = any(size <= left and counts[size] > held.count(size) for size in sizes[:at])
            dominated = any(0 < big - mine <= left and counts[big] > held.count(big) for mine in set(held) for big in sizes if big > mine)
            if not smaller and not dominated:
                out.append((left, held))
                return left == 0
        return False

    search(0, room, ())
    return [held for _, held in sorted(out, key=lambda x: (x[0], len(x[1])))]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """A proven least number of sequences.

    For each small size a: pieces over capacity - a (top) have nothing of a or more beside them.  Those over capacity - 2 a
    have at most one such piece beside them, and the best pairing of these leaves some room.  Only pieces under a may fill either
    room, and what they cannot fill is waste beside the sum of all lengths.  Martello and Toth's bound is the case without pairing.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    volume = left * np.arange(capacity + 1)
    total, best = int(volume.sum()), -(-int(volume.sum()) // capacity)
    for a in range(1, capacity // 2 + 1):
        small, top = int(volume[:a].sum()), range(capacity - a + 1, capacity + 1)
        rooms = sum(int(left[b]) * (capacity - b) for b in top)
        best = max(best, -(-(total + max(0, rooms - small)) // capacity))
        if 4 * a > capacity:
            continue
        # largest piece first, into the smallest room that holds it: this pairs the most that can be paired
        spare = {r: int(left[capacity - r]) for r in range(a, 2 * a)}
        rooms += sum(r * n for r, n in spare.items())
        for s in range(2 * a - 1, a - 1, -1):
            n = int(left[s])
            for r in range(s, 2 * a):
                took = min(n, spare[r])
                spare[r] -= took
                n -= took
                rooms -= took * s
                if not n:
                    break
        best = max(best, -(-(total + max(0, rooms - small)) // capacity))
    return max(best, int(left[capacity // 2 + 1 :].sum()))


def _plentiful(left: np.ndarray, room: int) -> tuple[tuple[int, ...], int] | None:
    """The two or three pieces that fill the room exactly and of whose scarcest size most are left, with a quarter of that number."""

    def two(room: int) -> tuple[int, tuple[int, ...]]:
        low = np.arange(1, room // 2 + 1)
        n = np.minimum(left[low], left[room - low])
        if room % 2 == 0 and room:
            n[-1] = left[room // 2] // 2
        k = int(n.argmax()) if len(n) else 0
        return (int(n[k]), (room - k - 1, k + 1)) if len(n) else (0, ())

    n, held = two(room)
    if not n:
        for s in map(int, np.argsort(-left[: max(0, room - 1)], kind="stable")[:8]):
            if s and left[s]:
                rest, pair = two(room - s)
                least = min((int(left[x]) // (s, *pair).count(x) for x in (s, *pair)), default=0) if rest else 0
                if least > n:
                    n, held = least, tuple(sorted((s, *pair), reverse=True))
    return (held, max(1, n // 4)) if n else None


def _dearest(left: np.ndarray, value: np.ndarray, room: int) -> tuple[int, ...]:
    """A filling of high value, by the best sums of values up to each room; pieces of which too few are left are replaced in further rounds."""
    left, out = left[: room + 1].copy(), []
    while room > 0:
        sizes = np.flatnonzero(left[: room + 1])
        if not len(sizes):
            break
        best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
        upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
        for c in range(int(sizes[0]), room + 1):
            total = best[c - sizes[: upto[c]]] + value[sizes[: upto[c]]]
            k = int(total.argmax())
            best[c], last[c] = (total[k], sizes[k]) if total[k] > best[c - 1] else (best[c - 1], 0)
        c = room
        while c >= sizes[0]:
            s = int(last[c])
            if s and left[s]:
                left[s] -= 1
                room -= s
                out.append(s)
            c -= s or 1
    return tuple(sorted(out, reverse=True))


def _descent(counts: dict[int, int], capacity: int, value: np.ndarray, spare: int, plenty: bool) -> tuple[Plan, bool]:
    """One branch to its end, or until it has wasted more than spare: for the largest piece left, a piece that fills its room
    alone, which dominates all else, or what is most plentiful (if plenty), or else what is dearest, as often as the counts allow."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    plan: Plan = []
    for big in range(capacity, 0, -1):
        while left[big] and spare >= 0:
            room, most = capacity - big, None
            left[big] -= 1
            if left[room]:
                held: tuple[int, ...] = (room,)
            elif plenty and (found := _plentiful(left, room)):
                held, most = found
            else:
                held = _dearest(left, value, room)
            left[big] += 1
            n = min(int(left[s]) // c for s, c in Counter((big, *held)).items())
            n = min(n, most or n)
            for s in (big, *held):
                left[s] -= n
            spare -= n * (room - sum(held))
            plan.append(((big, *held), n))
    return plan, spare >= 0


def _probes(counts: dict[int, int], capacity: int, best: Plan, least: int, probes: int) -> Plan:
    """The best of several descents.  Lengths that ended in wasteful sequences gain value for the next one, and so are used earlier there."""
    total = sum(s * n for s, n in counts.items())
    best_n = sum(n for _, n in best)
    size = np.arange(capacity + 1, dtype=float)
    value, power = size, 1.0
    for probe in range(probes):
        if best_n <= least:
            break
        if probe in (1, 5):
            power = 1.02 if probe == 1 else 1.1
            value = size**power
        plan, whole = _descent(counts, capacity, value, (best_n - 1) * capacity - total, plenty=probe == 0)
        if whole:
            best, best_n = plan, sum(n for _, n in plan)
        gain, seen = np.zeros(capacity + 1), np.zeros(capacity + 1)
        for (big, *held), n in plan:
            for s in held or [big]:
                gain[s] += n * capacity / (big + sum(held))
                seen[s] += n
        value = np.where(seen > 0, (value + size**power * gain / np.maximum(seen, 1)) / 2, value)
    return best


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 2000, width: int = 24, probes: int = 8) -> Plan:
    """As few sequences as branch and bound finds: the largest piece left is completed by each undominated filling in turn.

    A filling is used for as many sequences as the counts allow.  A branch ends when its waste exceeds what a better
    solution than the incumbent may waste; best-fit decreasing and `probes` single descents, each with another order of the fillings,
    give the first incumbents, and every complete branch the next.  The search ends at lower_bound(), when all is searched, or
    after `nodes` steps with `width` fillings a step; pack() logs the bound beside what was found.
    """
    counts = Counter({s: n for s, n in counts.items() if n})
    total = sum(s * n for s, n in counts.items())
    least = lower_bound(counts, capacity)
    best = _probes(counts, capacity, best_fit(counts, capacity), least, probes)
    best_n = sum(n for _, n in best)
    left, plan = Counter(counts), []

    def options() -> tuple[int, list[tuple[int, ...]]]:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        big = sizes[0]
        left[big] -= 1
        found = _fillings([s for s in sizes if left[s]], left, capacity - big, width) or [()]
        left[big] += 1
        return big, found

    def take(big: int, held: tuple[int, ...], sign: int, n: int) -> None:
        for s in (big, *held):
            left[s] -= sign * n

    stack: list[list] = []
    wasted = bins = steps = 0
    if total and best_n > least:
        stack.append([*options(), 0, None])
    while stack and steps < nodes and best_n > least:
        steps += 1
        big, found, k, used = top = stack[-1]
        if used is not None:
            held, n = used
            take(big, held, -1, n)
            wasted -= n * (capacity - big - sum(held))
            bins -= n
            plan.pop()
            top[3] = None
        if k >= len(found):
            stack.pop()
            continue
        held = found[k]
        top[2] += 1
        need = Counter((big, *held))
        n = min(left[s] // c for s, c in need.items())
        waste = n * (capacity - big - sum(held))
        if wasted + waste > (best_n - 1) * capacity - total:
            # fuller fillings come first: as none after this one wastes less, fewer sequences of it may still do
            n = max(0, ((best_n - 1) * capacity - total - wasted) // max(1, capacity - big - sum(held)))
            if not n:
                top[2] = len(found)
                continue
            waste = n * (capacity - big - sum(held))
        take(big, held, 1, n)
        wasted, bins, top[3] = wasted + waste, bins + n, (held, n)
        plan.append(((big, *held), n))
        if not any(left.values()):
            if bins < best_n:
                best, best_n = list(plan), bins
        else:
            stack.append([*options(), 0, None])
    return best


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document's ids and end_id; nulls are empty texts, repeated rows are documents of their own.

    The ids are those of the tokenizer's JSON file: the rank file holds the same vocabulary, and the one special token,
    which the JSON file also finds inside texts, is given its id here.  Only documents of more than capacity ids are cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(ranks_path)
        encoding = tiktoken.Encoding("byte_bpe", pat_str=POSSESSIVE_PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encoding.encode(text or "", allowed_special="all", disallowed_special=())
                raw = np.array([*ids, end_id], "<u4")
                n = len(raw)
                at, end, k = 0, n if n <= capacity else n % capacity or capacity, 0
                while at < n:
                    rows.append((doc_id, k, at, end - at, zlib.crc32(raw[at:end])))
                    at, end, k = end, end + capacity, k + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 1024, salts: int = 64) -> DataFrame:
    """pieces (with length from 1 to capacity) with sequence_id and offset, in as few sequences as bin completion finds.

    Pieces of one length are exchangeable, so the plan is made from at most capacity counts.  A piece's rank among those
    of its length, counted in salted parts as a length may be hot, picks its place.  Full pieces are alone in a sequence.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.drop("sequence_id", "offset").withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    part = pieces.where(F.col("length") < capacity)
    counted = sorted((r.length, r._salt, r["count"]) for r in part.groupBy("length", "_salt").count().collect())
    counts: Counter = Counter()
    before = []
    for length, salt, n in counted:
        before.append((length, salt, counts[length]))
        counts[length] += n
    spans, used, first = [], Counter(), 0
    plan = bin_completion(counts, capacity)
    log.info("%d pieces in %d sequences; no plan has fewer than %d", sum(counts.values()), sum(n for _, n in plan), lower_bound(counts, capacity))
    for held, n in plan:
        at = 0
        for length, k in sorted(Counter(held).items(), reverse=True):
            spans.append((length, used[length], used[length] + k * n, first, n, at))
            used[length] += k * n
            at += k * length
        first += n
    ranks = spark.createDataFrame(before, "length long, _salt int, _before long")
    places = spark.createDataFrame(spans, "length long, low long, high long, first long, n long, at long").groupBy("length").agg(F.collect_list(F.struct("low", "high", "first", "n", "at")).alias("_places"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(F.lit(0))) - 1
    # both tables are bounded by the capacity: at most salts counts and a few fillings a length
    ranked = part.withColumn("_rank", number).join(F.broadcast(ranks), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    place = F.get(F.filter("_places", lambda p: (p.low <= F.col("_rank")) & (F.col("_rank") < p.high)), F.lit(0))
    placed = ranked.join(F.broadcast(places), "length").withColumn("_p", place)
    step = F.col("_rank") - F.col("_p.low")
    out = [c for c in pieces.columns if c != "_salt"]
    placed = placed.select(*out, (2 * (F.col("_p.first") + step % F.col("_p.n"))).alias("sequence_id"), (F.col("_p.at") + F.expr("(_rank - _p.low) div _p.n") * F.col("length")).alias("offset"))
    full = pieces.where(F.col("length") >= capacity).select(*out, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
