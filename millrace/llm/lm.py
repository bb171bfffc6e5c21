"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried over windows."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written
from .textvec import mix, word_hashes

#: Words with their own output; the next most frequent ones share one, and so do the document ends.
VOCABULARY = 2048
CLASSES = 48
HIDDEN = 16
#: Words whose counts are sent to the scoring tasks; the counts of the others are joined.
HEAD = 1 << 19
#: Documents read side by side, steps of a window, tokens gathered before a pass.
LANES, WINDOW, GATHER = 384, 48, 3 << 20
#: The same in training, where a longer document is cut: states and gradients of a piece begin at zero.
TRAIN_LANES, TRAIN_WINDOW, PIECE = 256, 32, 1024
END = np.uint64(0x1F3D5B79E0C2A486)
#: The training documents are dealt by hash into rounds, and those of a round into shards of about so many tokens.
ROUNDS, SHARD, RATE = 2, 500_000, 0.4
#: Squares of gradients that a parameter has from the start: rare ones then move little.
FLOOR = 1e-7
LOG10 = float(np.log(10))


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): the count of every word and of the ends, over all rows; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, END).view(np.int64)), pa.array(np.append(c, ends))], names=["h", "c"])

        for b in batches:
            for words in word_hashes(_texts(b)):
                held.append(words)
                size += len(words)
                ends += 1
            if size > GATHER:
                yield flush()
                held, size, ends = [], 0, 0
        if ends:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Table:
    """Values by 64-bit key: open addressing, looked up for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, bool)
        left = np.arange(len(keys))
        at = mix(keys) & self.mask
        while len(left):
            free = ~self.used[at]
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slot], self.values[slot], self.used[slot] = keys[won], values[won], True
            lost = ~np.isin(left, won)
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            used = self.used[at]
            hit = used & (self.keys[at] == keys[left])
            out[left[hit]] = self.values[at[hit]]
            go = used & ~hit
            left, at = left[go], (at[go] + np.uint64(1)) & self.mask
        return out


class Gru:
    """Parameters, and passes over streams of documents.

    Outputs are sorted by frequency and cut into classes of equal sums of square roots of counts: p(w) = p(class) * p(w in class).
    Biases begin at the unigram distribution, so an unfitted model is that one.
    """

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN) -> None:
        v, rng = len(counts), np.random.default_rng(7)
        mass = np.cumsum(np.sqrt(counts + 1.0))
        of = np.minimum((mass - mass[0]) / mass[-1] * min(classes, v), min(classes, v) - 1).astype(np.int64)
        self.class_of = np.unique(of, return_inverse=True)[1]
        self.first = np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 2))
        p = (counts + 1.0) / (counts + 1.0).sum()
        of_class = np.add.reduceat(p, self.first[:-1])
        f = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
        self.p = {
            "x": f(v, 3 * hidden), "u": f(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "wc": 0 * f(hidden, len(of_class)), "bc": np.log(of_class).astype(np.float32),
            "ww": 0 * f(v, hidden), "bw": np.log(p / of_class[self.class_of]).astype(np.float32),
        }

    def copy(self) -> Gru:
        """A model with parameters of its own: those of a broadcast must stay as they are, as Python workers are used again."""
        out = copy.copy(self)
        out.p, out.seen = {n: v.copy() for n, v in self.p.items()}, 0
        return out

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after the inputs x, and what backpropagation needs."""
        n, p = h.shape[1], self.p
        gx, gh = p["x"][x] + p["b"], h @ p["u"]
        zr = 1 / (1 + np.exp(-(gx[:, : 2 * n] + gh[:, : 2 * n])))
        z, r = zr[:, :n], zr[:, n:]
        e = np.exp(-2 * (gx[:, 2 * n :] + r * gh[:, 2 * n :]))
        c = 2 / (1 + e) - 1
        return c + z * (h - c), z, r, c, gh[:, 2 * n :]

    def losses(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of y from the states h; with grads, these are added to it and those of h returned."""
        p = self.p
        k = self.class_of[y]
        rows = np.arange(len(y))
        e = h @ p["wc"] + p["bc"]
        own = e[rows, k]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        out = own - np.log(total)
        dh = None
        if grads is not None:
            d = -e / total[:, None]
            d[rows, k] += 1
            grads["wc"] += h.T @ d
            grads["bc"] += d.sum(axis=0)
            dh = d @ p["wc"].T
        order = np.argsort(k.astype(np.int16), kind="stable")
        ends = np.searchsorted(k[order], np.arange(len(self.first)))
        for c in np.flatnonzero(np.diff(ends)):
            a, b = self.first[c], self.first[c + 1]
            if b - a == 1:
                continue
            mine = order[ends[c] : ends[c + 1]]
            hm, at = h[mine], y[mine] - a
            e = hm @ p["ww"][a:b].T + p["bw"][a:b]
            own = e[np.arange(len(mine)), at]
            np.exp(e, out=e)
            total = e.sum(axis=1)
            out[mine] += own - np.log(total)
            if grads is not None:
                d = -e / total[:, None]
                d[np.arange(len(mine)), at] += 1
                grads["ww"][a:b] += d.T @ hm
                grads["bw"][a:b] += d.sum(axis=0)
                dh[mine] += d @ p["ww"][a:b]
        return out, dh

    def run(self, docs: list[np.ndarray], end: int, learn: float = 0.0) -> np.ndarray:
        """Log probability of each document's tokens (its last is the end); with learn, steps of that rate are made.

        Documents are dealt to lanes, longest first; a lane's state is zero before each of its documents and otherwise
        carried over the windows, while gradients stop at a window's edge.
        """
        size = np.array([len(d) for d in docs])
        lanes, window = (min(TRAIN_LANES, len(docs)), TRAIN_WINDOW) if learn else (min(LANES, len(docs)), WINDOW)
        held: list[list[int]] = [[] for _ in range(lanes)]
        load = np.zeros(lanes, np.int64)
        for k in np.argsort(-size, kind="stable"):
            at = int(load.argmin())
            held[at].append(int(k))
            load[at] += size[k]
        order = np.argsort(-load, kind="stable")
        steps = int(load.max())
        y = np.zeros((steps, lanes), np.int64)
        for lane, k in enumerate(order):
            y[: load[k], lane] = np.concatenate([docs[i] for i in held[k]])
        load = load[order]
        x = np.vstack([np.full((1, lanes), end), y[:-1]])
        p, hidden = self.p, len(self.p["u"])
        state = np.zeros((lanes, hidden), np.float32)
        got = np.zeros((steps, lanes))
        square = {k: np.full(v.shape, FLOOR, np.float32) for k, v in p.items()} if learn else {}
        for t0 in range(0, steps, window):
            t1 = min(t0 + window, steps)
            live = int((load > t0).sum())
            h = state[:live]
            kept, hs = [], np.empty((t1 - t0, live, hidden), np.float32)
            for t in range(t0, t1):
                fresh = x[t, :live] == end
                if fresh.any():
                    h = np.where(fresh[:, None], np.float32(0), h)
                new, *rest = self.step(h, x[t, :live])
                if learn:
                    kept.append((h, fresh, *rest))
                h = hs[t - t0] = new
            state = h
            inside = (np.arange(t0, t1)[:, None] < load[None, :live]).ravel()
            flat, target = hs.reshape(-1, hidden), y[t0:t1, :live].ravel()
            if not inside.all():
                flat, target = flat[inside], target[inside]
            grads = {k: np.zeros_like(v) for k, v in p.items()} if learn else None
            part = np.zeros(len(inside))
            part[inside], dflat = self.losses(flat, target, grads)
            got[t0:t1, :live] = part.reshape(t1 - t0, live)
            if learn:
                dhs = np.zeros((len(inside), hidden), np.float32)
                dhs[inside] = dflat
                self.back(x[t0:t1, :live], kept, dhs.reshape(t1 - t0, live, hidden), grads)
                for name, g in grads.items():
                    g /= lanes * window  # the last windows have few lanes left, and so little weight
                    square[name] += g * g
                    p[name] += np.float32(learn) * g / np.sqrt(square[name])
        out = np.zeros(len(docs))
        for lane, k in enumerate(order):
            edges = np.cumsum([0, *(size[i] for i in held[k])])
            out[held[k]] = np.add.reduceat(got[: load[lane], lane], edges[:-1])
        return out

    def back(self, x: np.ndarray, kept: list[tuple], dhs: np.ndarray, grads: dict) -> None:
        """Adds the gradients through a window's steps."""
        n, u = dhs.shape[2], self.p["u"]
        dh, dx = np.zeros(dhs.shape[1:], np.float32), np.empty((*x.shape, 3 * n), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, fresh, z, r, c, ghc = kept[t]
            dh = dh + dhs[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * ghc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dc], axis=1)
            grads["u"] += h.T @ dg
            dh = (dh * z + dg @ u.T) * ~fresh[:, None]
        flat = dx.reshape(-1, 3 * n)
        grads["b"] += flat.sum(axis=0)
        order = np.argsort(x.ravel().astype(np.int32), kind="stable")
        words = x.ravel()[order]
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        grads["x"][words[starts]] += np.add.reduceat(flat[order], starts)


class Head:
    """The most frequent words' counts, the outputs of the model among them, and what is left for the tail."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int) -> None:
        order = np.lexsort((keys, -counts))
        keys, counts = keys[order].view(np.uint64), counts[order]
        self.n, self.v, self.counts = n, v, counts
        own = min(VOCABULARY, len(keys))
        self.tail = own  # the output of all other words
        at_end = np.flatnonzero(keys[:own] == END)
        if len(at_end):
            self.end, own_end = int(at_end[0]), 0
        else:  # without documents, or with ends rarer than the vocabulary
            self.end, own_end = own + 1, 1
        self.table = Table(keys, np.arange(len(keys)))
        self.rest_n, self.rest_v = n - int(counts[:own].sum()), v - own
        self.outputs = np.concatenate([counts[:own], [self.rest_n + self.rest_v], [0] * own_end]).astype(np.int64)
        self.rank = np.argsort(-self.outputs, kind="stable")
        self.place = np.argsort(self.rank)

    def gru(self) -> Gru:
        return Gru(self.outputs[self.rank])

    def ids(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model outputs of a text's words and its end; places in the head (-1: not there)."""
        at = self.table.find(words)
        out = np.where((at < 0) | (at >= self.tail), self.tail, at)
        return self.place[np.append(out, self.end)], at


def fit(docs: DataFrame, head: Head, rounds: int = ROUNDS, shard: int = SHARD) -> Gru:
    """A model that has made local steps on every document: in each round every shard starts from the last weights, and their mean, by tokens, follows.

    Rounds and shards are dealt by a hash of doc_id and text and learned from in the order of it, so the model depends on the rows, not on how
    they are partitioned or on how many tasks run.  Tasks add up the weights of their shards, so what is gathered grows with the
    input, and is summed in slices in a shuffle.  Only outputs (two bytes a token) are shuffled, never texts.  Of shards that rows with one doc_id and text
    overfill, several parts follow each other.
    """
    scratch = Scratch(docs.sparkSession)
    spark = docs.sparkSession
    model = head.gru()
    names, end = sorted(model.p), int(head.place[head.end])
    heads = spark.sparkContext.broadcast(head)
    shards = max(1, round(head.n / rounds / shard))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = heads.value
        for b in batches:
            ids = [own.ids(words)[0].astype("<u2").tobytes() for words in word_hashes(_texts(b))]
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array(ids, pa.binary())], names=["hash", "ids"])

    key = F.xxhash64("doc_id", "text", F.lit(13)).alias("hash")
    part = F.pmod("hash", F.lit(rounds * shards))
    coded = scratch.written(docs.select(key, "text").mapInArrow(encode, "hash long, ids binary").select("hash", "ids", (part % rounds).cast("int").alias("round"), F.floor(part / rounds).cast("int").alias("shard")), "coded")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=RATE / (1 + k)) -> Iterator[pa.RecordBatch]:
            total = {n: np.zeros(v.shape) for n, v in sent.value.p.items()}
            weight, at, held, size, own = 0, None, [], 0, None

            def run() -> None:
                nonlocal held, size
                if held:
                    own.run(held, end, rate)
                held, size = [], 0

            def close() -> None:
                nonlocal weight
                run()
                if own:
                    weight += own.seen
                    for n in names:
                        total[n] += own.seen * own.p[n].astype(np.float64)

            for b in batches:
                for s, raw in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                    if s != at:
                        close()
                        at, own = s, sent.value.copy()
                    ids = np.frombuffer(raw, "<u2").astype(np.int64)
                    held += [ids[i : i + PIECE] for i in range(0, len(ids), PIECE)]
                    size, own.seen = size + len(ids), own.seen + len(ids)
                    if size > 4 * shard:
                        run()
            close()
            if weight:
                parts = np.array_split(np.concatenate([total[n].ravel() for n in names]), 32)
                yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([weight] * 32, pa.int64()), pa.array([x.astype("<f8").tobytes() for x in parts], pa.binary())], names=["slice", "weight", "w"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for s, weight, w in zip(*(c.to_pylist() for c in b.columns)):
                    held = sums.setdefault(s, [0, 0.0])
                    held[0] += weight
                    held[1] = held[1] + np.frombuffer(w, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in sums.values()], pa.binary())], names=["slice", "w"])

        tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
        dealt = coded.where(F.col("round") == k).repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "hash", "ids").select("shard", "ids")
        rows = dealt.mapInArrow(learn, "slice int, weight long, w binary").repartition("slice").mapInArrow(average, "slice int, w binary").collect()
        if rows:
            flat, at = np.concatenate([np.frombuffer(r.w, "<f4") for r in sorted(rows, key=lambda r: r.slice)]), 0
            model = model.copy()
            for n in names:
                model.p[n] = flat[at : at + model.p[n].size].reshape(model.p[n].shape).copy()
                at += model.p[n].size
    scratch.clear()
    return model


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text of docs; null counts as empty.

    train (doc_id, text) gives the counts and the model, both from all its rows.  The model spells a word
    outside its vocabulary as the shared output times the word's smoothed count among such words, so its probabilities of all
    words, and one unknown one, sum to 1.  Counts of words outside the head are joined, not broadcast.

    Every row is scored for itself: repeated rows, null doc_ids and empty texts (one token, the end) too.  Without training rows the
    model is uniform over its two outputs and train_tokens is 0; an empty docs gives no rows.
    """
    spark = docs.sparkSession
    counts = written(count_words(train), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts that differ by less than a ninth share a class, so there are a few hundred classes; the head has whole ones
    least, room = 1 << 62, HEAD
    kind = F.floor(8 * F.log2("c")).cast("int")
    for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect():
        room -= r.n
        if room < 0:
            break
        least = r.c
    is_end = F.col("h") == int(END)
    frequent = counts.where(((F.col("c") >= least) | is_end) & F.lit(n > 0)).toArrow()
    head = Head(np.array(frequent.column("h"), np.int64), np.array(frequent.column("c"), np.int64), n, v)
    heads = spark.sparkContext.broadcast(head)
    models = spark.sparkContext.broadcast(fit(train, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, model = heads.value, models.value
        logs = np.log10(head.counts + 1.0)
        rest = np.log10(head.rest_n + head.rest_v + 1.0)

        def flush(held: list[tuple]) -> pa.RecordBatch:
            got = model.run([h[3] for h in held], int(head.place[head.end])) / LOG10
            rows, doc_id, found, _, words, n = zip(*held)
            base, known, spelled, rare, times = [], [], got.copy(), [], []
            for k, (at, w) in enumerate(zip(found, words)):
                some = at[at >= 0]
                end = head.counts[head.end] if head.end < len(head.counts) else 0
                base.append(float(logs[some].sum() + np.log10(end + 1.0)))
                known.append(len(some) + int(end > 0))
                outside = some[some >= head.tail]
                spelled[k] += logs[outside].sum() - rest * (len(outside) + len(at) - len(some))
                h, c = np.unique(w[at < 0], return_counts=True)
                rare.append(h.view(np.int64))
                times.append(c)
            kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((rows, doc_id, n, known, base, spelled, rare, times), kinds)], names=[x for x, _ in kinds])

        held, size = [], 0
        for b in batches:
            for row, doc_id, words in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), word_hashes(_texts(b))):
                ids, at = head.ids(words)
                held.append((row, doc_id, at, ids, words, len(words) + 1))
                size += len(ids)
                if size > GATHER:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = written(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"), "scored")
    # words outside the head: rare in the training rows, or absent from them
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    met = rare.join(counts.where((F.col("c") < least) & ~is_end), "h").groupBy("row").agg(F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = done.drop("rare", "times").join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    smooth = float(np.log10(n + v + 1.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * smooth).alias("base_score"), (F.col("score") + more).alias("score"))
