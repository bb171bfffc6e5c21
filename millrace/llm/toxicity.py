"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, other_columns, written
from .textvec import SLICE_BYTES, span_hashes

# Insults, and second-person words of the four languages.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown dumb filthy freak jerk ugly hate kill die shut".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre usted ustedes tú tus ti".split()

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_lower = bytes(range(256)).lower()
#: Lower case; punctuation is white space.
_PLAIN = bytes(32 if c in _PUNCTUATION else _lower[c] for c in range(256))
#: Lower case; digits and signs that stand for letters are these; other punctuation goes.
_LEETED = bytes(ord(_LEET[chr(c)]) if chr(c) in _LEET else _lower[c] for c in range(256))
_GONE = bytes(c for c in _PUNCTUATION if chr(c) not in _LEET)
#: Lengths in bytes of the word beginnings that a lexicon may hold beside whole words.
PREFIXES = (4, 5)
#: Words between an insult and a second-person word that count as near.
NEAR = 5
N_FEATURES = 20


def _parts(text: bytes) -> Iterator[bytes]:
    """Slices of about SLICE_BYTES that end at spaces, so that no word is cut."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = text.rfind(b" ", at, at + SLICE_BYTES)
        cut = text.find(b" ", at + SLICE_BYTES) if cut <= at else cut
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def _keys(text: bytes, lengths: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words' hashes, and those of their beginnings (0 for shorter words), of a whole text in order."""
    found = [span_hashes(part, lengths) for part in _parts(text)]
    return np.concatenate([w for w, _ in found]), [np.concatenate([f[k] for _, f in found]) for k in range(len(lengths))]


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([span_hashes(w.encode(), ())[0] for w in words]))


def _inside(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(table, found), len(table) - 1)
    return np.where(table[at] == found, at, -1)


def doc_keys(text: bytes) -> np.ndarray:
    """Distinct hashes of the words and beginnings of words of a text."""
    words, firsts = _keys(text.translate(_PLAIN))
    return np.unique(np.concatenate([words, *(f[f != 0] for f in firsts)]))


class Lexicon:
    """Learned keys with their log odds, beside the fixed insults and second-person words."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order]
        self.insults, self.second = _hashes(INSULTS), _hashes(SECOND_PERSON)

    def features(self, text: str) -> np.ndarray:
        """Of a whole text, with the distances of its words over all its length."""
        raw = text.encode("utf-8", "surrogatepass")
        words, firsts = _keys(raw.translate(_PLAIN))
        n, near, odds, top, strong, distinct = len(words), 0, 0.0, 0.0, 0, 0
        known = _inside(words, self.keys)
        at = known
        for f in firsts if len(self.keys) else []:
            other = _inside(f, self.keys)
            at = np.where((at < 0) | ((other >= 0) & (self.odds[other] > self.odds[at])), other, at)
        bad = at >= 0
        fixed = _inside(words, self.insults) >= 0
        you = np.flatnonzero(_inside(words, self.second) >= 0)
        hits, insults, second = int(bad.sum()), int(fixed.sum()), len(you)
        if hits:
            mine = self.odds[at[bad]]
            odds, top, strong, distinct = float(mine.sum()), float(mine.max()), int((mine > 3).sum()), len(np.unique(at[bad]))
        places = np.flatnonzero(bad | fixed)
        if len(you) and len(places):
            k = np.searchsorted(you, places)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - places), np.abs(you[np.maximum(k - 1, 0)] - places))
            near = int((gap <= NEAR).sum())
        leet, _ = _keys(raw.translate(_LEETED, _GONE), ())
        seen = int((_inside(leet, self.insults) >= 0).sum()) + int((_inside(leet, self.keys) >= 0).sum())
        hidden = max(0, seen - insults - int((known >= 0).sum()))
        size = max(1, len(raw))
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
        upper, lower = count[65:91].sum(), count[97:123].sum()
        marks = count[list(_PUNCTUATION)].sum()
        d = max(1, n)
        return np.array([
            np.log1p(n), hits, hits / d, odds, odds / d, top, strong, distinct, insults, insults / d, second / d, near, near / d,
            upper / max(1, upper + lower), marks / size, count[33] / size, count[48:58].sum() / size, hidden, hidden / d, count[128:].sum() / size,
        ])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Logistic boosting of complete binary trees over quantile bins, split by the second-order gain."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.n):
            p = _sigmoid(score)
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, value = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    mine = np.flatnonzero(node == k)
                    best = 1e-9
                    if len(mine) > 1:
                        gs, hs = g[mine].sum(), h[mine].sum()
                        for f, c in enumerate(cuts):
                            gl = np.cumsum(np.bincount(binned[mine, f], g[mine], len(c) + 1))[:-1]
                            hl = np.cumsum(np.bincount(binned[mine, f], h[mine], len(c) + 1))[:-1]
                            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                            gain[(hl < self.least) | (hs - hl < self.least)] = 0
                            if len(gain) and gain.max() > best:
                                best, feature[k], value[k] = gain.max(), f, c[gain.argmax()]
                    node[mine] = 2 * k + 1 + (x[mine, feature[k]] > value[k])
            leaf = node - ((1 << self.depth) - 1)
            w = -np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.l2) * self.rate
            self.trees.append((feature, value, w))
            score += w[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, value, w in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > value[node])
            out += w[node - len(feature)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (mean score, mean label) of the increasing step function, the means by weight."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order]):
        blocks.append([s * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2] + a[2]]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margin(np.stack([self.lexicon.features(t) for t in texts]))
        # a trace of the margin keeps the order within a step
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 * _sigmoid(margin), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, terms: int = 1 << 16) -> Model | None:
    """A model from the rows of docs (doc_id, text) and labels (doc_id, toxic 0 or 1); None unless both labels occur.

    About sample / 2 rows of each label are drawn by a hash of doc_id, so the drawn labels are few and are broadcast: texts
    are never shuffled.  Half of them give the lexicon: the `terms` keys of most toxic texts among those at least
    eight times as frequent in toxic texts, in at least three of them.  A third gives the trees, the rest the calibration,
    whose rows weigh the inverse of their label's rate of sampling: a score is a probability at the labels' true shares.
    Of rows that share a doc_id the largest text counts, of their labels the largest; null doc_ids and other labels are left out.
    """
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = {t: min(1.0, sample / 2 / n) for t, n in sizes.items()}
    rate = F.when(F.col("toxic") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(12)).cast("int")
    likely = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(chance < max(rates.values()))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(chance < rate)
    drawn = likely.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    drawn = written(drawn.withColumn("fold", fold), "drawn")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                found = doc_keys((text or "").encode("utf-8", "surrogatepass")).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), toxic, np.int32)), pa.array(found)], names=["toxic", "key"])

    half = drawn.where("fold < 6")
    n = {r.toxic: r["count"] for r in half.groupBy("toxic").count().collect()}
    counted = half.mapInArrow(keys, "toxic int, key long").groupBy("key").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("no") + 0.5) / (n.get(0, 0) + 1))
    found = counted.withColumn("odds", odds).where((F.col("odds") > float(np.log(8))) & (F.col("yes") >= 3)).orderBy(F.desc("yes"), F.desc("odds"), "key").limit(terms).collect()
    lexicon = Lexicon(np.array([r.key for r in found], np.int64).view(np.uint64), np.array([r.odds for r in found], float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.features(t or "").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("fold"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "fold", "x"])

    rest = drawn.where("fold >= 6")
    rows = sorted(rest.mapInArrow(features, "doc_id long, toxic int, fold int, x binary").collect(), key=lambda r: (r.doc_id, r.toxic))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, N_FEATURES)
    y, fold_of = np.array([r.toxic for r in rows], float), np.array([r.fold for r in rows])
    fit, cal = fold_of < 10, fold_of >= 10
    if not fit.any() or not cal.any():
        fit = cal = np.ones(len(y), bool)
    if not len(y):
        return None
    trees = BoostedTrees().fit(x[fit], y[fit])
    trees.base += float(np.log(rates[0] / rates[1]))  # from the sample's share of toxic rows to the true one
    return Model(lexicon, trees, isotonic(trees.margin(x[cal]), y[cal], 1 / np.where(y[cal] == 1, rates[1], rates[0])))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1; 0 without a model) and predicted (1 from threshold), which replace columns so named in any case.

    Every row, repeated ones and those without doc_id too, is scored by its text alone; null texts count as empty.  An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = other_columns(docs, "score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            s = m.scores(texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.select(*columns).mapInArrow(run, f"{schema}, score double, predicted int")


def learn_fold(labels: DataFrame) -> DataFrame:
    """The labels that toxicity may be learned from."""
    return labels.where(crc_mod(F.col("doc_id"), 3) != 1)
