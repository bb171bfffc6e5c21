"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, other_columns, own_name

#: Hashed n-grams of each order share this many buckets.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters hashed at a time.
SLICE = 1 << 19
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Scale of relative frequencies, so that learning rates near 1 fit.
SCALE = 16.0


def _buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point but the last n - 1."""
    h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= points[k : len(points) - n + 1 + k] * _MULT[k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def _slices(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, code points with a 0 before each text and at the end, places of the zeros).

    A text longer than a slice comes alone, in several slices that overlap so that each n-gram is in one of them.
    """
    k = 0
    while k < len(texts):
        if len(texts[k]) > SLICE:
            low = texts[k].lower()
            for at in range(0, len(low), SLICE):
                part = low[max(0, at - max(ORDERS) + 1) : at + SLICE]
                # the characters before `at` only begin n-grams that reach past it
                yield -k - 1, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([min(at, max(ORDERS) - 1)])
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and size + len(texts[end]) <= SLICE:
            size += len(texts[end]) + 1
            end += 1
        joined = "\0" + "\0".join(t.lower().replace("\0", " ") for t in texts[k:end]) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield k, points, np.flatnonzero(points == 0)
        k = end


def _grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buckets of all its slice's n-grams, where each text's begin), for each slice and order."""
    with np.errstate(over="ignore"):
        for first, points, zeros in _slices(texts):
            for n in ORDERS:
                if len(points) < n:
                    continue
                found = _buckets(points, n)
                if first < 0:
                    skip = max(0, int(zeros[0]) - n + 1)
                    yield -first - 1, found[skip:], np.array([0])
                    continue
                blank = points == 0
                bad = blank[: len(found)].copy()
                for k in range(1, n):
                    bad |= blank[k : len(found) + k]
                upto = np.concatenate([[0], np.cumsum(~bad)])
                yield first, found[~bad], upto[np.minimum(zeros[:-1], len(found))]


def _doc_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their numbers of n-grams."""
    total = np.zeros(BUCKETS, np.int64)
    for _, found, _ in _grams([text]):
        total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _texts(b: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts and, for each bucket, of the texts that have it: over all rows, summed where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, flag = 0, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.uint8)
        for b in batches:
            texts = _texts(b, "text")
            n += len(texts)
            last = -1
            for first, found, starts in _grams_by_text(texts):
                if first != last:
                    df += flag
                    flag[:] = 0
                    last = first
                flag[found] = 1
            df += flag
            flag[:] = 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    df = np.zeros(BUCKETS, np.int64)
    n = 0
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return n, df


def _grams_by_text(texts: list[str]) -> Iterator[tuple[int, np.ndarray, None]]:
    """(text, its n-grams of all orders), in order of the texts; a long text in several parts."""
    held: dict[int, list[np.ndarray]] = {}
    lead = None
    for first, found, starts in _grams(texts):
        if first != lead:
            yield from ((k, np.concatenate(v), None) for k, v in held.items())
            held, lead = {}, first
        ends = np.append(starts[1:], len(found))
        if len(starts) == 1 and len(texts[first]) > SLICE:
            yield first, found, None
            continue
        for k, (a, z) in enumerate(zip(starts, ends)):
            held.setdefault(first + k, []).append(found[a:z])
    yield from ((k, np.concatenate(v), None) for k, v in held.items())


class Ftrl:
    """FTRL-proximal for softmax regression; l1 and l2 make the elastic net."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.zb, self.nb = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> np.ndarray:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias()
        p = softmax(x @ w + b)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.zb += p - (np.sqrt(self.nb + p * p) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += p * p


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """languages, idf * weights by bucket, bias and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.table, self.bias, self.temperature = languages, table.astype(np.float32), bias, temperature

    def logits(self, texts: list[str]) -> np.ndarray:
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, found, starts in _grams(texts):
            if not len(found):
                continue
            mine = slice(first, first + len(starts))
            size = np.diff(np.append(starts, len(found)))
            some = size > 0
            n[mine] += size
            part = np.zeros((len(starts), len(self.languages)))
            part[some] = np.add.reduceat(self.table[found], starts[some], axis=0)
            sums[mine] += part
        return SCALE * sums / np.maximum(n, 1)[:, None] + self.bias


def train(docs: DataFrame, sample: int = 3000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> Model | None:
    """A model from rows (doc_id, text, lang) with lang not null; None if there is no such row.

    idf counts all rows.  Weights are fitted on about `sample` rows, an equal share for each language, drawn by a hash of
    doc_id and text; a quarter of them is kept back to fit the temperature.
    """
    labelled = docs.where("lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    n, df = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    rate = F.lit(0.0)
    for lang, size in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(sample / len(sizes) / size)).otherwise(rate)
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_doc_counts(t) for t in _texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("fold"), pa.array([at.astype("<i4").tobytes() for at, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["lang", "fold", "at", "count"])

    drawn = labelled.where(chance < rate).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)).alias("fold"))
    rows = sorted(drawn.mapInArrow(features, "lang string, fold long, at binary, count binary").collect(), key=lambda r: (r.fold, r.lang))
    data = []
    for r in rows:
        at, count = np.frombuffer(r["at"], "<i4"), np.frombuffer(r["count"], "<i4")
        data.append((at, SCALE * count / max(1, count.sum()) * idf[at], languages.index(r.lang)))
    kept = [d for k, d in enumerate(data) if k % 4 == 3]
    fit = [d for k, d in enumerate(data) if k % 4 != 3]
    ftrl, order = Ftrl(len(languages), alpha, beta, l1, l2), np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(fit)):
            ftrl.step(*fit[k])
    w, bias = ftrl.weights(slice(None)), ftrl.bias()
    temperature = 1.0
    if kept:
        logits, y = np.array([x @ w[at] + bias for at, x, _ in kept]), np.array([y for *_, y in kept])
        loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return Model(languages, idf[:, None] * w, bias, temperature)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (calibrated, 0 to 1), which replace columns so named in any case; `und` and 0 for null texts, texts without a letter, or no model.

    Every row is told by its whole text alone, repeated rows and those without doc_id too; of languages that tie the first in order wins.  An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = other_columns(docs, "lang_pred", "score")
    letter = f"{own_name(docs)}letter"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, letters = _texts(b, "text"), b.column(letter).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            mine = [k for k, x in enumerate(letters) if x] if m else []
            if mine:
                p = softmax(m.logits([texts[k] for k in mine]) / m.temperature)
                for k, q in zip(mine, p):
                    lang[k], score[k] = m.languages[int(q.argmax())], float(q.max())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    has: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*columns, has.alias(letter)).mapInArrow(run, f"{schema}, lang_pred string, score double")


def learn_fold(docs: DataFrame) -> DataFrame:
    """The rows that a language may be learned from."""
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
