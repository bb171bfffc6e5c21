"""Byte-level BPE over overlapping chunks: parallel pre-tokens, stitched where their boundaries meet again."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the vocabulary's tokenizer, with possessive runs: the same matches, without backtracking.
POSSESSIVE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; the file is part of the installed tokenizers, on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Ids of single pre-tokens; the cache holds at most `cache` of them."""

    def __init__(self, ranks_path: str, cache: int = 200_000) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(POSSESSIVE_PATTERN)
        ranks = read_ranks(ranks_path)
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=POSSESSIVE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = {i: b for b, i in ranks.items()}
        self.known: dict[str, list[int]] = {}
        self.cache = cache

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.plain.encode_ordinary(text)
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[text] = ids
        return ids

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the pre-tokens in characters, ids up to each end, ids."""
        words = self.pattern.findall(text)
        ids = [self.piece(w) for w in words]
        ends, upto = np.cumsum([len(w) for w in words], dtype=np.int64), np.cumsum([len(x) for x in ids], dtype=np.int64)
        return ends, upto, np.array([i for x in ids for i in x], np.int64)

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        text = " ".join(map(str, ids)).encode()
        raw = self.plain.decode_bytes(ids)
        return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(raw).hexdigest()


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]], encoder: Encoder) -> list[int]:
    """The ids of a text from its chunks (start, text, ends, ids up to each end, ids) in order.

    A chunk's last two pre-tokens may be cut short and are not trusted, unless it is the last.  From a boundary that both
    of two chunks have, both go on alike, as no match looks back: there the later one takes over.  Where no boundary
    of the overlap is shared, the later text is joined to the unfinished rest and pre-tokenised anew.
    """
    out: list[np.ndarray] = []
    start, text, ends, upto, ids = chunks[0]
    ends = ends + start
    begin, taken = 0, 0  # where the current chunk's part begins in the text, and its first id
    for k in range(1, len(chunks) + 1):
        if k == len(chunks):
            out.append(ids[taken:])
            break
        sure = ends[:-2]
        nstart, ntext, nends, nupto, nids = chunks[k]
        nends = nends + nstart
        both = np.intersect1d(sure[sure > begin], nends[:-2] if k + 1 < len(chunks) else nends)
        if len(both):
            cut = both[0]
            i, j = np.searchsorted(ends, cut), np.searchsorted(nends, cut)
            out.append(ids[taken : upto[i]])
            start, text, ends, upto, ids, begin, taken = nstart, ntext, nends, nupto, nids, cut, nupto[j]
        else:
            i = int(np.searchsorted(ends, sure[sure > begin][-1])) if (sure > begin).any() else -1
            if i >= 0:
                out.append(ids[taken : upto[i]])
                begin = int(ends[i])
            text = text[begin - start :] + ntext[start + len(text) - nstart :]
            start, taken = begin, 0
            ends, upto, ids = encoder.chunk(text)
            ends = ends + start
    return np.concatenate(out).tolist()


def _packed(numbers: np.ndarray, rising: bool) -> bytes:
    """Small bytes for the shuffle; rising numbers as their steps."""
    steps = np.diff(numbers, prepend=0) if rising else numbers
    return zlib.compress(steps.astype("<i4").tobytes(), 1)


def _unpacked(raw: bytes, rising: bool) -> np.ndarray:
    numbers = np.frombuffer(zlib.decompress(raw), "<i4").astype(np.int64)
    return np.cumsum(numbers) if rising else numbers


def encode_digests(docs: DataFrame, ranks_path: str, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; null counts as empty.

    Texts of up to one chunk are encoded where they are read.  Longer ones are cut into overlapping chunks, which are
    pre-tokenised and encoded in parallel, then gathered per text and stitched.  Repeated rows give a row each.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    short, long = rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path)
        for b in batches:
            found = [encoder.digests(encoder.plain.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            n, ids, raw = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path)
        for b in batches:
            found = [encoder.chunk(t) for t in b.column("text").to_pylist()]
            packed = [pa.array([_packed(x[i], i < 2) for x in found], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *packed], names=["row", "doc_id", "start", "text", "ends", "upto", "ids"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        global _encoder
        if globals().get("_encoder") is None:
            _encoder = Encoder(ranks_path)
        group = group.sort_values("start")
        unpacked = [[_unpacked(x, c != "ids") for x in group[c]] for c in ("ends", "upto", "ids")]
        ids = stitch(list(zip(group["start"].tolist(), group["text"].tolist(), *unpacked)), _encoder)
        doc_id = group["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), **{c: [v] for c, v in zip(("n_tokens", "ids_sha256", "decoded_sha256"), _encoder.digests(ids))}})

    parts = F.expr(f"transform(sequence(0, length(text) - 1, {chunk}), s -> struct(bigint(s) AS start, substring(text, s + 1, {chunk + overlap}) AS text))")
    cut = long.select("row", "doc_id", F.explode(parts).alias("part")).select("row", "doc_id", "part.start", "part.text")
    pieces = cut.repartition("row", "start").mapInArrow(pre_tokens, "row long, doc_id long, start long, text string, ends binary, upto binary, ids binary")
    return short.mapInArrow(whole, schema).unionByName(pieces.groupBy("row").applyInPandas(join, schema))
