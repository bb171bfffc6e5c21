"""Vectorised word and shingle hashing over UTF-8 byte buffers.

A word is a run of bytes other than the ASCII white space 0x20, 0x09-0x0D, after A-Z are lower-cased; this is the
tokenisation that every word-based operator of the subpackage shares.  All functions take whole texts: a text longer
than one slice is hashed slice by slice, cut at white space, and gives the same values as in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; the working arrays of a slice take about 40 times as much memory.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_SPACE_BYTES = b" \t\n\x0b\x0c\r"
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            forward, backward = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))
        _powers[size] = forward, backward
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a byte array that ends with white space."""
    low = _LOWER[raw]
    space = _SPACE[low]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    forward, backward = _power_table(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[low] * forward[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * backward[starts] + (ends - starts).astype(np.uint64)), starts


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = max(text.rfind(bytes([c]), at, at + SLICE_BYTES) for c in _SPACE_BYTES)
        if cut <= at:  # one word longer than a slice: take it whole
            found = [x for c in _SPACE_BYTES if (x := text.find(bytes([c]), at + SLICE_BYTES)) >= 0]
            cut = min(found, default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The 64-bit hashes of each text's words, in order; one array per text."""
    with np.errstate(over="ignore"):
        i = 0
        while i < len(texts):
            if len(texts[i]) > SLICE_BYTES:
                yield np.concatenate([_hash_words(np.frombuffer(part + b" ", np.uint8))[0] for part in _slices(texts[i])])
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= SLICE_BYTES:
                size += len(texts[j]) + 1
                j += 1
            raw = np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8)
            hashes, starts = _hash_words(raw)
            edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts[i:j])]))
            for a, b in zip(edges[:-1], edges[1:]):
                yield hashes[a:b]
            i = j


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; fewer words make one run, none makes an empty set."""
    with np.errstate(over="ignore"):
        n = len(words)
        if n == 0:
            return np.empty(0, np.uint64)
        span = min(width, n)
        out = np.full(n - span + 1, np.uint64(span), np.uint64)
        for k in range(span):
            out = mix(out * _M3 + words[k : n - span + 1 + k])
        return np.unique(out)


def span_hashes(text: bytes, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the words of one slice, and of their first bytes for each of lengths (0 where a word is shorter)."""
    with np.errstate(over="ignore"):
        raw = np.frombuffer(text + b" ", np.uint8)
        low = _LOWER[raw]
        space = _SPACE[low]
        inside = ~space
        starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
        ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
        forward, backward = _power_table(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[low] * forward[: len(raw)], out=total[1:])
        words = mix((total[ends] - total[starts]) * backward[starts] + (ends - starts).astype(np.uint64))
        firsts = []
        for n in lengths:
            stop = np.minimum(starts + n, ends)
            firsts.append(np.where(ends - starts >= n, mix((total[stop] - total[starts]) * backward[starts] + np.uint64(n + 1000)), np.uint64(0)))
        return words, firsts
