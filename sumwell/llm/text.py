"""Byte-level tokenising and hashing shared by the text operators.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; only A-Z are
lower-cased.  Both rules act on single ASCII bytes, so they hold on UTF-8
without decoding, and many texts are tokenised and hashed together by a
handful of numpy passes over a cache-sized slice instead of one Python call
per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts are joined into slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * _ODD[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _ODD[1]
    return x ^ (x >> np.uint64(31))


#: Hash that stands for the end of a text among word hashes.
END_HASH = mix(np.array([0xE0F], dtype=np.uint64))[0]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, b in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b))), dtype=np.uint64)
    return _POWERS


def word_edges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = (a != 32) & ((a - np.uint8(9)) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start offset of each word of a lower-cased UTF-8 text, in order.

    A polynomial hash over the word's bytes: prefix sums give every word's
    value by one subtraction, a power of the inverse base aligns it.
    """
    a = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_edges(a)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    power, inverse = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def encoded(text: str | None) -> bytes:
    """Lower-cased (A-Z) UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def word_slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, word hashes, offsets): text first + k has the words offsets[k] to offsets[k + 1]."""
    lo, size, parts = 0, 0, []

    def done(hi: int):
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        hashes, starts = word_hashes(b"\n".join(parts))
        return lo, hi, hashes, np.searchsorted(starts, begins)

    for i, text in enumerate(texts):
        b = encoded(text)
        if parts and size + len(b) > SLICE_BYTES:
            yield done(i)
            lo, size, parts = i, 0, []
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield done(len(texts))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    count = max(0, len(words) - n + 1)
    out = mix(words[:count] + np.uint64(n))
    for k in range(1, n):
        out = (out ^ words[k : k + count]) * _BASE
        out ^= out >> np.uint64(29)
    return out


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique's hash table is several times slower on hashes."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: Sequence[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes (uint64) of the n-word shingles of each text.

    A text with fewer words is one shingle, a text without words has none.
    """
    for lo, hi, words, off in word_slices(texts):
        runs = run_hashes(words, n)
        for k in range(hi - lo):
            a, b = off[k], off[k + 1]
            if b - a >= n:
                yield distinct_sorted(runs[a : b - n + 1])
            else:
                yield run_hashes(words[a:b], int(b - a)) if b > a else words[:0]
