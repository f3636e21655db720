"""Words and shingles of whole texts as 64-bit hashes, by array operations over UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed at once: bounds the arrays a task holds, whatever a text's length.
SLICE = 1 << 20

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            more = np.full(max(n, 256), 0x9E3779B97F4A7C15, dtype=np.uint64)
            more[0] = 1
            _powers = np.multiply.accumulate(more)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of some bytes; A-Z count as a-z, words end at ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    starts = at[first]
    sizes = np.diff(first, append=len(at))
    inside = at - np.repeat(starts, sizes)
    h = np.add.reduceat(_BYTE[_LOWER[raw[at]]] * _power(int(sizes.max()))[inside], first)
    return mixed(h + sizes.astype(np.uint64)), starts, starts + sizes


def word_hashes(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of consecutive texts: hashes of their words, the words' byte bounds, and the words before each text.

    Texts are joined by a space and hashed a slice at a time; one text longer than a slice is cut at white space.
    Byte bounds count from the start of the word's own text.
    """

    def group(batch: list[bytes]):
        h, s, e = _hash_words(b" ".join(batch))
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
        before = np.searchsorted(s, begins)
        shift = np.repeat(begins[:-1], np.diff(before))
        return h, s - shift, e - shift, before

    batch, size = [], 0
    for t in texts:
        if size and size + len(t) > SLICE:
            yield group(batch)
            batch, size = [], 0
        if len(t) > SLICE:
            parts, at = [], 0
            while at < len(t):
                end = min(at + SLICE, len(t))
                while end < len(t) and not _SPACE[t[end]]:
                    end += 1
                h, s, e = _hash_words(t[at:end])
                parts.append((h, s + at, e + at))
                at = end
            h, s, e = (np.concatenate(x) for x in zip(*parts))
            yield h, s, e, np.array([0, len(h)])
        else:
            batch.append(t)
            size += len(t) + 1
    if batch:
        yield group(batch)


def shingle_sets(texts: Iterable[bytes], k: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; of one with fewer words that of the whole
    sequence; none without words."""
    for h, _, _, before in word_hashes(texts):
        n = len(h)
        full = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            full += h[j : j + len(full)] * _MIX[j]
        full = mixed(full)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= k:
                yield np.unique(full[a : b - k + 1])
            elif b > a:
                yield mixed(np.sum(h[a:b] * _MIX[: b - a], keepdims=True) + np.uint64(b - a))
            else:
                yield full[:0]


def set_class(hashes: np.ndarray) -> bytes:
    """A 128-bit name of a set of hashes; equal sets have equal names."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
