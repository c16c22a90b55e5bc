"""Hashed word shingles of whole texts, with numpy.

Words are runs of characters other than space and U+0009..U+000D, A-Z lower-cased. A word's hash is a random
polynomial in its bytes, taken for all words at once from one running sum; a shingle's is a mix of its
words' hashes. All hashes have 64 bits: two of a corpus of 1e9 different shingles collide with a probability
of about 3 %, and a collision only matters where it tips a comparison."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
BASE = 0x9E3779B97F4A7C15


@functools.cache
def constants(folded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """(random word of each byte, whether a byte is white space, factor of each place in a shingle, 1 / BASE)."""
    words = np.random.default_rng(85).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if folded:
        words[65:91] = words[97:123]  # A-Z as a-z
    white = np.zeros(256, dtype=bool)
    white[[32, *range(9, 14)]] = True
    factors = np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return words, white, factors, np.uint64(pow(BASE, -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, constants()[3], dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    words, white, _, _ = constants()
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = white[buffer]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(1 << max(16, (len(buffer) + 1).bit_length()))
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(words[buffer] * up[: len(buffer)], out=sums[1:])
    h = mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    return h, bounds


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: the whole sequence as one if it has fewer words."""
    factors = constants()[2]
    h, bounds = word_hashes(texts)
    whole = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        whole += h[k : k + len(whole)] * factors[k]
    whole = mixed(whole)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            found.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            part = (h[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True)
            found.append(mixed(part + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, dtype=np.uint64))
    return found
