"""Word shingles and SetSketch registers in numpy.

A register is the truncated logarithm of the least of exponentially
distributed values: each element of a set sends a Poisson process of points
(value, register) to the registers, and only the least value of a register
counts. Values grow along an element's process, so an element is left as soon
as its value exceeds the largest register minimum of its set; a large set needs
about one or two points per element instead of one per element and register.
Sketches are mergeable by register maximum, and two sets agree in a register
with a probability close to their Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
WORD_MEMO = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.lower().split()


def word_digest(words: list[bytes]) -> bytes:
    """128-bit identity of a word sequence; no words: empty."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else b""


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the ``size``-word shingles; with fewer
    words, one key for the whole sequence; without words, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if len(_words) > WORD_MEMO:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total = mix(total * _GOLDEN + h[j:n - width + 1 + j])
    return np.unique(total)


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """(len(sets), registers) uint16; an empty set has only zeros."""
    n = len(sets)
    least = np.full(n * registers, np.inf)
    if n:
        sizes = np.fromiter(map(len, sets), np.int64, n)
        h = np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(n), sizes)
        x = np.zeros(len(h))
        grid = least.reshape(n, registers)
        step = 0
        while len(h):
            step += 1
            z = mix(h + np.uint64(step * int(_GOLDEN) % (1 << 64)))
            x -= np.log(((z >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0 ** -40) / (RATE * registers)
            reg = ((z & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)
            np.minimum.at(least, doc * registers + reg.astype(np.int64), x)
            keep = x < grid.max(axis=1)[doc]
            if not keep.all():
                h, doc, x = h[keep], doc[keep], x[keep]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / math.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16).reshape(n, registers)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows of
    ``a`` and ``b``) whose set sizes are known: the counts of registers that
    are greater, less and equal are multinomial given the similarity."""
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    c, ln = (BASE - 1) / BASE, math.log(BASE)

    def p(x):
        return -np.log1p(-c * x) / ln

    def slope(x):
        return c / (ln * (1.0 - c * x))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        up, down = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pu, pd = np.maximum(p(up), 1e-300), np.maximum(p(down), 1e-300)
        rest = np.maximum(1.0 - pu - pd, 1e-300)
        g = (-greater * v * slope(up) / pu - less * u * slope(down) / pd
             + equal * (v * slope(up) + u * slope(down)) / rest)
        low, high = np.where(g > 0, j, low), np.where(g > 0, high, j)
    return (low + high) / 2
