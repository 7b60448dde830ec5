"""Word shingles as numbers, for Arrow batches: sets of 64-bit hashes, and minhash signatures."""

from __future__ import annotations

import hashlib

import numpy as np

try:
    from _md5 import md5  # a third of the time that hashlib's takes for a few words
except ImportError:
    from hashlib import md5

PRIME = 2**31 - 1
_STEP = 64  # shingles at a time, so that their products stay in the processor's cache


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered; emptied when it holds `most` of them."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def shingle_set(text: str, words: Words, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-case text's words; none for shorter texts."""
    w = text.split()
    n = len(w) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    s = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k])
    s.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def minhash_of(text: str, size: int, perms: int) -> np.ndarray | None:
    """perms least values of (a h + b) mod PRIME over the first 28 bits of the shingles' md5; None for shorter texts."""
    w = text.split()
    if len(w) < size:
        return None
    got = b"".join([md5(s.encode("utf-8", "surrogatepass")).digest()[:4] for s in set(map(" ".join, zip(*(w[k:] for k in range(size)), strict=False)))])
    h = np.frombuffer(got, dtype=">u4").astype(np.uint64) >> np.uint64(4)
    k = np.arange(1, perms + 1, dtype=np.uint64)[:, None]
    a, b, p, least = k * np.uint64(7919) + np.uint64(12345), k * np.uint64(104729), np.uint64(PRIME), None
    for at in range(0, len(h), _STEP):
        x = h[at : at + _STEP] * a
        x += b
        y = x >> np.uint64(31)
        x &= p
        x += y
        np.subtract(x, p, out=y)  # wraps round where x is less than the prime already
        m = np.minimum(x, y, out=x).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return least
