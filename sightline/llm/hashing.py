"""Vectorised hashes of words, word windows and byte windows of a text (numpy, 64 bits, equal in every process)."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number per byte, and an odd base; sums wrap at 64 bits.
_BYTES = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x, mask = 1, (1 << 64) - 1
    block = 1 << 10
    for i in range(min(block, n)):
        out[i] = x
        x = x * base & mask
    for lo in range(block, n, block):  # x is base ** block now
        out[lo:lo + block] = out[lo - block:lo][:min(block, n - lo)] * np.uint64(x)
    return out


_POWER = _powers(_BASE, _PIECE + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each number (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(raw: np.ndarray) -> np.ndarray:
    """Sums of byte number times power before each place; ``raw`` is at most a piece long."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _POWER[:len(raw)], out=out[1:])
    return out


def byte_windows(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes at every place where so many follow."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = _PIECE - width
    for lo in range(0, n, step):
        s = _sums(raw[lo:lo + step + width - 1])
        k = min(step, n - lo)
        out[lo:lo + k] = (s[width:width + k] - s[:k]) * _INVERSE[:k]
    return mix(out)


def words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, split at ASCII white space."""
    found = text.split()
    if not found:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(found), np.uint8)
    if len(raw) <= _PIECE:
        s = _sums(raw)
        starts = ends - lengths
        return mix((s[ends] - s[starts]) * _INVERSE[starts] + lengths.astype(np.uint64))
    out, lo = [], 0
    while lo < len(found):  # pieces of whole words; a longer word is hashed by itself
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PIECE, "right")))
        out.append(words(b" ".join(found[lo:hi])) if lengths[lo] <= _PIECE else _long(found[lo]))
        lo = hi
    return np.concatenate(out)


def _long(word: bytes) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(word)], np.uint64)


def shingles(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, sorted distinct shingles) of a text with A to Z in lower case; fewer words make one shingle."""
    w = words((text or "").encode().lower())
    if not len(w):
        return w, w
    if len(w) < size:
        h = np.array([len(w)], np.uint64)
        for x in w:
            h = mix(h * np.uint64(_BASE) + x)
        return w, h
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(_BASE) + w[k:n + k]
    return w, np.unique(mix(h))


def sequence(w: np.ndarray) -> int:
    """Hash of a whole sequence of word hashes as a signed long."""
    import xxhash

    return xxhash.xxh3_64_intdigest(w.tobytes()) - (1 << 63)
