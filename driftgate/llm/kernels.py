"""Vectorised fingerprints of byte strings and words (numpy, inside Spark tasks).

Whole words and lines are hashed by xxh3. For substrings, a prefix sum of ``T[byte] * B**i``
modulo 2**64 gives the fingerprint of any one in constant time; ``mix`` spreads it over all 64
bits. Such sums have known collisions between strings of 1,024 bytes and more (Thue-Morse
words), so only strings shorter than that may be compared by them.
"""

from __future__ import annotations

import numpy as np

from driftgate.llm.common import ship
from driftgate.llm.tokens import mix, segments, tokens, word_hashes

ship(__name__)

MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240607)
#: One random 64-bit number for each byte value.
T_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: ASCII white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept between calls)."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", BASE), ("inv", BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["inv"][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums, one more than the bytes."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T_BYTE[data] * p[:-1], out=out[1:])
    return out


def prints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end], equal for equal strings wherever they stand; the
    length goes in too."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes handled at once.
CHUNK = 1 << 19


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """xxh3-64 of the words (A-Z lower-cased) and their document numbers, in order."""
    out_h, out_d = [], []
    for lo, own, piece in segments(data, offsets, SPACE, CHUNK):
        found, _, doc = tokens(piece, own, SPACE)
        out_h.append(word_hashes(found))
        out_d.append(doc + lo)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)
