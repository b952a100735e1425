"""Tokens of UTF-8 texts as Arrow byte strings, cut out of a task's bytes without a loop.

A table of 256 flags says which bytes stand between tokens (all of them ASCII, so a token
holds whole characters). Long documents are worked through in segments that end at such a
byte, so temporaries stay small whatever the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from driftgate.llm.common import ship

ship(__name__)

#: Bytes handled at once.
SEGMENT = 1 << 21
#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


def segments(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray, limit: int = SEGMENT):
    """Yield (first document, its documents' offsets in the segment, segment). A segment ends
    at a document's end or after a byte flagged in ``stop``; one without such a byte may be
    longer than ``limit``."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + limit)
        if b < n:
            ends = np.flatnonzero(stop[data[a:b]])
            edge = int(offsets[np.searchsorted(offsets, b, side="right") - 1])
            b_stop = a + int(ends[-1]) + 1 if len(ends) else a
            if max(b_stop, edge) > a:
                b = max(b_stop, edge)
            else:
                after = int(offsets[np.searchsorted(offsets, b, side="left")])
                while b < after:
                    ahead = np.flatnonzero(stop[data[b:min(after, b + limit)]])
                    if len(ahead):
                        b += int(ahead[0]) + 1
                        break
                    b = min(after, b + limit)
        lo = int(np.searchsorted(offsets, a, side="right")) - 1
        hi = max(lo + 1, int(np.searchsorted(offsets, b, side="left")))
        yield lo, np.clip(offsets[lo:hi + 1], a, b) - a, data[a:b]
        a = b


def tokens(piece: np.ndarray, own: np.ndarray, skip: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The maximal runs of bytes not flagged in ``skip``, A-Z lower-cased; where each starts;
    its document. No token spans two documents."""
    inside = ~skip[piece]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return pa.array([], pa.binary()), z, z
    cut = np.zeros(len(piece) + 1, bool)
    cut[own] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    start = np.flatnonzero(first)
    solid = FOLD[piece[inside]]
    rank = np.cumsum(inside, dtype=np.int32)
    ends = np.append(rank[start] - 1, len(solid)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(solid.tobytes())])
    return words, start, np.searchsorted(own, start, side="right") - 1


def hash64(values: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh3-64 of each value (one value at a time: call it on distinct ones)."""
    return np.fromiter((xxhash.xxh3_64_intdigest(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh3-64 of each word, computed once a distinct word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return hash64(coded.dictionary, seed)[np.asarray(coded.indices)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
