"""Vectorised word and window hashing shared by the Arrow-style operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All of these
separators are ASCII, so working on UTF-8 bytes gives exactly the words of the
text.  A word's hash adds up a scrambled value of each byte and its place; windows
of words are hashed by joining halves.  Neither is a polynomial modulo a power of
two, for which texts of two letters in the Thue-Morse order collide whatever the
base.  Equality of 64-bit hashes stands for equality of sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
CHUNK_BYTES = 1 << 20
#: Places of a word whose values are looked up; those of longer words are computed.
NEAR = 64


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit avalanche finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spread(x: np.ndarray) -> np.ndarray:
    """A value without arithmetic structure for a byte at a place (place << 8 | byte)."""
    x = (x + np.uint64(1)) * _ODD[0]
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(29))


_TABLE = _spread(np.arange(NEAR << 8, dtype=np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's first word's index (one more entry than texts)."""
    buf = b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    inside = (a > 32) | (a < 9) | ((a > 13) & (a < 32))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # Each byte's place in its word; what stands between words is never added up.
    place = np.arange(len(a), dtype=np.int32) - np.repeat(np.r_[0, start].astype(np.int32), np.diff(np.r_[0, start, len(a)]))
    value = _TABLE.take((np.minimum(place, NEAR - 1) << 8) | a)
    if (end - start).max() > NEAR:
        far = np.flatnonzero((place >= NEAR) & inside)
        value[far] = _spread((place[far].astype(np.uint64) << np.uint64(8)) | a[far])
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = mix(total[end] - total[start] + (end - start).astype(np.uint64) * _ODD[2])
    return h, np.searchsorted(start, first)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their two halves."""
    z = x * _ODD[0] + y * _ODD[1]
    z ^= z >> np.uint64(32)
    z *= _ODD[2]
    return z ^ (z >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of so many consecutive words, document borders ignored: by doubling windows."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        if width & size:  # the windows done are followed by those of this size
            out = part[:n] if out is None else _joined(out, part[done : done + n])
            done += size
        if done == width:
            return mix(out + np.uint64(width))
        part = _joined(part[:-size], part[size:])
        size *= 2


def sequence_hash(h: np.ndarray) -> int:
    """Hash of all words together, 0 for none."""
    if not len(h):
        return 0
    value = mix(h + np.arange(1, len(h) + 1, dtype=np.uint64) * _ODD[0]).sum(keepdims=True)
    return int(mix(value + np.array([len(h)], np.uint64) * _ODD[1]).view(np.int64)[0])


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Index of the first text and the texts of consecutive runs of about ``limit`` bytes; null is empty."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or b"")
        size += len(run[-1])
        if size >= limit:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def each_text(texts: list[bytes | None], lower: bool = False) -> Iterable[tuple[int, np.ndarray]]:
    """Index and word hashes of every text, hashed in runs of about CHUNK_BYTES."""
    for at, run in chunks(texts):
        h, first = word_hashes([t.lower() for t in run] if lower else run)
        for i in range(len(run)):
            yield at + i, h[first[i] : first[i + 1]]
