"""Words of a text (what lies between 0x20 and 0x09-0x0D) and their hashes."""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MULT
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def canonical(text: str) -> bytes:
    """UTF-8 words joined by one space."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def word_hashes(canon: bytes) -> np.ndarray:
    """64-bit hash of each word of a canonical text, by content alone."""
    if not canon:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(canon, np.uint8).astype(np.uint64)
    space = buf == 32
    starts = np.r_[0, np.flatnonzero(space) + 1]
    place = np.arange(len(buf)) - np.repeat(starts, np.diff(np.r_[starts, len(buf)]))
    power = np.cumprod(np.full(int(place.max()) + 1, MULT, np.uint64))
    return mix(np.add.reduceat(np.where(space, np.uint64(0), (buf + np.uint64(1)) * power[place]), starts))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * MULT + h[i:n + i])
    return out
