"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_KEPT = 25_000
_known: dict[bytes, int] = {}
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lowered: runs of anything but blank, tab, line feed, vertical tab, form feed, return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word.  A worker remembers the words it has met."""
    found = list(map(_known.get, words))
    if None in found:
        if len(_known) >= _KEPT:
            _known.clear()
        for w in {w for w, h in zip(words, found) if h is None}:
            _known[w] = xxhash.xxh3_64_intdigest(w)
        found = [xxhash.xxh3_64_intdigest(w) if h is None and w not in _known else _known[w] if h is None else h for w, h in zip(words, found)]
    return np.array(found, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words; by doubling, so that long runs cost a few passes."""
    if len(h) < size:
        return h[:0]
    part, length, done, out = h, 1, 0, None
    while True:
        if size & length:
            piece = part[done : done + len(h) - size + 1]
            out = piece if out is None else mixed(out * np.uint64(_ODD)) + piece
            done += length
        if done == size:
            return mixed(out)
        step = np.uint64(pow(_ODD, length + 2, 1 << 64))
        part = mixed(part[:-length] * step) + part[length:]
        length *= 2


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct runs of `size` words, ascending; shorter texts are one run, texts without words have none."""
    h = hashes(split(text))
    return np.unique(runs(h, min(size, len(h)))) if len(h) else h
