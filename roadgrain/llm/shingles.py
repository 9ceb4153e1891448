"""Word shingles as sorted sets of 64-bit hashes, worked out for many texts at once.

A word's hash is a polynomial of its bytes, read off one running sum over all texts; a shingle's
hash mixes the hashes of its words. A-Z are lower-cased; words are runs of anything but space, tab,
line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9DDFEA08EB382D69  # odd, so it has an inverse modulo 2**64
#: Bytes over which one running sum goes; a task holds about a dozen numbers for each.
SLICE = 1 << 18


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for every place of a slice."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(SLICE + 1, base, np.uint64)
        steps[0] = 1
        found.append(np.cumprod(steps))
    return found[0], found[1]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is white space; the lower-case byte plus one."""
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    return space, lower + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; a word of any length is summed slice by slice."""
    space, lower = tables()
    up, down = powers()
    raw = np.frombuffer(data, np.uint8)
    gap = space[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(raw) <= SLICE:
        return starts, _hashes(raw, starts, ends, lower, up, down)
    found = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # words whose ends lie within one slice of the first one's start
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, side="right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        if hi - lo > SLICE:  # one word longer than a slice
            part = np.uint64(hi - lo)
            for at in range(lo, hi, SLICE):
                piece = raw[at : min(at + SLICE, hi)]
                whole = _hashes(piece, np.array([0]), np.array([len(piece)]), lower, up, down)
                part = mix(np.array([part], np.uint64))[0] ^ whole[0]
            found[first] = part
        else:
            found[first:last] = _hashes(raw[lo:hi], starts[first:last] - lo, ends[first:last] - lo, lower, up, down)
        first = last
    return starts, found


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lower[raw] * up[: len(raw)])))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text has its whole sequence as one."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(data)
    starts, words = word_hashes(joined)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
    out = []
    wide = [np.uint64(2 * i + 1) for i in range(width)]
    salted = [mix(words * w + w) for w in wide]
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        n = b - a
        if n == 0:
            out.append(np.empty(0, np.uint64))
            continue
        size = min(n, width)
        total = salted[0][a : b - size + 1] * np.uint64(size)
        for i in range(1, size):
            total = mix(total + salted[i][a + i : b - size + 1 + i])
        out.append(np.unique(total))
    return out
