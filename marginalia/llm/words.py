"""Words of UTF-8 texts as numpy arrays of hashes, without a Python object per word."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes of one text hashed at once.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(SLICE + 1, _BASE, np.uint64), np.full(SLICE + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the runs that make up an array of integers; the second also knows lengths and first items."""
    up, _ = _powers()
    sizes = ends - starts
    weights = up[(np.arange(len(codes)) - np.repeat(starts, sizes)) % SLICE]
    own = codes.astype(np.uint64) + np.uint64(1)
    grown = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    first, second = (mix(np.add.reduceat(x * weights, starts) + grown) for x in (own, mix(own)))
    return first, mix(second ^ own[starts] << np.uint64(32))


def _hashes(data: np.ndarray) -> np.ndarray:
    up, down = _powers()
    solid = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the text, in order. A word longer than a slice is hashed by its own."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SLICE:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + SLICE)
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:  # one word fills the slice: hash it piece by piece up to its end
                end = stop
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
                pieces = [_hashes(data[i : min(i + SLICE, end)]) for i in range(at, end, SLICE)]
                parts.append(mix(np.bitwise_xor.reduce(np.concatenate([p * np.uint64(2 * i + 3) for i, p in enumerate(pieces)]), keepdims=True)))
                at = end
                continue
        parts.append(_hashes(data[at:stop]))
        at = stop
    return np.concatenate(parts)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - n + 1 + i]
    return mix(out)


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the index of its first smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:n].copy(), np.arange(n)
    for i in range(1, width):
        less = values[i : n + i] < best
        best[less] = values[i : n + i][less]
        at[less] = np.flatnonzero(less) + i
    return at
