"""The perfect binary Golay code of 23 bits, used to hash words with errors.

Every word of 23 bits lies within three bits of exactly one codeword. `near_codewords` gives the codewords within four
bits of a word: one for words at most two bits from their codeword, six for the others. Two words that differ in at
most two bits share one of these codewords (tests check all cases), so the 12 message bits of a codeword serve as a hash
key that survives two errors.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator polynomial of the code.
GENERATOR = 0b110001110101
BITS, MESSAGE_BITS, CHECK_BITS = 23, 12, 11
KEYS = 6


def remainder(word: int) -> int:
    """The word modulo the generator polynomial: zero for codewords."""
    for shift in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits, and by remainder the errors of at most four bits (padded with -1)."""
    low = np.array([remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int32)
    errors: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            error = sum(1 << p for p in places)
            errors[int(low[error & 0xFFF] ^ high[error >> 12])].append(error)
    table = np.full((1 << CHECK_BITS, KEYS), -1, np.int32)
    for syndrome, found in enumerate(errors):
        table[syndrome, : len(found)] = found
    return low, high, table


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Message bits of the codewords within four bits of each word; n x 6, -1 where there are fewer."""
    low, high, table = tables()
    words = words.astype(np.int32)
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
