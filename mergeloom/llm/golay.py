"""The perfect binary Golay code (23, 12): which codewords lie near a word.

Every 23-bit word has exactly one codeword within distance 3. Let ``near(x)``
be all codewords within distance 4: that one, and five more if x is exactly 3
away from it, so 1 or 6. If x and y differ in at most 2 bits, some z lies
within 1 of both, and z's own codeword within 4 of both: near(x) and near(y)
meet. So a key for each codeword in near(x) finds all words within 2 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, DATA_BITS = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator polynomial.
GENERATOR = 0b110001110101
MOST = 6


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word after division by the generator."""
    rest = words.astype(np.int64)
    for shift in range(BITS - 1, 10, -1):
        rest = np.where(rest >> shift & 1, rest ^ (GENERATOR << (shift - 11)), rest)
    return rest


@cache
def errors() -> np.ndarray:
    """(2048, 6): for each syndrome all error patterns of weight up to 4; -1
    where there are fewer than six."""
    patterns = [sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(BITS), w)]
    table = np.full((1 << 11, MOST), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    for s, p in zip(syndrome(np.array(patterns)).tolist(), patterns, strict=True):
        table[s, filled[s]] = p
        filled[s] += 1
    return table


def near(words: np.ndarray) -> np.ndarray:
    """(n, 6): the indices, 0 to 4095, of the codewords within distance 4 of
    each 23-bit word; -1 where there are fewer than six."""
    patterns = errors()[syndrome(words)]
    return np.where(patterns < 0, -1, (words.astype(np.int64)[:, None] ^ patterns) >> 11)
