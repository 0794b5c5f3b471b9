"""The perfect binary Golay code (23, 12): every 23-bit word lies within 3 bits of exactly one codeword.

Two words at most two bits apart have a common word at most one bit from each. So the codewords of a word and
of its one-bit neighbours, six at most, hold one that is also among those of any word up to two bits away.
"""

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11


def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32).copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        left ^= ((left >> bit) & 1) * np.uint32(GENERATOR << (bit - CHECK))
    return left


@lru_cache(1)
def tables(bits: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every segment of so many bits: its 12-bit codeword index; those of its one-bit neighbours; which are new."""
    patterns = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(LENGTH), n)], dtype=np.uint32)
    error = np.zeros(1 << CHECK, dtype=np.uint32)
    error[_syndrome(patterns)] = patterns
    words = np.arange(1 << bits, dtype=np.uint32)
    index = ((words ^ error[_syndrome(words)]) >> CHECK).astype(np.uint64)
    near = np.stack([index[words ^ np.uint32(1 << b)] for b in range(bits)], axis=1)
    new = near != index[:, None]
    for b in range(1, bits):
        new[:, b] &= (near[:, :b] != near[:, b : b + 1]).all(axis=1)
    return index, near, new
