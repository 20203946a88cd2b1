"""The binary Golay code (23, 12, 7), vectorised: each 23-bit word is within 3 flips of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

N, K = 23, 12
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words after division by the generator: 11 bits."""
    rest = np.asarray(word, dtype=np.int64).copy()
    for bit in range(N - 1, N - K - 1, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - (N - K)), 0)
    return rest


@cache
def leaders() -> np.ndarray:
    """The error of at most 3 bits for each of the 2048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(N), n)], dtype=np.int64)
    out = np.zeros(1 << (N - K), dtype=np.int64)
    out[syndrome(errors)] = errors
    return out


def nearby(word: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) for each word: those that it and its 23 one-flip neighbours decode to, -1 filled.

    A word with an error of at most 2 bits has one index, others have six. Two words that differ in at most 2 bits
    have a one-flip neighbour (or themselves) in common, and so an index. The result has shape (words, 6).
    """
    word = np.asarray(word, dtype=np.int64)
    flips = np.concatenate([[0], 1 << np.arange(N, dtype=np.int64)])
    shifts = syndrome(flips)
    near = word[:, None] ^ flips[None, :]
    codes = (near ^ leaders()[syndrome(word)[:, None] ^ shifts[None, :]]) >> (N - K)
    codes.sort(axis=1)
    codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = -1
    codes = -np.sort(-codes, axis=1)
    return codes[:, :6]
