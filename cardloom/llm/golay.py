"""The binary Golay code (23, 12): any 23-bit word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the code's generator polynomial.
GENERATOR = 0b101011100011


def _parity(info: int) -> int:
    rest = info << 11
    for bit in range(22, 10, -1):
        if rest >> bit & 1:
            rest ^= GENERATOR << (bit - 11)
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """parity of each index; index bits of the error of each syndrome; how many keys; index offsets of the keys.

    A word at distance 3 from its codeword c lies at distance 4 from five more: c plus each codeword of weight 7
    that covers the three bits. A word nearer than 3 has none at distance 4. So a word has one key or six.
    """
    single = [_parity(1 << i) for i in range(12)]
    parity = np.zeros(4096, np.uint32)
    for i in range(12):
        parity[1 << i : 2 << i] = parity[: 1 << i] ^ single[i]
    words = (np.arange(4096, dtype=np.uint32) << 11) | parity
    heavy = [int(w) for w in words[np.bitwise_count(words) == 7]]
    error, count, offsets = np.zeros(2048, np.uint32), np.ones(2048, np.int64), np.zeros((2048, 6), np.uint32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = (e & 2047) ^ int(parity[e >> 11])
            error[s] = e >> 11
            if weight == 3:
                cover = [w >> 11 for w in heavy if w & e == e]
                offsets[s, 1:] = cover
                count[s] = 6
    return parity, error, count, offsets


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within distance 3."""
    parity, error, _, _ = tables()
    info = words >> 11
    return info ^ error[(words & 2047) ^ parity[info]]


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within distance 4: row numbers and indices, both flat."""
    parity, error, count, offsets = tables()
    info = words >> 11
    s = (words & 2047) ^ parity[info]
    n = count[s]
    row = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (info ^ error[s])[row] ^ offsets[s[row], nth]
