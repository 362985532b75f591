"""Hilbert keys of points, vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (n, m) with coordinates below 2 ** bits; m * bits <= 62.

    Level by level from the coarsest: the orthant's bits, read in Gray code, give the step along the curve; the axes of the
    lower levels are then exchanged or mirrored so that the curve enters and leaves where its neighbours expect.
    """
    x = cells.T.astype(np.uint64).copy()
    m = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(m):
            is_set = (x[i] & high) != 0
            flip = np.where(is_set, below, np.uint64(0))
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= flip ^ swap
            x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    carry = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[m - 1] >> np.uint64(level)) & one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= carry
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = key << one | (x[i] >> np.uint64(level)) & one
    return key.astype(np.int64)
