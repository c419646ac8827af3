"""Arithmetic in GF(2^8), distribution matrices, and coding of byte strings with them."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The field's polynomial. Fixed value.
FIELD = 0x11D


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of 2, twice over, and logarithms."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (FIELD if x & 128 else 0)
    return exp, log


@cache
def products() -> np.ndarray:
    """[a][b]: a times b."""
    exp, log = _tables()
    table = exp[log[:, None] + log[None, :]].astype(np.uint8)
    table[0, :] = table[:, 0] = 0
    return table


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    exp, log = _tables()
    return int(exp[255 - log[a]])


def cauchy_rs(n: int, k: int) -> np.ndarray:
    """The systematic n x k matrix: the first k shares are the data."""
    m = n - k
    return np.array([[int(i == j) for j in range(k)] for i in range(k)] + [[inverse(i ^ (m + j)) for j in range(k)] for i in range(m)], np.uint8)


def cauchy_full(n: int, k: int) -> np.ndarray:
    """The n x k matrix no share of which is data."""
    return np.array([[inverse(i ^ (n + j)) for j in range(k)] for i in range(n)], np.uint8)


def invert(matrix: np.ndarray) -> np.ndarray:
    """The inverse of a square matrix; ValueError if there is none."""
    mul, k = products(), len(matrix)
    work = np.concatenate([matrix.astype(np.uint8), np.eye(k, dtype=np.uint8)], axis=1)
    for i in range(k):
        pivot = next((r for r in range(i, k) if work[r, i]), None)
        if pivot is None:
            raise ValueError("the matrix is singular")
        work[[i, pivot]] = work[[pivot, i]]
        work[i] = mul[inverse(int(work[i, i])), work[i]]
        for r in range(k):
            if r != i and work[r, i]:
                work[r] ^= mul[work[r, i], work[i]]
    return work[:, k:]


def times(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The matrix times rows of bytes."""
    mul = products()
    out = np.zeros((len(matrix), rows.shape[1]), np.uint8)
    for i, line in enumerate(matrix):
        for j, c in enumerate(line):
            if c == 1:
                out[i] ^= rows[j]
            elif c:
                out[i] ^= mul[c][rows[j]]
    return out
