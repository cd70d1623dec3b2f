"""Exact products of whole-number matrices by Strassen's recursion."""

import numpy as np

from tablekin.llm.common import shipped

shipped(__name__)

# a side of this length or less is multiplied directly
LEAF = 32


def _halvings(sides: tuple[int, ...]) -> int:
    levels, least = 0, min(sides)
    while least > LEAF:
        least = -(-least // 2)
        levels += 1
    return levels


def _padded(a: np.ndarray, multiple: int) -> np.ndarray:
    rows, columns = (-side % multiple for side in a.shape)
    return np.pad(a, ((0, rows), (0, columns))) if rows or columns else a


def _product(a: np.ndarray, c: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ c.T
    m, n, d = len(a) // 2, len(c) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    # quarters of the transposed second factor
    b11, b12, b21, b22 = c[:n, :d], c[n:, :d], c[:n, d:], c[n:, d:]
    levels -= 1
    p1 = _product(a11 + a22, b11 + b22, levels)
    p2 = _product(a21 + a22, b11, levels)
    p3 = _product(a11, b12 - b22, levels)
    p4 = _product(a22, b21 - b11, levels)
    p5 = _product(a11 + a12, b22, levels)
    p6 = _product(a21 - a11, b11 + b12, levels)
    p7 = _product(a12 - a22, b21 + b22, levels)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def inner_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``c``, int64 matrices of equal width.

    Sides are padded with zeros until they can be halved down to LEAF. Sums inside may pass the
    bounds of int64 and wrap; products that fit are exact all the same, as the recursion only adds,
    subtracts and multiplies, which holds modulo 2^64.
    """
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    levels = _halvings((*a.shape, len(c)))
    out = _product(_padded(a, 1 << levels), _padded(c, 1 << levels), levels)
    return out[:len(a), :len(c)]
