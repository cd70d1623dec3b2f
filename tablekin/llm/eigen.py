"""Leading eigenpairs of a symmetric matrix, step by step: tridiagonal form, eigenvalues, eigenvectors.

Householder reflections make the matrix tridiagonal, counts of sign changes (Sturm) bisect the leading
eigenvalues, and inverse iteration finds the eigenvectors, which are made orthogonal to earlier ones of
the same cluster in every round and carried back through the reflections.
"""

import numpy as np

EPS = np.finfo(float).eps
# eigenvalues closer than this share of the norm form a cluster
CLUSTER = 1e-3
ROUNDS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections, first one first."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors: list[np.ndarray | None] = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= EPS * EPS * length or not length:
            mirrors.append(None)
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        edge = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = edge
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each of the given numbers: the negative pivots of T - at."""
    tiny = np.finfo(float).tiny / EPS
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[k] - at - off[k - 1] * (off[k - 1] / pivot)
        count += pivot < 0
    return count


def norm(diagonal: np.ndarray, off: np.ndarray) -> float:
    padded = np.abs(np.concatenate([[0.0], off, [0.0]]))
    return float((np.abs(diagonal) + padded[:-1] + padded[1:]).max())


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval has no number inside."""
    n, bound = len(diagonal), norm(diagonal, off)
    low, high = np.full(k, -bound), np.full(k, bound * (1 + 4 * EPS) + np.finfo(float).tiny)
    place = n - np.arange(k)  # eigenvalue j is the first with that many at or under it
    for _ in range(1100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all() or (high - low <= EPS * EPS * bound).all():
            break
        enough = below(diagonal, off, middle) >= place
        high, low = np.where(enough, middle, high), np.where(enough, low, middle)
    return low + (high - low) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, at: float, least: float) -> list[tuple]:
    """T - at as rows of an upper triangle with three diagonals, with the row exchanges that led there."""
    n = len(diagonal)
    rows = []
    head, side = diagonal[0] - at, off[0] if n > 1 else 0.0
    for k in range(n - 1):
        under, own, after = off[k], diagonal[k + 1] - at, off[k + 1] if k + 2 < n else 0.0
        if abs(under) > abs(head):
            ratio = head / under
            rows.append((under, own, after, True, ratio))
            head, side = side - ratio * own, -ratio * after
        else:
            head = head if abs(head) > least else least
            ratio = under / head
            rows.append((head, side, 0.0, False, ratio))
            head, side = own - ratio * side, after
    rows.append((head if abs(head) > least else least, 0.0, 0.0, False, 0.0))
    return rows


def _solved(rows: list[tuple], right: np.ndarray) -> np.ndarray:
    x = right.copy()
    for k, (_, _, _, swapped, ratio) in enumerate(rows[:-1]):
        if swapped:
            x[k], x[k + 1] = x[k + 1], x[k]
        x[k + 1] -= ratio * x[k]
    for k in range(len(x) - 1, -1, -1):
        head, first, second, _, _ = rows[k]
        if k + 1 < len(x):
            x[k] -= first * x[k + 1]
        if k + 2 < len(x):
            x[k] -= second * x[k + 2]
        x[k] /= head
        if abs(x[k]) > 1e200:
            x /= abs(x[k])
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as rows, for falling eigenvalues."""
    bound = norm(diagonal, off) or 1.0
    random = np.random.default_rng(len(diagonal))
    found = np.zeros((len(values), len(diagonal)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * bound:
            first, shift = j, np.inf
        # equal eigenvalues are taken slightly apart
        shift = min(value, shift - 10 * EPS * bound)
        rows = _factors(diagonal, off, shift, EPS * bound * 1e-3)
        x = random.standard_normal(len(diagonal))
        for _ in range(ROUNDS):
            for _ in range(2):
                x -= found[first:j].T @ (found[first:j] @ x)
            x /= np.abs(x).max()
            x = _solved(rows, x)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= found[first:j].T @ (found[first:j] @ x)
            x /= np.linalg.norm(x)
        found[j] = x
    return found


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit eigenvectors as rows; the largest entry of each is positive."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((0, len(matrix)))
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        if v is not None:
            vectors[:, at + 1:] -= 2 * np.outer(vectors[:, at + 1:] @ v, v)
    signs = np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])
    return values * scale, vectors * signs[:, None]
