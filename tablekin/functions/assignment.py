"""Best one-to-one column alignment of a table pair, as a small numpy helper."""

import numpy as np


def edge_matrix(left: np.ndarray, right: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Weights of an edge list as a matrix; missing edges weigh 0."""
    rows, r = np.unique(left, return_inverse=True)
    cols, c = np.unique(right, return_inverse=True)
    weights = np.zeros((len(rows), len(cols)))
    weights[r, c] = sim
    return weights


def upper_bound(weights: np.ndarray) -> float:
    """No alignment scores more than the best edges of all rows, or of all columns."""
    return float(min(weights.max(axis=1).sum(), weights.max(axis=0).sum()))


def best_alignment(weights: np.ndarray) -> float:
    """Largest total weight of a one-to-one alignment.

    Leaving a column alone counts as an edge of weight 0, so a full alignment of the
    shorter side is as good as any. Shortest augmenting paths with dual prices, one row
    at a time: O(rows^2 * columns).
    """
    if weights.shape[0] > weights.shape[1]:
        weights = weights.T
    best_col = weights.argmax(axis=1)
    if len(np.unique(best_col)) == len(best_col):
        return float(weights.max(axis=1).sum())
    n, m = weights.shape
    cost = weights.max() - weights
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        reach = np.full(m, np.inf)
        came_from = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, base, col = start, 0.0, -1
        while True:
            through = base + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach - 1e-15)
            reach[better], came_from[better] = through[better], col
            col = int(np.where(done, np.inf, reach).argmin())
            base = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        settled = np.flatnonzero(done & (row_of >= 0))
        row_price[start] += base
        row_price[row_of[settled]] += base - reach[settled]
        col_price[settled] -= base - reach[settled]
        while col >= 0:
            previous = came_from[col]
            row_of[col] = row_of[previous] if previous >= 0 else start
            col = previous
    used = np.flatnonzero(row_of >= 0)
    return float(weights[row_of[used], used].sum())
