"""The smallest eigenpairs of sparse symmetric matrices without negative eigenvalues, such as a mesh's Laplacian, in numpy."""

from __future__ import annotations

import numpy as np

#: Up to so many rows the matrix is solved as a dense one.
DENSE = 300
#: Norm of a pair's residual, over the largest diagonal entry, at which it is found.
TOLERANCE = 1e-10


class Rows:
    """A symmetric matrix by rows, from entries that may repeat (they add up)."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        i, j, w = np.concatenate([i, j, np.arange(n)]), np.concatenate([j, i, np.arange(n)]), np.concatenate([w / 2, w / 2, np.zeros(n)])
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], w[order]
        new = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(i) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.n, self.i, self.j, self.w = n, i[at], j[at], np.add.reduceat(w, at) if len(at) else w
        self.first = np.searchsorted(self.i, np.arange(n + 1))

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[:, None] * x[self.j], self.first[:-1], axis=0)

    def diagonal(self) -> np.ndarray:
        return self.w[self.i == self.j]

    def beside(self, some: np.ndarray) -> np.ndarray:
        """The columns that the rows have entries in."""
        n = self.first[some + 1] - self.first[some]
        return np.unique(self.j[np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    def levels(self) -> list[np.ndarray]:
        """All rows in levels, of which each has entries with itself, the one before and the one after alone: by breadth from a far end."""
        left, out = np.ones(self.n, bool), []
        while left.any():
            start = np.flatnonzero(left)[:1]
            for final in (False, False, True):
                seen, front, found = left.copy(), start, []
                while len(front):
                    seen[front] = False
                    found.append(front)
                    near = self.beside(front)
                    front = near[seen[near]]
                if final:
                    out += found
                    left = seen
                start = found[-1][:1]
        return out


class Factor:
    """(A + shift) by levels: a block tridiagonal matrix, eliminated level after level. Holds two blocks for each level."""

    def __init__(self, a: Rows, shift: float) -> None:
        self.levels = a.levels()
        level, place = np.empty(a.n, int), np.empty(a.n, int)
        for k, rows in enumerate(self.levels):
            level[rows], place[rows] = k, np.arange(len(rows))
        order = np.argsort(level[a.i], kind="stable")
        ends = np.searchsorted(level[a.i][order], np.arange(len(self.levels) + 1))
        self.inverse, self.back = [], []
        for k, rows in enumerate(self.levels):
            at = order[ends[k] : ends[k + 1]]
            own, below = at[level[a.j[at]] == k], at[level[a.j[at]] == k - 1]
            block = np.zeros((len(rows),) * 2)
            block[place[a.i[own]], place[a.j[own]]] = a.w[own]
            block[np.diag_indices(len(rows))] += shift
            side = np.zeros((len(rows), len(self.levels[k - 1]) if k else 0))
            side[place[a.i[below]], place[a.j[below]]] = a.w[below]
            if k:
                block -= side @ self.inverse[-1] @ side.T
            self.back.append(side)
            self.inverse.append(np.linalg.inv(block))

    def solve(self, b: np.ndarray) -> np.ndarray:
        parts = []
        for k, rows in enumerate(self.levels):
            parts.append(b[rows] - (self.back[k] @ (self.inverse[k - 1] @ parts[-1]) if k else 0))
        out = np.empty_like(b)
        for k in range(len(self.levels) - 1, -1, -1):
            above = self.back[k + 1].T @ out[self.levels[k + 1]] if k + 1 < len(self.levels) else 0
            out[self.levels[k]] = self.inverse[k] @ (parts[k] - above)
        return out


def smallest(a: Rows, k: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenvalues, rising, and their vectors as columns.

    A space is grown by (A + shift)^-1 of what is left of the pairs found in it, all of a round at once, so equal
    eigenvalues are found as often as they are there. It begins with more random vectors than pairs are asked for.
    """
    if a.n <= max(DENSE, 2 * k):
        dense = np.zeros((a.n, a.n))
        dense[a.i, a.j] = a.w
        values, vectors = np.linalg.eigh(dense)
        return values[:k], vectors[:, :k]
    scale = float(np.abs(a.diagonal()).max()) or 1.0
    # The k-th eigenvalue of a surface is about k / n of the largest; the shift stays well below.
    inverse, wide = Factor(a, 0.1 * scale * k / a.n), k + k // 4 + 8
    q = np.linalg.qr(inverse.solve(np.random.default_rng(0).normal(size=(a.n, min(a.n, wide)))))[0]
    aq = a.times(q)
    for _ in range(rounds):
        values, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        turn = turn[:, :wide]
        x, ax = q @ turn, aq @ turn
        rest = ax[:, :k] - x[:, :k] * values[:k]
        bad = np.linalg.norm(rest, axis=0) > TOLERANCE * scale
        if not bad.any():
            break
        if q.shape[1] > 4 * wide:
            q, aq = x, ax
        new = inverse.solve(rest[:, bad])
        for _ in range(2):
            new = np.linalg.qr(new - q @ (q.T @ new))[0]
        q, aq = np.hstack([q, new]), np.hstack([aq, a.times(new)])
    return values[:k], x[:, :k]
