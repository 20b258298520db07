"""Eigendecomposition of a scatter matrix, kept up to date by rank-one updates.

``A + weight * v v'`` is ``Q (D + rho z z') Q'`` for the decomposition ``Q D Q'`` of ``A``. Its eigenvalues are the
roots of the secular equation ``1 + rho * sum(z_j**2 / (d_j - x)) = 0``, one behind each ``d_j``. Entries of ``z``
that are negligible, and all but one of those with equal ``d``, are deflated: their eigenvalues stay. The roots
are found by rational interpolation between the two nearest poles, bisecting where it leaves the bracket, as
distances from the nearer pole; ``z`` is then recomputed from the roots, which keeps eigenvectors orthogonal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots behind each of the rising, distinct ``d``, and the matrix of ``d_j - root_k``."""
    m = len(d)
    if m == 1:
        step = rho * z2
        return d + step, -step.reshape(1, 1)
    span = np.append(np.diff(d), rho * z2.sum())
    differences = d[:, None] - d[None, :]
    weight = rho * z2
    middle = 1.0 + weight @ (1.0 / (differences - span / 2))
    last = np.arange(m) == m - 1
    from_left = (middle >= 0) | last
    origin = np.where(from_left, np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    delta = d[:, None] - d[origin][None, :]
    low = np.where(from_left, 0.0, -span / 2)
    high = np.where(from_left, span / 2, 0.0)
    low[-1], high[-1] = (0.0, span[-1] / 2) if middle[-1] >= 0 else (span[-1] / 2, span[-1])
    tau = (low + high) / 2
    left = np.triu(np.ones((m, m))) * weight[:, None]  # [j, k]: of the poles j at or before root k
    at = np.arange(m)
    near, far = delta[at, at], delta[np.minimum(at + 1, m - 1), at]
    for _ in range(100):
        inverse = 1.0 / (delta - tau)
        squares = inverse * inverse
        f = 1.0 + weight @ inverse
        before = np.einsum("jk,jk->k", left, squares)
        after = weight @ squares - before
        done = np.abs(f) <= _EPS * m * (1.0 + weight @ np.abs(inverse))
        if done.all():
            break
        low = np.where(f < 0, tau, low)
        high = np.where(f >= 0, tau, high)
        a, b = near - tau, far - tau
        with np.errstate(all="ignore"):
            c = f - before * a - np.where(last, 0.0, after * b)
            p = (a + b) * f - a * b * (before + after)
            q = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(last, a + before * a * a / c, step)
        moved = tau + step
        inside = (moved > low) & (moved < high) & np.isfinite(moved)
        moved = np.where(inside, moved, (low + high) / 2)
        done |= np.abs(moved - tau) <= 2 * _EPS * np.abs(tau)
        done |= (high - low) <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        tau = np.where(done, tau, moved)
    return d[origin] + tau, delta - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after ``weight * v v'`` (``weight > 0``) is added."""
    z = vectors.T @ v
    norm = np.linalg.norm(z)
    rho = weight * norm * norm
    if not rho > 0:
        return values, vectors
    z = z / norm
    tolerance = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho)
    active = np.flatnonzero(rho * np.abs(z) > tolerance)
    if not len(active):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    apart = np.diff(values[active]) > tolerance
    if not apart.all():
        runs = np.split(active, np.flatnonzero(apart) + 1)
        for run in runs:
            if len(run) > 1:  # equal eigenvalues: reflect z onto the last of them
                mirror = z[run].copy()
                size = np.linalg.norm(mirror)
                mirror[-1] += size if mirror[-1] >= 0 else -size
                kept = -size if z[run[-1]] >= 0 else size
                mirror /= np.linalg.norm(mirror)
                vectors[:, run] -= 2.0 * np.outer(vectors[:, run] @ mirror, mirror)
                z[run], z[run[-1]] = 0.0, kept
        active = np.array([run[-1] for run in runs])
    d = values[active]
    roots, gaps = secular_roots(d, z[active] ** 2, rho)
    ratio = gaps.copy()
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, -1.0)
    ratio /= poles  # (root_k - d_j) / (d_k - d_j); on the diagonal root_j - d_j
    again = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[active])
    turn = again[:, None] / gaps
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, active] = vectors[:, active] @ turn
    values[active] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of the vectors seen so far."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update along its distance from the mean."""
        if self.n:
            off = x - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
            self.mean = self.mean + off / (self.n + 1)
        else:
            self.mean = np.array(x, float)
        self.n += 1

    def join(self, other: Spectrum) -> None:
        """The other's scatter as one update per eigenvector, and one along the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        off = other.mean - self.mean
        total = self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * (other.n / total))
        self.mean = self.mean + off * (other.n / total)
        self.n = total
