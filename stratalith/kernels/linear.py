"""Small dense systems and conjugate gradients."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np

EPS = float(np.finfo(float).eps)
Operator = Callable[[np.ndarray], np.ndarray]


def solve3(matrix: np.ndarray, rhs: np.ndarray, absolute_pivots: bool = False) -> np.ndarray | None:
    """A 3 by 3 system by elimination with row exchanges; None if a pivot is as good as zero, by the matrix's size or by a fixed bound."""
    a = np.column_stack([np.asarray(matrix, float), np.asarray(rhs, float)])
    least = 512 * EPS if absolute_pivots else max(1.0, float(np.abs(a[:, :3]).max())) * 128 * EPS
    for k in range(3):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if not abs(a[p, k]) > least:
            return None
        a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        others = np.arange(3) != k
        a[others] -= np.outer(a[others, k], a[k])
    return a[:, 3]


def plane_coefficients(m: Mapping[str, float], slopes: bool = True, absolute_pivots: bool = False) -> tuple[float, float, float]:
    """a, bx, by from the nine weighted moments; a small ridge on the slopes only. The weighted mean where there is no plane."""
    w = m["w"]
    if not w > 0:
        return 0.0, 0.0, 0.0
    mean = (m["z"] / w, 0.0, 0.0)
    if not slopes:
        return mean
    ridge = 1e-12 * max(1.0, w)
    a = np.array([[w, m["u"], m["v"]], [m["u"], m["uu"] + ridge, m["uv"]], [m["v"], m["uv"], m["vv"] + ridge]])
    found = solve3(a, np.array([m["z"], m["uz"], m["vz"]]), absolute_pivots)
    return mean if found is None or not np.isfinite(found).all() else tuple(map(float, found))


def rank(matrix: np.ndarray, relative_tolerance: float) -> int:
    """Rank with columns scaled to a largest entry of 1, so that values and coefficients weigh alike."""
    a = np.array(matrix, float, ndmin=2)
    if not a.size:
        return 0
    top = np.abs(a).max(axis=0)
    a = a / np.where(top > 0, top, 1)
    least, found = max(256 * EPS, relative_tolerance), 0
    for c in range(a.shape[1]):
        if found == len(a):
            break
        p = found + int(np.argmax(np.abs(a[found:, c])))
        if abs(a[p, c]) <= least:
            continue
        a[[found, p]] = a[[p, found]]
        a[found, c:] /= a[found, c]
        others = np.arange(len(a)) != found
        a[others, c:] -= np.outer(a[others, c], a[found, c:])
        found += 1
    return found


Stop = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], bool]]


def relative(tolerance: float, least: float = 1.0) -> Stop:
    """Done when the residual's norm is the tolerance times the larger of least, |rhs| and the first residual."""

    def begin(rhs: np.ndarray, first: np.ndarray) -> Callable[[np.ndarray], bool]:
        target = tolerance * max(least, float(np.linalg.norm(rhs)), float(np.linalg.norm(first)))
        return lambda r: float(np.linalg.norm(r)) <= target

    return begin


def below(limit: float, size: Callable[[np.ndarray], float]) -> Stop:
    """Done when the residual's size is at most the limit."""
    return lambda rhs, first: lambda r: float(size(r)) <= limit


def conjugate_gradients(apply: Operator, rhs: np.ndarray, x: np.ndarray, diagonal: np.ndarray | float, most: int, stop: Stop) -> tuple[np.ndarray, int, bool]:
    """Solution from x, iterations, and whether stop's condition was met; ends early where the operator is not positive or numbers leave their range."""
    x = x.copy()
    r = rhs - apply(x)
    done = stop(rhs, r)
    if done(r):
        return x, 0, True
    d = r / diagonal
    rho = float(r @ d)
    for k in range(1, most + 1):
        q = apply(d)
        curve = float(d @ q)
        if not (curve > 0 and rho > 0 and np.isfinite(curve) and np.isfinite(rho)):
            return x, k - 1, False
        x += rho / curve * d
        r -= rho / curve * q
        if done(r):
            return x, k, True
        s = r / diagonal
        before, rho = rho, float(r @ s)
        d = s + (rho / before) * d
    return x, most, False
