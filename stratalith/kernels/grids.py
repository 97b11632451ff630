"""What both surface kernels share: points on a grid as arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..errors import InvalidInput, OutOfRange
from ..options import CellModel, Surface
from .linear import EPS, plane_coefficients, rank

SUPPORT = 64 * EPS


def _tolerance(low: float, high: float) -> float:
    return 64 * EPS * max(1.0, abs(low), abs(high), abs(high - low))


def good_points(grid: Surface, points: np.ndarray, ignore_outside: bool) -> np.ndarray:
    """Rows x, y, value, weight that count, moved into the bounds. In order of the rows, the first bad one is the error."""
    p = np.asarray(points, float).reshape(-1, 4)
    finite = np.isfinite(p).all(axis=1)
    tx, ty = _tolerance(grid.minx, grid.maxx), _tolerance(grid.miny, grid.maxy)
    with np.errstate(invalid="ignore"):
        outside = (p[:, 0] < grid.minx - tx) | (p[:, 0] > grid.maxx + tx) | (p[:, 1] < grid.miny - ty) | (p[:, 1] > grid.maxy + ty)
        negative, used = p[:, 3] < 0, p[:, 3] != 0
    bad = ~finite | negative | (outside & used & (not ignore_outside))
    if bad.any():
        k = int(np.argmax(bad))
        if not finite[k]:
            raise InvalidInput(f"point {k} is not finite")
        if negative[k]:
            raise InvalidInput(f"point {k} has a negative weight")
        raise OutOfRange(f"point {k} lies outside the surface")
    q = p[used & ~outside].copy()
    q[:, 0], q[:, 1] = np.clip(q[:, 0], grid.minx, grid.maxx), np.clip(q[:, 1], grid.miny, grid.maxy)
    return q


def corner_weights(fx: np.ndarray, fy: np.ndarray, model: CellModel) -> np.ndarray:
    """Four columns: bottom-left, bottom-right, top-left, top-right."""
    zero = np.zeros_like(fx)
    if model is CellModel.BILINEAR:
        return np.column_stack([(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy])
    if model is CellModel.BOTTOM_LEFT_TO_TOP_RIGHT:
        a, b, lower = [1 - fx, fx - fy, zero, fy], [1 - fy, zero, fy - fx, fx], fy <= fx
    else:
        a, b, lower = [1 - fx - fy, fx, fy, zero], [zero, 1 - fy, 1 - fx, fx + fy - 1], fx + fy <= 1
    return np.where(lower[:, None], np.column_stack(a), np.column_stack(b))


@dataclass(frozen=True)
class Stencils:
    """Rows of the sparse matrix B: four nodes and weights for each point."""

    nodes: np.ndarray
    coef: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    size: int

    @staticmethod
    def of(grid: Surface, points: np.ndarray, model: CellModel) -> Stencils:
        ax, ay = (points[:, 0] - grid.minx) / grid.dx, (points[:, 1] - grid.miny) / grid.dy
        cx, cy = (np.clip(np.floor(a).astype(np.int64), 0, n - 2) for a, n in ((ax, grid.nx), (ay, grid.ny)))
        coef = corner_weights(np.clip(ax - cx, 0, 1), np.clip(ay - cy, 0, 1), model)
        low = cy * grid.nx + cx
        return Stencils(np.column_stack([low, low + 1, low + grid.nx, low + grid.nx + 1]), coef, points[:, 2], points[:, 3], grid.nx * grid.ny)

    def gather(self, z: np.ndarray) -> np.ndarray:
        return (self.coef * z[self.nodes]).sum(axis=1)

    def scatter(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.nodes.ravel(), (self.coef * p[:, None]).ravel(), self.size)

    def statistics(self, z: np.ndarray) -> tuple[float, float, float, float]:
        """Largest absolute and relative residual, weighted sum of squares, sum of weights."""
        r = self.gather(z) - self.value
        a = np.abs(r)
        return float(a.max(initial=0)), float((a / np.maximum(1, np.abs(self.value))).max(initial=0)), float((self.weight * r * r).sum()), float(self.weight.sum())

    def check_mask(self, active: np.ndarray | None) -> None:
        if active is None:
            return
        if len(active) != self.size:
            raise InvalidInput(f"the mask has {len(active)} nodes, the surface {self.size}")
        if ((self.coef > SUPPORT) & ~np.asarray(active, bool)[self.nodes]).any():
            raise OutOfRange("a point rests on a node that is not active")

    def check_compatible(self, relative_tolerance: float) -> None:
        """Points that rest on the same nodes must not ask for more than those nodes can give."""
        groups: dict[tuple, list[int]] = {}
        for k, (n, c) in enumerate(zip(self.nodes, self.coef, strict=True)):
            groups.setdefault(tuple(sorted(n[c > SUPPORT].tolist())), []).append(k)
        for support, rows in groups.items():
            if len(rows) < 2:
                continue
            where = {n: k for k, n in enumerate(support)}
            a = np.zeros((len(rows), len(support) + 1))
            for r, k in enumerate(rows):
                for n, c in zip(self.nodes[k].tolist(), self.coef[k].tolist(), strict=True):
                    if n in where:
                        a[r, where[n]] = c
                a[r, -1] = self.value[k]
            if rank(a, relative_tolerance) > rank(a[:, :-1], relative_tolerance):
                raise InvalidInput("the grid cannot represent the points: refine it, or use nodes at the points")


def plane_values(grid: Surface, points: np.ndarray, slopes: bool, absolute_pivots: bool) -> Callable[[Surface], np.ndarray]:
    """The fitted plane, to be evaluated at the nodes of any grid with these bounds."""
    cx, cy, sx, sy = (grid.minx + grid.maxx) / 2, (grid.miny + grid.maxy) / 2, (grid.maxx - grid.minx) / 2, (grid.maxy - grid.miny) / 2
    u, v, z, w = (points[:, 0] - cx) / sx, (points[:, 1] - cy) / sy, points[:, 2], points[:, 3]
    sums = {"w": w, "u": w * u, "v": w * v, "uu": w * u * u, "uv": w * u * v, "vv": w * v * v, "z": w * z, "uz": w * u * z, "vz": w * v * z}
    a, bx, by = plane_coefficients({k: float(x.sum()) for k, x in sums.items()}, slopes, absolute_pivots)

    def at(g: Surface) -> np.ndarray:
        x, y = g.minx + np.arange(g.nx) * g.dx, g.miny + np.arange(g.ny) * g.dy
        return (a + bx * (x[None, :] - cx) / sx + by * (y[:, None] - cy) / sy).ravel()

    return at


def evaluate(grid: Surface, z: np.ndarray, x: np.ndarray, y: np.ndarray, model: CellModel) -> np.ndarray:
    """The surface's values at points; raises for one outside or for a wrong number of nodes."""
    if len(z) != grid.nx * grid.ny:
        raise InvalidInput("a surface needs nx * ny values")
    x, y = np.atleast_1d(np.asarray(x, float)), np.atleast_1d(np.asarray(y, float))
    p = good_points(grid, np.column_stack([x, y, np.zeros_like(x), np.ones_like(x)]), False)
    return Stencils.of(grid, p, model).gather(np.asarray(z, float))
