from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.api import dtw
from stratalith.errors import InvalidInput, ResourceLimit
from stratalith.kernels.warping import align, align_many, band_of, corridor, longest_run, rows_are_right
from stratalith.options import WarpOptions


def brute_force(a, b, window, penalty):
    """Cells one by one, with the same ties."""
    rows, cols = np.array(a, float), np.array(b, float)
    swap = rows_are_right(rows, cols)
    if swap:
        rows, cols = cols, rows
    n, m = len(rows), len(cols)
    band, cell = band_of(n, m, window), {}
    for i in range(n):
        for j in range(m):
            if abs(i * (m - 1) - j * (n - 1)) > band:
                continue
            local = abs(rows[i] - cols[j])
            ways = [(cell[p][0] + pen, cell[p][1], k) for k, (p, pen) in enumerate((((i - 1, j - 1), 0), ((i - 1, j), penalty), ((i, j - 1), penalty)), 1) if p in cell]
            if i == j == 0:
                cell[i, j] = (local, 1, 0)
            elif ways:
                c, size, k = min(ways)
                cell[i, j] = (c + local, size + 1, k)
    i, j = n - 1, m - 1
    path = [(i, j)]
    while k := cell[i, j][2]:
        i, j = i - (k != 3), j - (k != 2)
        path.append((i, j))
    return [(y, x) if swap else (x, y) for x, y in path[::-1]]


def test_golden():
    r = align([0, 1, 2, 3], [0, 2, 3], WarpOptions(window=1, warp_penalty=0.05))
    assert r.path.tolist() == [[0, 0], [1, 0], [2, 1], [3, 2]]
    assert (r.total_cost, r.normalized_cost, r.mean_local_cost) == pytest.approx((1.05, 0.2625, 0.25))
    assert (r.diagonal_steps, r.up_steps, r.left_steps, r.max_warp_run, r.boundary_fraction, r.non_diagonal_steps) == (2, 1, 0, 1, 0.25, 1)


def test_corridor():
    lo, hi = corridor(5, 3, 0.1)
    assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    for n in range(2, 12):
        for m in range(2, 12):
            for w in (0, 0.1, 0.35, 1):
                lo, hi = corridor(n, m, w)
                inside = [(i, j) for i in range(n) for j in range(m) if abs(i * (m - 1) - j * (n - 1)) <= band_of(n, m, w)]
                assert inside == [(i, j) for i in range(n) for j in range(lo[i], hi[i] + 1)]


def test_longest_run():
    assert longest_run(np.array([[1, 0], [1, 0], [0, 1], [0, 1], [0, 1], [1, 1]])) == 3
    assert longest_run(np.array([[1, 1]])) == 0


values = st.lists(st.integers(-3, 3).map(lambda x: x / 2), min_size=2, max_size=9)


@settings(max_examples=300, deadline=None)
@given(values, values, st.sampled_from([0, 0.1, 0.4, 1]), st.sampled_from([0, 0.05, 1]))
def test_brute_force(a, b, window, penalty):
    o = WarpOptions(window=window, warp_penalty=penalty)
    r = align(a, b, o)
    assert [tuple(x) for x in r.path.tolist()] == brute_force(a, b, window, penalty)
    assert align(b, a, o).path[:, ::-1].tolist() == r.path.tolist()


def test_identity_and_api():
    path, cost = dtw([1, 2, 5, 3], [1, 2, 5, 3])
    assert path.tolist() == [[k, k] for k in range(4)] and cost == 0


@pytest.mark.parametrize("a, b", [([1], [1, 2]), ([1, float("nan")], [1, 2]), ([[1, 2]], [1, 2]), (["x", "y"], [1, 2])])
def test_bad_series(a, b):
    with pytest.raises(InvalidInput):
        align(a, b)


@pytest.mark.parametrize("bad", [{"window": 2}, {"window": float("nan")}, {"warp_penalty": -1}, {"max_warp_run": 0}, {"max_warp_run": 1.5}, {"max_dtw_cells": 0}, {"max_memory_mb": 0}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        WarpOptions(**bad)


def test_limits():
    x = np.arange(100.0)
    with pytest.raises(MemoryError):
        align(x, x, WarpOptions(max_dtw_cells=50))
    with pytest.raises(ResourceLimit):
        align(x, x, WarpOptions(max_dtw_cells=150))
    with pytest.raises(ResourceLimit):
        align(x, x, WarpOptions(max_memory_mb=0.001))
    with pytest.raises(InvalidInput):
        align([0, 0, 0, 0, 9], [0, 9, 9, 9, 9], WarpOptions(window=1, max_warp_run=1))
    with pytest.raises(FloatingPointError):
        align([1e308, -1e308], [-1e308, 1e308])


def test_many_at_once():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 5, n) / 2.0, rng.integers(0, 5, m) / 2.0) for n, m in rng.integers(2, 7, (60, 2))]
    o = WarpOptions(window=0.3, warp_penalty=0.05)
    for one, many in zip([align(a, b, o) for a, b in pairs], align_many(pairs, o), strict=True):
        assert one.path.tolist() == many.path.tolist() and one.total_cost == many.total_cost
    assert align_many([]) == []
