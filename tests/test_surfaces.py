from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.errors import InvalidInput, OutOfRange, Unsatisfied
from stratalith.kernels import convergent, gaussian, linear
from stratalith.kernels.grids import Stencils, corner_weights, evaluate, good_points
from stratalith.kernels.twister import MersenneTwister64, Normals
from stratalith.operators import geometry
from stratalith.options import CellModel, ConvergentOptions, Correlation, GaussianOptions, Surface, Trend
from stratalith.plans.surfaces import interpolate_convergent, nodes_of, simulate_gaussian

GRID = Surface(0, 10, 0, 5, 21, 11)
EXP = {"correlation": Correlation.EXPONENTIAL}


def scattered(n=40, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 10, n), rng.uniform(0, 5, n)
    return np.column_stack([x, y, np.sin(x) * 3 + y, rng.uniform(0.5, 2, n)])


def test_weights():
    got = {m: corner_weights(np.array([0.25]), np.array([0.5]), m)[0].tolist() for m in CellModel}
    assert got == {CellModel.BILINEAR: [0.375, 0.125, 0.375, 0.125], CellModel.BOTTOM_LEFT_TO_TOP_RIGHT: [0.5, 0, 0.25, 0.25], CellModel.BOTTOM_RIGHT_TO_TOP_LEFT: [0.25, 0.25, 0.5, 0]}


def test_levels():
    assert convergent.levels(129, 129, 17) == [(17, 17), (33, 33), (65, 65), (129, 129)]
    assert convergent.levels(100, 40, 17) == [(14, 6), (26, 11), (51, 21), (100, 40)]
    assert convergent.levels(100, 40, 17, 2) == [(51, 21), (100, 40)]
    assert convergent.levels(2, 2, 2) == [(2, 2)]


def test_curvature_is_its_diagonal_and_symmetric():
    g = Surface(0, 3, 0, 4, 4, 5)
    k = convergent.curvature(g, 1.3)
    dense = np.array([k(e) for e in np.eye(20)])
    assert np.allclose(dense, dense.T) and np.allclose(np.diag(dense), convergent.curvature_diagonal(g, 1.3))
    assert np.linalg.eigvalsh(dense).min() > -1e-9
    assert np.allclose(k((2 + 3 * np.arange(4)[None, :] - np.arange(5)[:, None]).ravel().astype(float)), 0, atol=1e-9)


@pytest.mark.parametrize("model", list(CellModel))
def test_plane_is_kept(model):
    p = scattered()
    p[:, 2] = 3 + 2 * p[:, 0] - p[:, 1]
    z, r = convergent.interpolate(GRID, p, ConvergentOptions(cells=model))
    x, y = np.meshgrid(np.linspace(0, 10, 21), np.linspace(0, 5, 11))
    assert np.allclose(z.reshape(11, 21), 3 + 2 * x - y, atol=1e-6) and r.converged and r.point_constraints_satisfied


@pytest.mark.parametrize("model", list(CellModel))
def test_hard_points_are_met(model):
    p = scattered(25)
    z, r = convergent.interpolate(GRID, p, ConvergentOptions(cells=model))
    assert np.allclose(evaluate(GRID, z, p[:, 0], p[:, 1], model), p[:, 2], rtol=2e-9, atol=2e-9)
    assert r.max_absolute_point_residual < 1e-8 and r.levels_used == 2


def test_hard_solution_does_not_depend_on_the_size_of_weights():
    """Points met exactly make one surface, whatever their weights are counted in; values and weights as large as those of many rows."""
    p = scattered(12)
    p[:, 2] *= 10_000
    o = ConvergentOptions(relative_tolerance=1e-14, point_tolerance=1e-11, max_iterations=20_000)
    z, more = (convergent.interpolate(GRID, p * [1, 1, 1, k], o) for k in (1.0, 25_000.0))
    assert np.abs(z[0] - more[0]).max() < 1e-6 and more[1].point_constraints_satisfied and more[1].converged
    loose = convergent.interpolate(GRID, p * [1, 1, 1, 25_000.0])[0]
    assert np.abs(z[0] - loose).max() < 1e-6 * np.abs(z[0]).max()


def test_hard_solution_has_least_energy():
    """The same points by a dense system of the bending energy, its ridge and multipliers."""
    p = scattered(12)
    o = ConvergentOptions()
    z, _ = convergent.interpolate(GRID, p, o)
    s, n = Stencils.of(GRID, p, o.cells), GRID.nx * GRID.ny
    k = convergent.curvature(GRID, 1.0)
    ridge = o.regularization * convergent.mean_positive(convergent.curvature_diagonal(GRID, 1.0))
    b = np.zeros((len(p), n))
    for row, (nodes, coef) in enumerate(zip(s.nodes, s.coef, strict=True)):
        np.add.at(b[row], nodes, coef)
    from stratalith.kernels.grids import plane_values

    trend = plane_values(GRID, p, True, False)(GRID)
    a = np.block([[np.array([k(e) for e in np.eye(n)]) + ridge * np.eye(n), b.T], [b, np.zeros((len(p), len(p)))]])
    exact = np.linalg.solve(a, np.r_[ridge * trend, p[:, 2]])[:n]
    assert np.abs(z - exact).max() < 1e-3 * np.abs(exact).max()


def test_soft_and_report():
    z, r = convergent.interpolate(GRID, scattered(), ConvergentOptions(hard=False))
    assert r.constraint_iterations == 0 and not r.point_constraints_satisfied and r.max_absolute_point_residual > 0


def test_point_rules():
    inside, outside = [1, 1, 5, 1], [11, 1, 5, 1]
    assert len(good_points(GRID, np.array([inside, [1, 1, 5, 0], outside]), True)) == 1
    assert good_points(GRID, np.array([[10 + 1e-14, 1, 5, 1]]), False)[0, 0] == 10
    for bad, kind in ((outside, OutOfRange), ([1, 1, float("nan"), 1], InvalidInput), ([1, 1, 1, -1], InvalidInput)):
        with pytest.raises(kind):
            good_points(GRID, np.array([inside, bad]), False)
    with pytest.raises(InvalidInput):
        convergent.interpolate(GRID, np.zeros((0, 4)))


def test_contradictions():
    twice = np.array([[1.2, 1.1, 5, 1], [1.2, 1.1, 6, 1]])
    for kernel in (lambda: convergent.interpolate(GRID, twice), lambda: gaussian.interpolate(GRID, twice, GaussianOptions(**EXP))):
        with pytest.raises(InvalidInput):
            kernel()
    twice[1, 2] = 5
    assert convergent.interpolate(GRID, twice)[1].point_constraints_satisfied


def test_mask():
    active = np.ones(21 * 11, bool)
    active[0] = False
    p = np.array([[0.1, 0.1, 5, 1]])
    for kernel in (convergent.interpolate, gaussian.interpolate):
        with pytest.raises(OutOfRange):
            kernel(GRID, p, None, active)
        with pytest.raises(InvalidInput):
            kernel(GRID, p, None, active[:5])
    assert convergent.interpolate(GRID, np.array([[1.0, 1.0, 5, 1], [2.0, 2.0, 4, 1]]), None, active)[1].converged


def test_twister():
    assert int(MersenneTwister64(5489).integers(10_000)[-1]) == 9981545732273789042
    m = MersenneTwister64(7)
    assert np.array_equal(np.concatenate([m.integers(k) for k in (1, 311, 2, 700)]), MersenneTwister64(7).integers(1014))
    n = Normals(3)
    assert np.array_equal(np.concatenate([n.draw(k) for k in (1, 2, 5)]), Normals(3).draw(8))
    x = Normals(1).draw(200_000)
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01


def test_linear():
    a = np.array([[0, 2, 1], [1, 0, 0], [3, 1, 5.0]])
    assert np.allclose(linear.solve3(a, np.array([1, 2, 3.0])), np.linalg.solve(a, [1, 2, 3]))
    assert linear.solve3(np.ones((3, 3)), np.ones(3)) is None
    assert linear.rank([[1, 2], [2, 4]], 1e-9) == 1 and linear.rank([[1, 2], [2, 4.1]], 1e-9) == 2 and linear.rank([], 1e-9) == 0


@pytest.mark.parametrize("kind", [Correlation.EXPONENTIAL, Correlation.SPHERICAL])
def test_realisation(kind):
    o = GaussianOptions(correlation=kind, major_range=3, minor_range=1.5, azimuth_degrees=30)
    p = scattered(20)
    z, r = gaussian.interpolate(GRID, p, o)
    again, _ = gaussian.interpolate(GRID, p[::-1], o)
    assert np.array_equal(z, again) and r.point_constraints_satisfied
    assert np.allclose(evaluate(GRID, z, p[:, 0], p[:, 1], o.cells), p[:, 2], atol=1e-8)
    assert not np.allclose(z, gaussian.interpolate(GRID, p, GaussianOptions(correlation=kind, major_range=3, minor_range=1.5, azimuth_degrees=30, seed=2))[0])


def test_unconditional_moments():
    o = [GaussianOptions(**EXP, major_range=3, minor_range=2, structured_variance=4, nugget=1, seed=k) for k in range(300)]
    z = np.array([gaussian.interpolate(GRID, np.zeros((0, 4)), x)[0] for x in o])
    assert abs(z.mean()) < 0.15 and abs(z.var(axis=0).mean() - 5) < 0.4
    c = np.mean(z[:, 0] * z[:, 1])
    assert abs(c - 4 * np.exp(-3 * 0.5 / 3)) < 0.9


def test_gaussian_rules():
    z, r = gaussian.interpolate(GRID, scattered(), GaussianOptions(**EXP, hard=False))
    assert not r.point_constraints_satisfied and r.converged and r.conditioning_iterations == 0
    assert gaussian.interpolate(GRID, np.zeros((0, 4)), GaussianOptions(**EXP, hard=False))[1].point_constraints_satisfied
    given = np.arange(231.0)
    z0, _ = gaussian.interpolate(GRID, np.zeros((0, 4)), GaussianOptions(**EXP, trend=Trend.INPUT_SURFACE, structured_variance=1e-12), None, given)
    assert np.allclose(z0, given, atol=1e-4)
    with pytest.raises(InvalidInput):
        gaussian.interpolate(GRID, scattered(), GaussianOptions(trend=Trend.INPUT_SURFACE), None, given[:3])
    with pytest.raises(Unsatisfied):
        gaussian.interpolate(GRID, np.zeros((0, 4)), GaussianOptions(correlation=Correlation.GAUSSIAN, major_range=500, minor_range=500, max_expansions=1))
    assert [gaussian.next_power_of_two(n) for n in (0, 1, 100, 128)] == [1, 1, 128, 128]
    assert gaussian.signed_lags(8)[5] == -3 and gaussian.signed_lags(8)[4] == 4


@pytest.mark.parametrize("bad", [{"coarsest": 1}, {"max_iterations": 0}, {"smoothness": 0}, {"data_weight": -1}, {"penalty_growth": 0.5}, {"point_tolerance": 0}, {"max_constraint_iterations": 0}])
def test_bad_convergent(bad):
    with pytest.raises(ValueError):
        ConvergentOptions(**bad)


@pytest.mark.parametrize("bad", [{"padding": 1}, {"max_expansions": 0}, {"seed": -1}, {"seed": 2**64}, {"nugget": -1}, {"azimuth_degrees": float("nan")}, {"conditioning_tolerance": 0}, {"major_range": float("inf")}])
def test_bad_gaussian(bad):
    with pytest.raises(ValueError):
        GaussianOptions(**bad)


@pytest.mark.parametrize("bad", [(0, 1, 0, 1, 1, 2), (1, 1, 0, 1, 2, 2), (0, float("inf"), 0, 1, 2, 2)])
def test_bad_surface(bad):
    with pytest.raises(ValueError):
        Surface(*bad)


def frames(spark):
    head = spark.createDataFrame([(0, 0.0, 10.0, 0.0, 5.0, 21, 11), (1, 0.0, 10.0, 0.0, 5.0, 11, 6), (2, 0.0, 10.0, 0.0, 5.0, 11, 6)], "surface_id int, minx double, maxx double, miny double, maxy double, nx int, ny int")
    rows = [(s, k, *map(float, p)) for s in (0, 1) for k, p in enumerate(scattered(8, s))]
    return head, spark.createDataFrame(rows, "surface_id int, point_id long, x double, y double, value double, weight double")


def test_surfaces_as_frames(spark):
    head, points = frames(spark)
    solved = interpolate_convergent(head, points, on_error="report")
    assert {r.surface_id: r.status for r in solved.select("surface_id", "status").collect()} == {0: "ok", 1: "ok", 2: "invalid_input"}
    z = solved.filter("surface_id = 0").first().z
    own = scattered(8, 0)
    assert np.allclose(z, convergent.interpolate(GRID, own)[0], rtol=1e-6)
    nodes = nodes_of(solved.filter("status = 'ok'"), head)
    q = points.select("surface_id", F.col("point_id").alias("query_id"), "x", "y")
    got = geometry.evaluate_surface(q, head, nodes, CellModel.BOTTOM_RIGHT_TO_TOP_LEFT).join(points.withColumnRenamed("point_id", "query_id"), ["surface_id", "query_id"])
    assert got.filter(F.abs(F.col("z") - F.col("value")) > 1e-7).isEmpty()
    with pytest.raises(Exception, match="no point is left"):
        interpolate_convergent(head, points).count()


def test_realisations_as_frames(spark):
    head, points = frames(spark)
    r = simulate_gaussian(head, points, GaussianOptions(**EXP), seeds=[1, 2**64 - 1])
    rows = {(x.surface_id, x.seed): x for x in r.collect()}
    assert len(rows) == 6 and all(x.status == "ok" for x in rows.values())
    assert np.array_equal(rows[0, 1].z, gaussian.interpolate(GRID, scattered(8, 0), GaussianOptions(**EXP))[0])
    assert np.array_equal(rows[0, -1].z, gaussian.interpolate(GRID, scattered(8, 0), GaussianOptions(**EXP, seed=2**64 - 1))[0])


def test_frame_errors(spark):
    head, points = frames(spark)
    with pytest.raises(OutOfRange):
        geometry.valid_points(points.withColumn("x", F.col("x") + 20), head)
    with pytest.raises(InvalidInput):
        geometry.map_columns(points, x="nope")
    renamed = points.select(F.col("x").alias("E"), F.col("y").alias("N"), F.col("value").alias("top"))
    assert geometry.map_columns(renamed, "E", "N", "top", None, None, None).columns == ["surface_id", "point_id", "x", "y", "value", "weight"]


def test_udtfs(spark):
    from stratalith.functions.udtfs import register

    register(spark)
    path = spark.sql("SELECT * FROM dtw_path(array(0D, 1D, 2D, 3D), array(0D, 2D, 3D), 1D, 0.05D)").collect()
    assert [(r.i, r.j) for r in path] == [(0, 0), (1, 0), (2, 1), (3, 2)]
    assert spark.sql("SELECT * FROM grid_nodes(0D, 1D, 0D, 2D, 3, 2)").count() == 6
    row = spark.sql("SELECT matrix_rank(array(array(1D, 2D), array(2D, 4D)), 1e-9D) AS r, size(normals(5L, 7)) AS n").first()
    assert (row.r, row.n) == (1, 7)
