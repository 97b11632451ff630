"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import q
from .functions.covariances import correlation, covariance
from .functions.numbers import parse_number
from .operators import alignment, curvature, fields, geometry, logs, trends
from .options import CellModel, ConvergentOptions, Correlation, GaussianOptions, LogOptions, Trend, WarpOptions
from .plans.correlation import correlate_prepared
from .plans.surfaces import interpolate_convergent, nodes_of, simulate_gaussian
from .sources.csv_logs import resolve_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STEP = 0.7
PAIR = WarpOptions(window=0.1, warp_penalty=0.05)
FIELD = {"major": 9.8, "minor": 2.0, "azimuth": 30.0, "variance": 2.5, "nugget": 0.25}
UNIT = {"correlation": Correlation.EXPONENTIAL, "major_range": 3.0, "minor_range": 2.0, "azimuth_degrees": 30.0, "structured_variance": 2.5, "nugget": 0.25}
EVERY_GAP = LogOptions(step=STEP, interpolate_all_gaps=True)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return logs.clean(fx.logs(spark, d), EVERY_GAP.missing_values)


@query
def correlate_logs(spark: SparkSession, d: str) -> DataFrame:
    prepared = logs.prepare(fx.logs(spark, d), LogOptions(step=3.0))
    return correlate_prepared(prepared, fx.wells(spark), WarpOptions(warp_penalty=0.05))


@query
def correlate_table(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the correlation, doubles in whole millionths.

    Sums along different paths can be equal but for rounding. Curves and penalty are multiples of powers of two here, so that costs are exact
    and ties are ties in any engine.
    """
    prepared = logs.prepare(fx.logs(spark, d), LogOptions(step=3.0)).withColumn("z", F.floor(F.col("z") * 2.0**20 + 0.5) / 2.0**20)
    t = correlate_prepared(prepared, fx.wells(spark), WarpOptions(warp_penalty=0.0625))
    return t.select(*(q(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in t.schema.fields))


@query
def log_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("log_id", F.col("md").cast("long").alias("md"), q("value").alias("value"))


@query
def numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    texts = (F.concat(F.lit("  1 "), n, F.lit(",5 ")), F.concat(n, F.lit(" "), F.lit("000,25")), F.concat(n, F.lit(",234.5")), F.concat(n, F.lit("d")), F.lit(""), F.lit("NA"), F.concat(F.lit("-"), n, F.lit(".5e2")), F.concat(F.lit("x"), n))
    text = F.lit(None).cast("string")
    for k, t in enumerate(texts):
        text = F.when(F.col("event_id") % len(texts) == k, t).otherwise(text)
    return fx.table(spark, d, "events").select("event_id", parse_number(text).alias("number"))


@query
def median_steps(spark: SparkSession, d: str) -> DataFrame:
    return logs.median_steps(_clean(spark, d))


@query
def common_step(spark: SparkSession, d: str) -> DataFrame:
    return logs.common_step(_clean(spark, d))


@query
def gap_check(spark: SparkSession, d: str) -> DataFrame:
    return logs.wide_gaps(_clean(spark, d), 1.0, 1.5)


@query
def regular_grid(spark: SparkSession, d: str) -> DataFrame:
    return logs.regular_grid(logs.grid_plan(_clean(spark, d), STEP), STEP).select("log_id", "idx", q("md").alias("md"))


@query
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    c = _clean(spark, d)
    return logs.interpolate(logs.regular_grid(logs.grid_plan(c, STEP), STEP), c).select("log_id", "idx", q("value").alias("value"))


def _normalised(spark: SparkSession, d: str, clip: tuple[float, float] | None) -> DataFrame:
    c = _clean(spark, d)
    return logs.normalise(c, clip).select("log_id", F.col("md").cast("long").alias("md"), q("z").alias("z"))


@query
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d, None)


@query
def normalize_clipped(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d, (5.0, 95.0))


@query
def prepare_logs(spark: SparkSession, d: str) -> DataFrame:
    return logs.prepare(fx.logs(spark, d), EVERY_GAP).select("log_id", "idx", q("md").alias("md"), q("z").alias("z"))


@query
def well_pairs(spark: SparkSession, d: str) -> DataFrame:
    return alignment.consecutive_pairs(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("log_id"), F.col("s_suppkey").alias("ord")))


@query
def well_names(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "supplier")
    stem = F.when(F.col("s_suppkey") % 3 == 0, "well_gis").when(F.col("s_suppkey") % 3 == 1, "Same").otherwise(F.col("s_name"))
    return resolve_names(s.select(F.col("s_suppkey").alias("log_id"), F.concat(F.lit("/data/field "), F.col("s_suppkey").cast("string"), F.lit("/"), stem, F.lit(".csv")).alias("path")))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("pair"), (F.col("p_size") % 12 + 2).cast("int").alias("n"), (F.col("p_partkey") % 9 + 2).cast("int").alias("m"))


@query
def corridor_cells(spark: SparkSession, d: str) -> DataFrame:
    return alignment.corridor_cells(_sizes(spark, d), 0.1)


@query
def local_cost(spark: SparkSession, d: str) -> DataFrame:
    cells = alignment.packed_local_costs(fx.series_pairs(spark, d), 0.1)
    return cells.groupBy("pair", "i").agg(F.count("*").alias("cells"), q(F.sum("local_cost")).alias("cost"))


@query
def local_cost_long(spark: SparkSession, d: str) -> DataFrame:
    """Series as rows, joined on (pair, j)."""
    p = fx.series_pairs(spark, d)
    left, right = p.select("pair", F.posexplode("a").alias("i", "z")), p.select("pair", F.posexplode("b").alias("j", "z"))
    return alignment.local_costs(left, right, 0.1).select("pair", "i", "j", q("local_cost").alias("local_cost"))


@query
def dtw_fold(spark: SparkSession, d: str) -> DataFrame:
    f = alignment.fold_costs(fx.series_pairs(spark, d), PAIR)
    return f.select("pair", q("total_cost").alias("total_cost"), "path_length")


@query
def dtw_cost(spark: SparkSession, d: str) -> DataFrame:
    a = alignment.align_pairs(fx.series_pairs(spark, d), PAIR)
    return a.select("pair", q("total_cost").alias("total_cost"), F.size("path").cast("long").alias("path_length"), "diagonal_steps", "up_steps", "left_steps", "max_warp_run", q("normalized_cost").alias("normalized_cost"))


def _decorated(spark: SparkSession, d: str) -> DataFrame:
    p = fx.series_pairs(spark, d)
    sizes = p.select("pair", F.size("a").alias("n"), F.size("b").alias("m"))
    return alignment.decorate(alignment.path_rows(alignment.align_pairs(p, PAIR)), sizes, PAIR.warp_penalty, PAIR.window)


@query
def dtw_path(spark: SparkSession, d: str) -> DataFrame:
    return _decorated(spark, d).select("pair", "path_index", "i", "j", "move", q("cumulative_cost").alias("cumulative_cost"), "boundary_hit")


@query
def dtw_path_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = _decorated(spark, d)
    f = alignment.path_quality(rows, PAIR.warp_penalty).join(alignment.warp_runs(rows), "pair")
    return f.select("pair", "path_length", *(q(c).alias(c) for c in ("total_cost", "normalized_cost", "mean_local_cost", "boundary_fraction")), "diagonal_steps", "up_steps", "left_steps", "max_warp_run")


@query
def point_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    odd = p.select("surface_id", "point_id", (F.col("x") - 1.5).alias("x"), "y", F.when(F.col("point_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("value"), (F.col("weight") * (F.col("point_id") % 5 - 1)).alias("weight"))
    return geometry.classify(odd, fx.surfaces(spark)).select("surface_id", "point_id", "verdict")


def _stencils(spark: SparkSession, d: str, model: CellModel) -> DataFrame:
    p = geometry.valid_points(fx.off_nodes(fx.points(spark, d)), fx.surfaces(spark))
    return geometry.stencils(p, model)


def _evaluate(model: CellModel) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = fx.off_nodes(fx.points(spark, d)).select("surface_id", F.col("point_id").alias("query_id"), "x", "y")
        z = geometry.evaluate_surface(p, fx.surfaces(spark), fx.flat_nodes(spark, d), model)
        return z.select("surface_id", "query_id", q("z").alias("z"))

    return run


for _m in CellModel:
    QUERIES[f"evaluate_{_m.value}"] = _evaluate(_m)


@query
def stencil_rows(spark: SparkSession, d: str) -> DataFrame:
    return _stencils(spark, d, CellModel.BOTTOM_RIGHT_TO_TOP_LEFT).select("surface_id", "point_id", "corner", "node_id", q("coef", 1e-9).alias("coef"))


@query
def scatter_weights(spark: SparkSession, d: str) -> DataFrame:
    s = _stencils(spark, d, CellModel.BILINEAR)
    amounts = fx.points(spark, d).select("surface_id", "point_id", F.col("weight").alias("p"))
    return geometry.scatter(s, amounts, fx.surfaces(spark)).select("surface_id", "node_id", q("z").alias("z"))


@query
def constraint_stats(spark: SparkSession, d: str) -> DataFrame:
    r = geometry.residuals(_stencils(spark, d, CellModel.BILINEAR), fx.flat_nodes(spark, d))
    s = geometry.constraint_statistics(r)
    return s.select("surface_id", q("max_absolute").alias("max_absolute"), q("max_relative", 1e-9).alias("max_relative"), q("weighted_rms").alias("weighted_rms"), F.col("total_weight").cast("long").alias("total_weight"))


@query
def support_groups(spark: SparkSession, d: str) -> DataFrame:
    g = geometry.support_groups(_stencils(spark, d, CellModel.BOTTOM_LEFT_TO_TOP_RIGHT))
    return g.select("surface_id", F.array_join(F.transform("support", lambda x: x.cast("string")), ",").alias("support"), "n")


@query
def mask_violations(spark: SparkSession, d: str) -> DataFrame:
    mask = geometry.grid_nodes(fx.surfaces(spark)).select("surface_id", "node_id", (F.col("ix") + F.col("iy") < 50).alias("active"))
    return geometry.unsupported(_stencils(spark, d, CellModel.BOTTOM_RIGHT_TO_TOP_LEFT), mask)


@query
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.valid_points(fx.points(spark, d), fx.surfaces(spark))
    return trends.fit_planes(p).select("surface_id", *(q(c, 1e-4).alias(c) for c in ("a", "bx", "by")))


@query
def plane_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.valid_points(fx.points(spark, d).withColumn("value", F.lit(3.0) + F.col("x") * 2 - F.col("y")), fx.surfaces(spark))
    return trends.evaluate_planes(trends.fit_planes(p), fx.surfaces(spark)).select("surface_id", "node_id", q("z").alias("z"))


@query
def variance_estimate(spark: SparkSession, d: str) -> DataFrame:
    r = fx.points(spark, d).select("surface_id", "value", "weight", (F.col("value") - F.col("x") * 700).alias("residual"))
    return trends.structured_variance(r).select("surface_id", q("variance", 1e-2).alias("variance"))


@query
def curvature_apply(spark: SparkSession, d: str) -> DataFrame:
    return curvature.curvature(fx.flat_nodes(spark, d), fx.surfaces(spark)).select("surface_id", "node_id", q("kz", 1e-1).alias("kz"))


@query
def curvature_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return curvature.curvature_diagonal(fx.surfaces(spark)).select("surface_id", "node_id", q("d", 1e-3).alias("d"))


@query
def curvature_scale(spark: SparkSession, d: str) -> DataFrame:
    return curvature.mean_positive(curvature.curvature_diagonal(fx.surfaces(spark))).select("surface_id", q("scale", 1e-3).alias("scale"))


@query
def level_resample(spark: SparkSession, d: str) -> DataFrame:
    return curvature.resample(fx.flat_nodes(spark, d), fx.surfaces(spark), 26, 6).select("surface_id", "node_id", q("z").alias("z"))


def _model(model: Correlation) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = geometry.grid_nodes(fx.surfaces(spark))
        rho = correlation(F.col("x") - 1.0, F.col("y"), F.lit(FIELD["major"]), F.lit(FIELD["minor"]), FIELD["azimuth"], model)
        c = covariance(rho, F.col("node_id") == 0, F.lit(FIELD["variance"]), FIELD["nugget"])
        return g.select("surface_id", "node_id", q(rho, 1e-9).alias("rho"), q(c, 1e-9).alias("cov"))

    return run


for _c in Correlation:
    QUERIES[f"covariance_{_c.value}"] = _model(_c)


@query
def conditioning_diagonal(spark: SparkSession, d: str) -> DataFrame:
    s = _stencils(spark, d, CellModel.BILINEAR)
    f = fields.conditioning_diagonal(s, fx.surfaces(spark), FIELD["major"], FIELD["minor"], FIELD["azimuth"], FIELD["variance"], FIELD["nugget"], Correlation.EXPONENTIAL)
    return f.select("surface_id", "point_id", q("d", 1e-9).alias("d"))


@query
def spectrum_small(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvalues of the torus as the realisations use them; the SQL sums by the transform's definition."""
    return fields.spectra(fx.unit_surfaces(spark), GaussianOptions(**UNIT)).select("surface_id", "fx", "fy", q("eigenvalue").alias("eigenvalue"))


SHARP = {"relative_tolerance": 1e-14, "max_iterations": 20_000, "coarsest": 4}


def _nodes(solved: DataFrame, surfaces: DataFrame, unit: float) -> DataFrame:
    rows = nodes_of(solved, surfaces)
    return rows.select(*(c for c in ("surface_id", "seed") if c in rows.columns), "node_id", q("z", unit).alias("z"))


@query
def surface_hard_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Least bending through points that are met; the SQL solves the dense system with multipliers."""
    s = fx.surfaces(spark, 13, 6)
    return _nodes(interpolate_convergent(s, fx.chosen_points(spark, d), ConvergentOptions(point_tolerance=1e-11, **SHARP)), s, 1.0)


@query
def surface_soft_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Least bending and misfit over all points; the SQL solves the dense system."""
    s = fx.surfaces(spark, 13, 6)
    return _nodes(interpolate_convergent(s, fx.points(spark, d), ConvergentOptions(hard=False, **SHARP)), s, 1e-3)


@query
def surface_status(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of surfaces whose points contradict each other, lie outside, have bad numbers or rest on inactive nodes."""
    surfaces, points, mask = fx.troubled(spark, d)
    return interpolate_convergent(surfaces, points, ConvergentOptions(relative_tolerance=1e-11, point_tolerance=1e-7), mask, on_error="report").select("surface_id", "status")


@query
def surface_convergent_fit(spark: SparkSession, d: str) -> DataFrame:
    s = fx.surfaces(spark, 99, 21)
    # prices from a thousand to a hundred thousand in one system: the solver's stop, relative to all, leaves some 1e-8 of the small ones
    solved = interpolate_convergent(s, fx.points(spark, d), ConvergentOptions(relative_tolerance=1e-11, point_tolerance=1e-7))
    return _evaluated(spark, d, nodes_of(solved, s), s, CellModel.BOTTOM_RIGHT_TO_TOP_LEFT)


def _evaluated(spark: SparkSession, d: str, nodes: DataFrame, surfaces: DataFrame, model: CellModel) -> DataFrame:
    """The surface's values at its points, which it meets."""
    p = fx.points(spark, d).select("surface_id", F.col("point_id").alias("query_id"), "x", "y")
    return geometry.evaluate_surface(p, surfaces, nodes, model).select("surface_id", F.col("query_id").alias("point_id"), q("z", 1e-1).alias("z"))


@query
def surface_convergent_plane(spark: SparkSession, d: str) -> DataFrame:
    s = fx.surfaces(spark, 99, 21)
    p = fx.points(spark, d).withColumn("value", F.lit(3.0) + F.col("x") * 2 - F.col("y"))
    return nodes_of(interpolate_convergent(s, p), s).select("surface_id", "node_id", q("z").alias("z"))


EXPONENTIAL = GaussianOptions(correlation=Correlation.EXPONENTIAL)


@query
def gaussian_field(spark: SparkSession, d: str) -> DataFrame:
    """Realisations without points about a given trend; the SQL has the generator, the spectrum and the sum over the torus."""
    s = fx.unit_surfaces(spark)
    trend = geometry.grid_nodes(s).select("surface_id", "node_id", (F.col("x") + F.col("y") * 2 + F.col("surface_id")).alias("z"))
    none = fx.unit_points(spark, d).filter("false")
    return _nodes(simulate_gaussian(s, none, GaussianOptions(trend=Trend.INPUT_SURFACE, **UNIT), seeds=[1, 5489, 2**63 + 7], trend=trend), s, 1e-6)


@query
def gaussian_conditioned_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A realisation through points about their mean; the SQL kriges the same field's misfit by a dense system."""
    s = fx.unit_surfaces(spark)
    return _nodes(simulate_gaussian(s, fx.unit_points(spark, d), GaussianOptions(trend=Trend.CONSTANT, conditioning_tolerance=1e-13, **UNIT), seeds=[7]), s, 1e-5)


@query
def gaussian_conditioned_fit(spark: SparkSession, d: str) -> DataFrame:
    s = fx.surfaces(spark)
    solved = simulate_gaussian(s, fx.points(spark, d), EXPONENTIAL, seeds=[1])
    return _evaluated(spark, d, nodes_of(solved, s).drop("seed"), s, CellModel.BOTTOM_RIGHT_TO_TOP_LEFT)


@query
def gaussian_realisations(spark: SparkSession, d: str) -> DataFrame:
    s = fx.surfaces(spark, 99, 21)
    return nodes_of(simulate_gaussian(s, fx.points(spark, d), EXPONENTIAL, seeds=[1, 2, 3, 4]), s)


@query
def log_problems(spark: SparkSession, d: str) -> DataFrame:
    """One log of each kind of trouble: infinite values, a constant, no depths."""
    value = F.when(F.col("log_id") == 1, float("inf")).when(F.col("log_id") == 2, 1.0).otherwise(F.col("value"))
    raw = fx.logs(spark, d).select("log_id", F.when(F.col("log_id") != 3, F.col("md")).alias("md"), value.alias("value"))
    return logs.summary(raw, logs.clean(raw, EVERY_GAP.missing_values), STEP, EVERY_GAP).select("log_id", "problem")


@query
def log_limits(spark: SparkSession, d: str) -> DataFrame:
    """Logs of more points than allowed, and of gaps that are too wide."""
    raw = fx.logs(spark, d)
    cleaned = logs.clean(raw, EVERY_GAP.missing_values)
    few = LogOptions(step=STEP, interpolate_all_gaps=True, max_resampled_points=1_028)
    narrow = LogOptions(step=1.0, max_interpolation_gap=1.5)
    return logs.summary(raw, cleaned, STEP, few).select("log_id", "problem").unionByName(logs.summary(raw, cleaned, 1.0, narrow).select("log_id", "problem"))


@query
def corridor_rows(spark: SparkSession, d: str) -> DataFrame:
    return alignment.corridor(_sizes(spark, d), 0.1)


@query
def grid_nodes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.grid_nodes(fx.surfaces(spark, 99, 21)).select("surface_id", "node_id", "ix", "iy", q("x").alias("x"), q("y").alias("y"))


@query
def effective_parameters(spark: SparkSession, d: str) -> DataFrame:
    r = trends.effective_ranges(fx.surfaces(spark), 0.0, 2.5, 30.0)
    return r.select("surface_id", *(q(c, 1e-9).alias(c) for c in ("major_range", "minor_range", "cos_azimuth", "sin_azimuth")))


@query
def effective_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return geometry.effective_tolerance(fx.points(spark, d), 1e-10).select("surface_id", q("tolerance", 1e-9).alias("tolerance"))


@query
def plane_constant(spark: SparkSession, d: str) -> DataFrame:
    p = geometry.valid_points(fx.points(spark, d), fx.surfaces(spark))
    return trends.fit_planes(p, slopes=False).select("surface_id", q("a", 1e-4).alias("a"), q("bx").alias("bx"), q("by").alias("by"))
