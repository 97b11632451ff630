"""Control points on grids: filtering, cell stencils, residuals, support.

points (surface_id, point_id, x, y, value, weight), surfaces (surface_id, minx, maxx, miny, maxy, nx, ny), nodes (surface_id, node_id, z).
A stencil is the point's four corners as rows (a sparse matrix): B z is a join and a sum by point, its transpose a join and a sum by node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, OutOfRange
from ..functions.cells import cell_of, clamped, corner_weights, node_id
from ..functions.numbers import EPSILON, coordinate_tolerance, is_finite
from ..options import CellModel

HEADER = ("minx", "maxx", "miny", "maxy", "nx", "ny")
SUPPORT = 64 * EPSILON


def map_columns(df: DataFrame, x: str = "x", y: str = "y", value: str = "value", weight: str | None = "weight", surface_id: str | None = "surface_id", point_id: str | None = "point_id") -> DataFrame:
    """Any frame of points under the engine's names; weight 1, surface 0 and running point numbers where there is no column."""
    missing = [c for c in (x, y, value, *(c for c in (weight, surface_id, point_id) if c)) if c not in df.columns]
    if missing:
        raise InvalidInput(f"no columns {missing}; there are {df.columns}")
    number = F.col(point_id) if point_id else F.monotonically_increasing_id()
    return df.select(
        (F.col(surface_id) if surface_id else F.lit(0)).cast("int").alias("surface_id"), number.cast("long").alias("point_id"),
        *(F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (value, "value"))), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
    )


def map_surfaces(df: DataFrame, minx: str = "minx", maxx: str = "maxx", miny: str = "miny", maxy: str = "maxy", nx: str = "nx", ny: str = "ny", surface_id: str | None = "surface_id") -> DataFrame:
    """Any frame of surface headers under the engine's names; surface 0 where there is no number."""
    names = dict(zip(HEADER, (minx, maxx, miny, maxy, nx, ny), strict=True))
    return _mapped(df, names, surface_id)


def map_nodes(df: DataFrame, node_id: str = "node_id", z: str = "z", surface_id: str | None = "surface_id") -> DataFrame:
    """Any frame of node values (or of a trend) under the engine's names."""
    return _mapped(df, {"node_id": node_id, "z": z}, surface_id)


def _mapped(df: DataFrame, names: dict[str, str], surface_id: str | None) -> DataFrame:
    missing = [c for c in (*names.values(), *([surface_id] if surface_id else [])) if c not in df.columns]
    if missing:
        raise InvalidInput(f"no columns {missing}; there are {df.columns}")
    kinds = {"nx": "int", "ny": "int", "node_id": "long"}
    return df.select((F.col(surface_id) if surface_id else F.lit(0)).cast("int").alias("surface_id"), *(F.col(c).cast(kinds.get(n, "double")).alias(n) for n, c in names.items()))


def classify(points: DataFrame, surfaces: DataFrame) -> DataFrame:
    """points with their surface's header and a verdict: not_finite, negative_weight, unused (weight 0), outside or ok."""
    p = points.join(surfaces, "surface_id")
    tx, ty = coordinate_tolerance(F.col("minx"), F.col("maxx")), coordinate_tolerance(F.col("miny"), F.col("maxy"))
    outside = (F.col("x") < F.col("minx") - tx) | (F.col("x") > F.col("maxx") + tx) | (F.col("y") < F.col("miny") - ty) | (F.col("y") > F.col("maxy") + ty)
    finite = is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("value")) & is_finite(F.col("weight"))
    verdict = F.when(~finite, "not_finite").when(F.col("weight") < 0, "negative_weight").when(F.col("weight") == 0, "unused").when(outside, "outside").otherwise("ok")
    return p.withColumn("verdict", verdict)


def usable(classified: DataFrame) -> DataFrame:
    """The good points, moved into the bounds by what the tolerance allows."""
    p = classified.filter("verdict = 'ok'")
    return p.withColumn("x", clamped(F.col("x"), F.col("minx"), F.col("maxx"))).withColumn("y", clamped(F.col("y"), F.col("miny"), F.col("maxy"))).drop("verdict")


def valid_points(points: DataFrame, surfaces: DataFrame, ignore_outside: bool = False) -> DataFrame:
    """The good points; raises for the first bad one, and for one outside unless those are ignored. Points of no surface are left out."""
    c = classify(points, surfaces)
    bad = ["not_finite", "negative_weight", *([] if ignore_outside else ["outside"])]
    if row := c.filter(F.col("verdict").isin(bad)).select("surface_id", "point_id", "verdict").orderBy("surface_id", "point_id").first():
        kind = OutOfRange if row["verdict"] == "outside" else InvalidInput
        raise kind(f"surface {row['surface_id']}, point {row['point_id']}: {row['verdict'].replace('_', ' ')}")
    return usable(c)


def stencils(points: DataFrame, model: CellModel) -> DataFrame:
    """surface_id, point_id, corner, node_id, coef, value, weight: four rows per point that is joined with its header."""
    cx, fx = cell_of(F.col("x"), F.col("minx"), F.col("maxx"), F.col("nx"))
    cy, fy = cell_of(F.col("y"), F.col("miny"), F.col("maxy"), F.col("ny"))
    p = points.select("*", cx.alias("cx"), fx.alias("fx"), cy.alias("cy"), fy.alias("fy"))
    weights = corner_weights(F.col("fx"), F.col("fy"), model)
    places = [node_id(F.col("cx") + dx, F.col("cy") + dy, F.col("nx")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1))]
    corners = F.array(*(F.struct(F.lit(k).alias("corner"), n.alias("node_id"), w.alias("coef")) for k, (n, w) in enumerate(zip(places, weights, strict=True))))
    kept = [c for c in ("value", "weight") if c in points.columns]
    return p.select("surface_id", "point_id", *kept, F.inline(corners))


def gather(stencil: DataFrame, nodes: DataFrame) -> DataFrame:
    """surface_id, point_id, z: B z."""
    return stencil.join(nodes, ["surface_id", "node_id"]).groupBy("surface_id", "point_id").agg(F.sum(F.col("coef") * F.col("z")).alias("z"))


def scatter(stencil: DataFrame, amounts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surface_id, node_id, z: the transpose of B on amounts (surface_id, point_id, p); 0 for nodes of no stencil."""
    sums = stencil.join(amounts, ["surface_id", "point_id"]).groupBy("surface_id", "node_id").agg(F.sum(F.col("coef") * F.col("p")).alias("z"))
    return grid_nodes(surfaces).select("surface_id", "node_id").join(sums, ["surface_id", "node_id"], "left").select("surface_id", "node_id", F.coalesce("z", F.lit(0.0)).alias("z"))


def grid_nodes(surfaces: DataFrame) -> DataFrame:
    """surface_id, node_id, ix, iy, x, y of every node."""
    n = surfaces.select("*", F.explode(F.sequence(F.lit(0), F.col("ny").cast("int") - 1)).alias("iy")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx").cast("int") - 1)).alias("ix"))
    x, y = F.col("minx") + F.col("ix") * ((F.col("maxx") - F.col("minx")) / (F.col("nx") - 1)), F.col("miny") + F.col("iy") * ((F.col("maxy") - F.col("miny")) / (F.col("ny") - 1))
    return n.select("surface_id", node_id(F.col("ix"), F.col("iy"), F.col("nx")).alias("node_id"), "ix", "iy", x.alias("x"), y.alias("y"))


def evaluate_surface(queries: DataFrame, surfaces: DataFrame, nodes: DataFrame, model: CellModel) -> DataFrame:
    """surface_id, query_id, z at queries (surface_id, query_id, x, y); raises for one outside. The checker of what a solver made."""
    q = queries.select("surface_id", F.col("query_id").alias("point_id"), "x", "y", F.lit(0.0).alias("value"), F.lit(1.0).alias("weight"))
    return gather(stencils(valid_points(q, surfaces), model), nodes).withColumnRenamed("point_id", "query_id")


def residuals(stencil: DataFrame, nodes: DataFrame) -> DataFrame:
    """surface_id, point_id, value, weight, residual (fitted less given)."""
    z = stencil.join(nodes, ["surface_id", "node_id"]).groupBy("surface_id", "point_id").agg(F.first("value").alias("value"), F.first("weight").alias("weight"), F.sum(F.col("coef") * F.col("z")).alias("z"))
    return z.select("surface_id", "point_id", "value", "weight", (F.col("z") - F.col("value")).alias("residual"))


def constraint_statistics(residual: DataFrame) -> DataFrame:
    """Largest absolute and relative residual and the weighted root mean square, by surface (0 without weight)."""
    r, w = F.col("residual"), F.col("weight")
    return residual.groupBy("surface_id").agg(
        F.max(F.abs(r)).alias("max_absolute"), F.max(F.abs(r) / F.greatest(F.lit(1.0), F.abs("value"))).alias("max_relative"),
        F.sum(w * r * r).alias("weighted_squared"), F.sum(w).alias("total_weight"),
        F.when(F.sum(w) > 0, F.sqrt(F.sum(w * r * r) / F.sum(w))).otherwise(0.0).alias("weighted_rms"),
    )


def effective_tolerance(points: DataFrame, relative: float) -> DataFrame:
    """surface_id, tolerance: absolute, by the largest value."""
    return points.groupBy("surface_id").agg((F.lit(max(relative, 128 * EPSILON)) * F.greatest(F.lit(1.0), F.max(F.abs("value")))).alias("tolerance"))


def unsupported(stencil: DataFrame, mask: DataFrame) -> DataFrame:
    """surface_id, point_id of points with a corner on an inactive node (mask: surface_id, node_id, active)."""
    off = mask.filter(~F.col("active")).select("surface_id", "node_id")
    return stencil.filter(F.col("coef") > SUPPORT).join(off, ["surface_id", "node_id"], "left_semi").select("surface_id", "point_id").distinct()


def support_groups(stencil: DataFrame) -> DataFrame:
    """surface_id, support (sorted nodes), rows (coef in that order, value), n: points that rest on the same nodes."""
    used = stencil.filter(F.col("coef") > SUPPORT).groupBy("surface_id", "point_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "coef"))).alias("s"), F.first("value").alias("value"))
    rows = used.select("surface_id", F.transform("s", lambda x: x["node_id"]).alias("support"), F.struct(F.transform("s", lambda x: x["coef"]).alias("coef"), "value").alias("row"))
    return rows.groupBy("surface_id", "support").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.count("*").alias("n"))
