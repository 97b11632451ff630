"""Planes through weighted points, their values at nodes, and the variance that they leave."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.linear import plane_coefficients
from .geometry import grid_nodes

MOMENTS = ("w", "u", "v", "uu", "uv", "vv", "z", "uz", "vz")


def plane_moments(points: DataFrame) -> DataFrame:
    """The nine weighted sums by surface in centred, scaled coordinates: one partial aggregate, however many points."""
    u = (F.col("x") - (F.col("minx") + F.col("maxx")) / 2) / F.greatest((F.col("maxx") - F.col("minx")) / 2, F.lit(2.0**-1022))
    v = (F.col("y") - (F.col("miny") + F.col("maxy")) / 2) / F.greatest((F.col("maxy") - F.col("miny")) / 2, F.lit(2.0**-1022))
    w, z = F.col("weight"), F.col("value")
    terms = {"w": w, "u": w * u, "v": w * v, "uu": w * u * u, "uv": w * u * v, "vv": w * v * v, "z": w * z, "uz": w * u * z, "vz": w * v * z}
    return points.groupBy("surface_id", "minx", "maxx", "miny", "maxy").agg(*(F.sum(x).alias(n) for n, x in terms.items()))


def fit_planes(points: DataFrame, slopes: bool = True, absolute_pivots: bool = False) -> DataFrame:
    """surface_id, a, bx, by, cx, cy, sx, sy: the least-squares plane a + bx (x-cx)/sx + by (y-cy)/sy; singular systems give the weighted mean."""
    m = plane_moments(points)

    def solve(a: pd.Series, *rest: pd.Series) -> pd.DataFrame:
        rows = [plane_coefficients(dict(zip(MOMENTS, r, strict=True)), slopes, absolute_pivots) for r in zip(a, *rest, strict=True)]
        return pd.DataFrame(rows, columns=["a", "bx", "by"])

    p = F.pandas_udf(solve, "a double, bx double, by double")(*MOMENTS)
    return m.select("surface_id", p.alias("p"), *((F.col(f"min{c}") + F.col(f"max{c}")).alias(f"c{c}") / 2 for c in "xy"), *((F.col(f"max{c}") - F.col(f"min{c}")) / 2 for c in "xy")).toDF("surface_id", "p", "cx", "cy", "sx", "sy").select("surface_id", "p.*", "cx", "cy", "sx", "sy")


def evaluate_planes(planes: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surface_id, node_id, z."""
    n = grid_nodes(surfaces).join(planes, "surface_id")
    z = F.col("a") + F.col("bx") * (F.col("x") - F.col("cx")) / F.col("sx") + F.col("by") * (F.col("y") - F.col("cy")) / F.col("sy")
    return n.select("surface_id", "node_id", z.alias("z"))


def structured_variance(residual: DataFrame) -> DataFrame:
    """surface_id, variance of the residuals (surface_id, value, weight, residual) about their weighted mean; at least 1e-12 of the largest value's square."""
    mean = residual.groupBy("surface_id").agg((F.sum(F.col("weight") * F.col("residual")) / F.sum("weight")).alias("mean"))
    d = residual.join(mean, "surface_id").withColumn("d", F.col("residual") - F.col("mean"))
    top = F.greatest(F.lit(1.0), F.max(F.abs("value")))
    return d.groupBy("surface_id").agg(F.greatest(F.sum(F.col("weight") * F.col("d") * F.col("d")) / F.sum("weight"), top * top * 1e-12).alias("variance"))


def effective_ranges(surfaces: DataFrame, major: float, minor: float, azimuth_degrees: float) -> DataFrame:
    """surface_id, major_range, minor_range, cos_azimuth, sin_azimuth; a range of 0 is a fifth of the extent."""
    turn = math.radians(azimuth_degrees)
    return surfaces.select(
        "surface_id", F.when(F.lit(major) > 0, F.lit(float(major))).otherwise((F.col("maxx") - F.col("minx")) * 0.2).alias("major_range"),
        F.when(F.lit(minor) > 0, F.lit(float(minor))).otherwise((F.col("maxy") - F.col("miny")) * 0.2).alias("minor_range"),
        F.lit(math.cos(turn)).alias("cos_azimuth"), F.lit(math.sin(turn)).alias("sin_azimuth"),
    )
