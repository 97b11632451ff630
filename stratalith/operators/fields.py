"""The covariance side of conditional realisations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.covariances import correlation, covariance
from ..kernels.gaussian import Embedding, Model
from ..options import Correlation, GaussianOptions, Surface, require


def conditioning_diagonal(stencil: DataFrame, surfaces: DataFrame, major: float, minor: float, azimuth: float, variance: float, nugget: float, model: Correlation) -> DataFrame:
    """surface_id, point_id, d: the variance of each conditioned value, from its four corners with each other (at most 16 rows a point)."""
    s = stencil.filter("coef <> 0").join(surfaces, "surface_id").select("surface_id", "point_id", "node_id", "coef", (F.col("node_id") % F.col("nx")).alias("ix"), F.floor(F.col("node_id") / F.col("nx")).alias("iy"), ((F.col("maxx") - F.col("minx")) / (F.col("nx") - 1)).alias("dx"), ((F.col("maxy") - F.col("miny")) / (F.col("ny") - 1)).alias("dy"))
    packed = s.groupBy("surface_id", "point_id", "dx", "dy").agg(F.collect_list(F.struct("node_id", "coef", "ix", "iy")).alias("c"))
    two = packed.select("*", F.explode("c").alias("a")).select("*", F.explode("c").alias("b"))
    rho = correlation((F.col("a.ix") - F.col("b.ix")) * F.col("dx"), (F.col("a.iy") - F.col("b.iy")) * F.col("dy"), F.lit(float(major)), F.lit(float(minor)), azimuth, model)
    c = covariance(rho, F.col("a.node_id") == F.col("b.node_id"), F.lit(float(variance)), nugget)
    return two.groupBy("surface_id", "point_id").agg(F.sum(F.col("a.coef") * F.col("b.coef") * c).alias("d"))


def spectra(surfaces: DataFrame, options: GaussianOptions) -> DataFrame:
    """surface_id, fx, fy, eigenvalue: the spectrum that realisations of each surface are drawn with; the options must hold ranges and variance."""
    o = options
    require(min(o.major_range, o.minor_range, o.structured_variance) > 0, "a spectrum needs ranges and a variance")
    turn = math.radians(o.azimuth_degrees)
    model = Model(o.correlation, o.major_range, o.minor_range, math.cos(turn), math.sin(turn), o.structured_variance, o.nugget)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                e = Embedding.of(Surface(r.minx, r.maxx, r.miny, r.maxy, int(r.nx), int(r.ny)), model, o.padding, o.max_expansions).eigenvalues
                ny, nx = e.shape
                yield pd.DataFrame({"surface_id": r.surface_id, "fx": np.tile(np.arange(nx), ny), "fy": np.repeat(np.arange(ny), nx), "eigenvalue": e.ravel()})

    return surfaces.mapInPandas(each, "surface_id int, fx long, fy long, eigenvalue double")
