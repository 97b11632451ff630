"""The kernels for SQL: table functions and scalar functions, registered on a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class DtwPath:
    def eval(self, a: list, b: list, window: float, warp_penalty: float):
        from stratalith.kernels.warping import align
        from stratalith.options import WarpOptions

        r = align(a, b, WarpOptions(window=float(window), warp_penalty=float(warp_penalty)))
        for k, ((i, j), cost) in enumerate(zip(r.path.tolist(), r.local_cost.tolist(), strict=True)):
            yield k, i, j, cost


class GridNodes:
    def eval(self, minx: float, maxx: float, miny: float, maxy: float, nx: int, ny: int):
        from stratalith.options import Surface

        g = Surface(float(minx), float(maxx), float(miny), float(maxy), nx, ny)
        for iy in range(ny):
            for ix in range(nx):
                yield iy * nx + ix, ix, iy, g.minx + ix * g.dx, g.miny + iy * g.dy


def register(spark: SparkSession) -> None:
    """dtw_path(a, b, window, penalty) and grid_nodes(minx, maxx, miny, maxy, nx, ny) as table functions, matrix_rank and normals as functions."""
    from ..kernels.linear import rank
    from ..kernels.twister import Normals

    spark.udtf.register("dtw_path", F.udtf(DtwPath, returnType="path_index: int, i: int, j: int, local_cost: double"))
    spark.udtf.register("grid_nodes", F.udtf(GridNodes, returnType="node_id: long, ix: int, iy: int, x: double, y: double"))

    def matrix_rank(m: pd.Series, tolerance: pd.Series) -> pd.Series:
        return pd.Series([rank(np.array([list(r) for r in x], float), float(t)) for x, t in zip(m, tolerance, strict=True)], dtype="int32")

    def normals(seed: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([Normals(int(s) % (1 << 64)).draw(int(k)) for s, k in zip(seed, n, strict=True)])

    spark.udf.register("matrix_rank", F.pandas_udf(matrix_rank, "int"))
    spark.udf.register("normals", F.pandas_udf(normals, "array<double>"))
