"""Bending energy on grids by windows over rows and columns, and resampling between grids.

One application of the operator is a plan that DuckDB can check; the solvers repeat it as array slices in kernels.convergent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import grid_nodes


def row():
    return W.partitionBy("surface_id", "iy").orderBy("ix")


def column():
    return W.partitionBy("surface_id", "ix").orderBy("iy")


def _scales() -> tuple[Column, Column, Column]:
    """1/dx^2, 1/dy^2 and 1/(dx dy) in units of the larger extent, each already times the root of the cell's area."""
    h = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    dx, dy = (F.col("maxx") - F.col("minx")) / (F.col("nx") - 1) / h, (F.col("maxy") - F.col("miny")) / (F.col("ny") - 1) / h
    area = dx * dy
    return area / (dx * dx * dx * dx), area / (dy * dy * dy * dy), area * 2 / (dx * dx * dy * dy)


def _off(x: Column | str, over, n: int) -> Column:
    """The value n places away, 0 beyond the edge."""
    return F.coalesce(F.lag(x, n).over(over) if n > 0 else F.lead(x, -n).over(over), F.lit(0.0))


def curvature(nodes: DataFrame, surfaces: DataFrame, smoothness: float = 1.0) -> DataFrame:
    """surface_id, node_id, kz: K z for nodes (surface_id, node_id, z)."""
    sxx, syy, sxy = _scales()
    g = grid_nodes(surfaces).join(nodes, ["surface_id", "node_id"]).join(surfaces.select("*", sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy")), "surface_id")
    z, inx, iny = F.col("z"), F.col("ix").between(1, F.col("nx") - 2), F.col("iy").between(1, F.col("ny") - 2)
    g = g.withColumn("rx", F.when(inx, F.lag(z).over(row()) - z * 2 + F.lead(z).over(row())).otherwise(0.0))
    g = g.withColumn("along", F.lead(z).over(row()) - z).withColumn("kx", _off("rx", row(), 1) - F.col("rx") * 2 + _off("rx", row(), -1))
    g = g.withColumn("ry", F.when(iny, F.lag(z).over(column()) - z * 2 + F.lead(z).over(column())).otherwise(0.0))
    g = g.withColumn("twist", F.coalesce(F.lead("along").over(column()) - F.col("along"), F.lit(0.0))).withColumn("ky", _off("ry", column(), 1) - F.col("ry") * 2 + _off("ry", column(), -1))
    g = g.withColumn("t", F.col("twist") - _off("twist", column(), 1)).withColumn("kt", F.col("t") - _off("t", row(), 1))
    kz = (F.col("kx") * F.col("sxx") + F.col("ky") * F.col("syy") + F.col("kt") * F.col("sxy")) * F.lit(float(smoothness))
    return g.select("surface_id", "node_id", kz.alias("kz"))


def curvature_diagonal(surfaces: DataFrame, smoothness: float = 1.0) -> DataFrame:
    """surface_id, node_id, d: the diagonal of K, from the number of stencils that touch a node."""
    sxx, syy, sxy = _scales()
    g = grid_nodes(surfaces).join(surfaces.select("*", sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy")), "surface_id")

    def triples(i: Column, n: Column) -> Column:
        middle = F.when(i.between(1, n - 2), 4.0).otherwise(0.0)
        return middle + F.when(i.between(2, n - 1), 1.0).otherwise(0.0) + F.when(i.between(0, n - 3), 1.0).otherwise(0.0)

    cells = F.when(F.col("ix").between(1, F.col("nx") - 2), 2.0).otherwise(1.0) * F.when(F.col("iy").between(1, F.col("ny") - 2), 2.0).otherwise(1.0)
    d = triples(F.col("ix"), F.col("nx")) * F.col("sxx") + triples(F.col("iy"), F.col("ny")) * F.col("syy") + cells * F.col("sxy")
    return g.select("surface_id", "node_id", (d * F.lit(float(smoothness))).alias("d"))


def mean_positive(diagonal: DataFrame) -> DataFrame:
    """surface_id, scale: the mean of the positive finite values of d, 1 if there are none."""
    good = (F.col("d") > 0) & (F.col("d") < float("inf"))
    return diagonal.groupBy("surface_id").agg(F.coalesce(F.avg(F.when(good, F.col("d"))), F.lit(1.0)).alias("scale"))


def resample(nodes: DataFrame, surfaces: DataFrame, nx: int, ny: int) -> DataFrame:
    """surface_id, node_id, z on a grid of nx by ny nodes with the same bounds: bilinear, whatever the cell model."""
    target = surfaces.select("surface_id", "minx", "maxx", "miny", "maxy", F.col("nx").alias("sx"), F.col("ny").alias("sy"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"))
    t = target.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix"))

    def place(i: Column, count: int, source: Column) -> tuple[Column, Column]:
        at = i * ((source - 1).cast("double") / (count - 1))
        cell = F.least(F.floor(at), source.cast("long") - 2)
        return cell, F.least(F.greatest(at - cell, F.lit(0.0)), F.lit(1.0))

    (cx, fx), (cy, fy) = place(F.col("ix"), nx, F.col("sx")), place(F.col("iy"), ny, F.col("sy"))
    t = t.select("surface_id", (F.col("iy").cast("long") * nx + F.col("ix")).alias("target"), "sx", cx.alias("cx"), fx.alias("fx"), cy.alias("cy"), fy.alias("fy"))
    one = F.lit(1.0)
    corners = F.array(*(
        F.struct(((F.col("cy") + b) * F.col("sx") + F.col("cx") + a).cast("long").alias("node_id"), ((F.col("fx") if a else one - F.col("fx")) * (F.col("fy") if b else one - F.col("fy"))).alias("coef"))
        for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))
    ))
    c = t.select("surface_id", "target", F.inline(corners))
    return c.join(nodes, ["surface_id", "node_id"]).groupBy("surface_id", F.col("target").alias("node_id2")).agg(F.sum(F.col("coef") * F.col("z")).alias("z")).withColumnRenamed("node_id2", "node_id")
