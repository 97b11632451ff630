"""Logs, series and surfaces drawn from the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("click", "error", "purchase", "signup", "view")
FLAGS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as curves: a log for each kind of event, whole hours since 2024 as depth; many depths repeat."""
    e = table(spark, sf_dir, "events")
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    return e.select(number.cast("int").alias("log_id"), hour.cast("double").alias("md"), "value")


def wells(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, {k}L, '{x}')" for k, x in enumerate(KINDS)) + " AS t(log_id, ord, name)")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as series (vec_id, z)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))


def series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, a, b: each series with the next."""
    s = series(spark, sf_dir)
    return s.select(F.col("vec_id").alias("pair"), F.col("z").alias("a")).join(s.select((F.col("vec_id") - 1).alias("pair"), F.col("z").alias("b")), "pair")


def surfaces(spark: SparkSession, nx: int = 50, ny: int = 11) -> DataFrame:
    """One surface for each return flag: quantity 1 to 50 by discount 0 to 10 hundredths."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, 1.0D, 50.0D, 0.0D, 10.0D, {nx}, {ny})" for k in range(len(FLAGS))) + " AS t(surface_id, minx, maxx, miny, maxy, nx, ny)")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as control points: the mean price at each quantity and discount, weighed by its number of lines."""
    item = table(spark, sf_dir, "lineitem")
    number = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    x, y = F.col("l_quantity"), F.floor(F.col("l_discount") * 100 + F.lit(0.5)).cast("double")
    p = item.select(number.cast("int").alias("surface_id"), x.alias("x"), y.alias("y"), "l_extendedprice").groupBy("surface_id", "x", "y")
    p = p.agg(F.avg("l_extendedprice").alias("value"), F.count("*").cast("double").alias("weight"))
    return p.select("surface_id", (F.col("y") * 50 + F.col("x") - 1).cast("long").alias("point_id"), "x", "y", "value", "weight")


def off_nodes(p: DataFrame) -> DataFrame:
    """The points moved off the nodes, into their cells, so that all corners take part."""
    return p.withColumn("x", F.least(F.col("x") + 0.3, F.lit(50.0))).withColumn("y", F.least(F.col("y") + 0.45, F.lit(10.0)))


def flat_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node values of the surfaces: the points' values, 0 where a node has none."""
    from .operators.geometry import grid_nodes

    p = points(spark, sf_dir).select("surface_id", F.col("point_id").alias("node_id"), F.col("value").alias("z"))
    g = grid_nodes(surfaces(spark)).select("surface_id", "node_id")
    return g.join(p, ["surface_id", "node_id"], "left").select("surface_id", "node_id", F.coalesce("z", F.lit(0.0)).alias("z"))


def q(x: Column | str, unit: float = 1e-6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / F.lit(unit) + F.lit(0.501)).cast("long")


def chosen_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve points of each surface, no two in one cell of a grid of 13 by 6."""
    return points(spark, sf_dir).filter("x % 9 = 4 AND y % 5 = 2")


def unit_surfaces(spark: SparkSession) -> DataFrame:
    """8 by 4 nodes, a unit apart."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, 0.0D, 7.0D, 0.0D, 3.0D, 8, 4)" for k in range(len(FLAGS))) + " AS t(surface_id, minx, maxx, miny, maxy, nx, ny)")


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven points of each surface in seven cells of the unit grids, prices in thousands."""
    p = points(spark, sf_dir).filter("x <= 7 AND y <= 2 AND (x + y) % 3 = 0")
    return p.select("surface_id", "point_id", (F.col("x") - 1 + 0.3).alias("x"), (F.col("y") + 0.45).alias("y"), (F.col("value") / 1000).alias("value"), "weight")


#: Points in one cell of the grid of 50 by 11: surface, x, y, value; the last four of surface 10 do not lie on a plane.
TRIANGLES = [(s, 1 + x, y, v) for s, top in ((9, 8.0), (10, 9.0)) for x, y, v in ((0.2, 0.2, 1.0), (0.4, 0.2, 3.0), (0.2, 0.6, 5.0), (0.4, 0.4, top - 3.0))]


def troubled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Surfaces, points and masks: the first surface's points with one kind of trouble each."""
    kinds = "0 fine, 1 contradictory pairs, 2 negative weights, 3 outside, 4 not finite, 5 equal pairs, 6 no weight, 7 inactive nodes, 8 a mask too small".split(", ")
    base = points(spark, sf_dir).filter("surface_id = 0").withColumn("surface_id", F.explode(F.array(*(F.lit(int(k.split()[0])) for k in kinds))))
    odd = F.col("point_id") % 7 == 0
    s = F.col("surface_id")
    p = base.select(
        "surface_id", "point_id", F.when((s == 3) & odd, F.col("x") + 60).otherwise(F.col("x")).alias("x"), "y",
        F.when((s == 4) & odd, float("nan")).otherwise(F.col("value")).alias("value"),
        F.when((s == 2) & odd, -F.col("weight")).when(s == 6, 0.0).otherwise(F.col("weight")).alias("weight"),
    )
    twice = base.filter("surface_id IN (1, 5)").select("surface_id", (F.col("point_id") + 10_000).alias("point_id"), "x", "y", F.when(s == 1, F.col("value") + 1).otherwise(F.col("value")).alias("value"), "weight")
    flat = spark.createDataFrame([(k, n, x, y, v, 1.0) for n, (k, x, y, v) in enumerate(TRIANGLES)], "surface_id int, point_id long, x double, y double, value double, weight double")
    header = spark.sql("SELECT CAST(id AS INT) AS surface_id, 1.0D AS minx, 50.0D AS maxx, 0.0D AS miny, 10.0D AS maxy, 50 AS nx, 11 AS ny FROM range(11)")
    mask = spark.sql("SELECT CAST(s.id AS INT) AS surface_id, n.id AS node_id, NOT (s.id = 7 AND n.id % 50 > 30) AS active FROM range(11) s, range(550) n WHERE NOT (s.id = 8 AND n.id >= 500)")
    return header, p.unionByName(twice).unionByName(flat), mask
