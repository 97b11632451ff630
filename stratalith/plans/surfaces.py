"""Surfaces from points: many at once, each solved by one grouped call.

The points of one surface are one group; surfaces, and the seeds of realisations, run side by side. A solver needs its whole grid, so a
surface must fit into a task; everything before and after the solver is relational.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput, status_of
from ..kernels import convergent, gaussian
from ..kernels.convergent import ConvergentReport
from ..kernels.gaussian import GaussianReport
from ..options import ConvergentOptions, GaussianOptions, Surface

SQL = {"int": "long", "float": "double", "bool": "boolean"}
HEADER = ("minx", "maxx", "miny", "maxy", "nx", "ny")


def _report_columns(report: type) -> dict[str, str]:
    return {f.name: SQL[f.type if isinstance(f.type, str) else f.type.__name__] for f in fields(report)}


def _packed(surfaces: DataFrame, points: DataFrame, mask: DataFrame | None, trend: DataFrame | None) -> DataFrame:
    """A row for each surface: header, points in order of their number, active (by node) and trend (by node)."""
    p = points.groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct("point_id", "x", "y", "value", "weight"))).alias("p"))
    out = surfaces.select("surface_id", *HEADER).join(p, "surface_id", "left")
    for name, table, column, kind in (("active", mask, "active", "boolean"), ("trend", trend, "z", "double")):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast(f"array<{kind}>"))
        else:
            v = table.groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.col(column).alias("v")))).alias("s"))
            out = out.join(v.select("surface_id", F.transform("s", lambda x: x["v"]).alias(name)), "surface_id", "left")
    return out


def _points_of(row) -> np.ndarray:
    nan = float("nan")
    values = [[nan if v is None else v for v in (q["x"], q["y"], q["value"], q["weight"])] for q in (row.p if row.p is not None else [])]
    return np.array(values, float).reshape(-1, 4)


def _array(x, kind):
    return None if x is None else np.asarray(x, kind)


#: Node values that a batch of results holds at most, beyond its last surface's.
NODES_AT_ONCE = 2_000_000
Task = tuple[dict[str, int], Callable[[], tuple[np.ndarray, object]]]


def _solved(packed: DataFrame, tasks: Callable[..., Iterable[Task]], report: type, keys: str, on_error: str) -> DataFrame:
    """surface_id (and seed), status, message, z, and the report's columns, of the tasks of each row; with on_error='report' a failed one is a row with its status and message."""
    if on_error not in ("raise", "report"):
        raise InvalidInput("on_error is 'raise' or 'report'")
    columns = _report_columns(report)
    names = [k.split()[0] for k in keys.split(", ")]
    schema = f"{keys}, status string, message string, z array<double>, " + ", ".join(f"{n} {t}" for n, t in columns.items())

    def framed(out: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[*names, "status", "message", "z", *columns])
        for n, t in columns.items():
            frame[n] = frame[n].astype({"long": "Int64", "boolean": "boolean", "double": "float64"}[t])
        return frame

    def each(batches):
        out, held = [], 0
        for row in (row for pdf in batches for row in pdf.itertuples(index=False)):
            for key, solve in tasks(row):
                try:
                    z, r = solve()
                    out.append({"status": "ok", "message": None, "z": z, **asdict(r), **key})
                    held += len(z)
                except Exception as e:
                    if on_error == "raise":
                        raise type(e)(f"{', '.join(f'{k} {v}' for k, v in key.items())}: {e}") from e
                    out.append({"status": status_of(e), "message": str(e), "z": None, **dict.fromkeys(columns), **key})
                if held >= NODES_AT_ONCE:
                    yield framed(out)
                    out, held = [], 0
        yield framed(out)

    return packed.mapInPandas(each, schema)


def _grid(row) -> Surface:
    return Surface(row.minx, row.maxx, row.miny, row.maxy, int(row.nx), int(row.ny))


def nodes_of(solved: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surface_id (and seed), node_id, ix, iy, z of solved surfaces."""
    keys = [c for c in ("surface_id", "seed") if c in solved.columns]
    rows = solved.select(*keys, F.posexplode("z").alias("node_id", "z")).join(surfaces.select("surface_id", "nx"), "surface_id")
    return rows.select(*keys, F.col("node_id").cast("long").alias("node_id"), (F.col("node_id") % F.col("nx")).cast("int").alias("ix"), F.floor(F.col("node_id") / F.col("nx")).cast("int").alias("iy"), "z")


def _spread(packed: DataFrame) -> DataFrame:
    """Surfaces dealt over tasks: solving one takes far longer than moving it."""
    return packed.repartition(max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def interpolate_convergent(surfaces: DataFrame, points: DataFrame, options: ConvergentOptions | None = None, mask: DataFrame | None = None, on_error: str = "raise") -> DataFrame:
    """Minimum-curvature surfaces: surface_id, status, message, z (node values) and the report's columns."""
    o = options or ConvergentOptions()

    def tasks(row):
        yield {"surface_id": row.surface_id}, lambda: convergent.interpolate(_grid(row), _points_of(row), o, _array(row.active, bool))

    return _solved(_spread(_packed(surfaces, points, mask, None)), tasks, ConvergentReport, "surface_id int", on_error)


def simulate_gaussian(surfaces: DataFrame, points: DataFrame, options: GaussianOptions | None = None, seeds: Sequence[int] | None = None, mask: DataFrame | None = None, trend: DataFrame | None = None, on_error: str = "raise") -> DataFrame:
    """Conditional realisations: surface_id, seed, status, message, z and the report's columns, for each surface and seed."""
    o = options or GaussianOptions()
    chosen = [o.seed] if seeds is None else list(seeds)
    for s in chosen:
        replace(o, seed=s)
    # seeds are unsigned; a long carries their bits. A row takes several, so that points and spectrum serve them all.
    signed = [int(s) - (1 << 64 if s >= 1 << 63 else 0) for s in chosen]
    rows = min(len(signed), int(surfaces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = [F.array(*(F.lit(s).cast("long") for s in signed[k::rows])) for k in range(rows)]
    packed = _packed(surfaces, points, mask, trend).select("*", F.explode(F.array(*dealt) if dealt else F.array().cast("array<array<bigint>>")).alias("seeds"))

    def tasks(row):
        ready = functools.cache(lambda: gaussian.Simulation(_grid(row), _points_of(row), o, _array(row.active, bool), _array(row.trend, float)))
        for seed in row.seeds.tolist():
            yield {"surface_id": row.surface_id, "seed": seed}, lambda seed=seed: _signed(ready().realise(seed % (1 << 64)), seed)

    return _solved(_spread(packed), tasks, GaussianReport, "surface_id int, seed long", on_error)


def _signed(solved: tuple[np.ndarray, GaussianReport], seed: int) -> tuple[np.ndarray, GaussianReport]:
    return solved[0], replace(solved[1], seed_used=seed)
