"""Correlation of neighbouring wells, from curves to the 21-column table."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.warping import align_many
from ..operators import alignment, logs
from ..options import CORRELATE, LogOptions, WarpOptions, require
from ..sources.csv_logs import read_curve, read_curves, well_names
from ..tables import cut

COLUMNS = (
    "pair", "left_well", "right_well", "left_md", "right_md", "left_z", "right_z", "local_cost", "mean_cost", "path_index", "move", "cumulative_cost", "total_cost",
    "normalized_cost", "warp_penalty", "diagonal_steps", "up_steps", "left_steps", "max_warp_run", "boundary_hit", "boundary_fraction",
)


def pack(prepared: DataFrame) -> DataFrame:
    """log_id, md, z: a prepared log's arrays in order of depth. A log has a bounded number of points."""
    each = prepared.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("idx", "md", "z"))).alias("x"))
    return each.select("log_id", F.col("x.md").alias("md"), F.col("x.z").alias("z"))


def side_by_side(prepared: DataFrame, wells: DataFrame) -> DataFrame:
    """pair, left_well, right_well, left_md, left_z, right_md, right_z of neighbours (wells: log_id, ord, name; ord counts from 0 without gaps).

    Each log is sent to the two pairs that it is part of, so it is prepared once and there is no self-join.
    """
    log = F.struct(F.col("name").alias("well"), "md", "z")
    ord_ = F.col("ord").cast("long")
    sides = F.array(F.struct(ord_.alias("pair"), F.lit(True).alias("left")), F.struct((ord_ - 1).alias("pair"), F.lit(False).alias("left")))
    rows = pack(prepared).join(wells, "log_id").select(log.alias("log"), F.inline(sides))
    both = rows.groupBy("pair").agg(F.first(F.when(F.col("left"), F.col("log")), ignorenulls=True).alias("a"), F.first(F.when(~F.col("left"), F.col("log")), ignorenulls=True).alias("b"))
    both = both.filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select("pair", *(F.col(f"{side}.{what}").alias(f"{name}_{what}") for side, name in (("a", "left"), ("b", "right")) for what in ("well", "md", "z")))


SCALARS = {"mean_cost": "double", "total_cost": "double", "normalized_cost": "double", "warp_penalty": "double", "diagonal_steps": "int", "up_steps": "int", "left_steps": "int", "max_warp_run": "int", "boundary_fraction": "double"}
ALONG_PATH = {"i": "int", "j": "int", "left_md": "double", "right_md": "double", "left_z": "double", "right_z": "double", "local_cost": "double"}
LINED_UP = "pair long, left_well string, right_well string, n int, m int, " + ", ".join(f"{k} {t}" for k, t in SCALARS.items()) + ", " + ", ".join(f"{k} array<{t}>" for k, t in ALONG_PATH.items())


def line_up(pairs: DataFrame, options: WarpOptions) -> DataFrame:
    """A row for each pair: sizes, the alignment's scalars, and arrays along its path."""
    o = asdict(options)

    def each(batches):
        for pdf in batches:
            out = []
            found = align_many(list(zip(pdf["left_z"], pdf["right_z"], strict=True)), WarpOptions(**o))
            for p, r in zip(pdf.itertuples(index=False), found, strict=True):
                i, j = r.path[:, 0], r.path[:, 1]
                scalars = (r.mean_local_cost, r.total_cost, r.normalized_cost, r.warp_penalty, r.diagonal_steps, r.up_steps, r.left_steps, r.max_warp_run, r.boundary_fraction)
                out.append((p.pair, p.left_well, p.right_well, len(p.left_z), len(p.right_z), *scalars, i, j, p.left_md[i], p.right_md[j], p.left_z[i], p.right_z[j], r.local_cost))
            yield pd.DataFrame(out, columns=["pair", "left_well", "right_well", "n", "m", *SCALARS, *ALONG_PATH])

    return alignment.dealt(pairs).mapInPandas(each, LINED_UP)


def table_of(lined: DataFrame, options: WarpOptions) -> DataFrame:
    """The correlation table of lined-up pairs."""
    path = lined.select("pair", "left_well", "right_well", "n", "m", *SCALARS, F.posexplode(F.arrays_zip(*ALONG_PATH)).alias("path_index", "x"))
    path = path.select(*(c for c in path.columns if c != "x"), *(F.col(f"x.{c}").alias(c) for c in ALONG_PATH))
    return alignment.decorate_sized(path, options.warp_penalty, options.window).select(*COLUMNS)


def correlate_prepared(prepared: DataFrame, wells: DataFrame, options: WarpOptions = CORRELATE) -> DataFrame:
    """The correlation table of prepared logs (log_id, idx, md, z) in the order of wells (log_id, ord, name)."""
    return table_of(line_up(side_by_side(prepared, wells), options), options)


def correlate(
    spark: SparkSession,
    files: Sequence[str | os.PathLike],
    curve: str = "GR",
    md_column: str = "MD",
    *,
    names: Sequence[str] | None = None,
    log_options: LogOptions | None = None,
    warp_options: WarpOptions = CORRELATE,
    progress: Callable[[str], None] | None = None,
) -> DataFrame:
    """Neighbouring files, aligned: A with B, B with C, ... progress gets a line for each pair before the table is returned."""
    require(not isinstance(files, str | bytes | os.PathLike), "files must be a sequence of paths")
    require(len(files) >= 2, "two files at least are needed")
    found = well_names(files, names)
    prepared = logs.prepare(read_curves(spark, files, curve, md_column), log_options)
    wells = spark.createDataFrame([(k, k, name) for k, name in enumerate(found)], "log_id int, ord long, name string")
    lined = line_up(side_by_side(prepared, wells), warp_options)
    if progress is not None:
        lined = cut(lined)  # aligned once, for the lines and for the table
        for r in lined.select("left_well", "right_well", F.size("i").alias("n"), "mean_cost", "normalized_cost", "pair").orderBy("pair").toLocalIterator():
            progress(f"{r['left_well']} -> {r['right_well']}: {r['n']} points, mean cost {r['mean_cost']:.5g}, normalized {r['normalized_cost']:.5g}")
    return table_of(lined, warp_options)


def read_log(spark: SparkSession, path: str | os.PathLike, curve: str = "GR", md_column: str = "MD", options: LogOptions | None = None) -> DataFrame:
    """idx, md, z of one file, cleaned, resampled (at its own median step unless given) and normalised."""
    return logs.prepare(read_curve(spark, path, curve, md_column), options).drop("log_id")
