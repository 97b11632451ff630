"""Pairs, corridors, local costs and path quality as plans; the warping itself as a fold in SQL and as a grouped kernel."""

from __future__ import annotations

from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels.warping import align_many
from ..options import WarpOptions

FOLDED = 1_000


def along():
    """A pair's path in order (windows need a session, so they are made when used)."""
    return W.partitionBy("pair").orderBy("path_index")


def consecutive_pairs(logs: DataFrame) -> DataFrame:
    """pair, left_id, right_id of neighbours in order (logs: log_id, ord): an equi-join on the next number, no single-task window."""
    ranked = logs.select("log_id", F.col("ord").cast("long").alias("ord"))
    after = ranked.select(F.col("log_id").alias("right_id"), (F.col("ord") - 1).alias("ord"))
    return ranked.join(after, "ord").select(F.col("ord").alias("pair"), F.col("log_id").alias("left_id"), "right_id")


def band(n: Column, m: Column, window: float) -> Column:
    left, right = n.cast("long") - 1, m.cast("long") - 1
    return F.floor(F.lit(float(window)) * (left * right) + F.lit(0.5) * F.greatest(left, right)).cast("long")


def first_column(i: Column, n: Column, m: Column, band: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.ceil((i * (m - 1) - band) / (n - 1))).cast("long")


def last_column(i: Column, n: Column, m: Column, band: Column) -> Column:
    return F.least((m - 1).cast("long"), F.floor((i * (m - 1) + band) / (n - 1)).cast("long"))


def corridor(sizes: DataFrame, window: float) -> DataFrame:
    """pair, i, start, end: the corridor's rows of each pair (pair, n, m)."""
    s = sizes.withColumn("band", band(F.col("n"), F.col("m"), window)).select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    args = (F.col("i"), F.col("n"), F.col("m"), F.col("band"))
    return s.select("pair", "i", first_column(*args).alias("start"), last_column(*args).alias("end"))


def corridor_cells(sizes: DataFrame, window: float) -> DataFrame:
    """pair, i, j: the cells, generated row by row, so that costs join on (pair, j) instead of on a range."""
    return corridor(sizes, window).select("pair", "i", F.explode(F.sequence("start", "end")).alias("j"))


def local_costs(left: DataFrame, right: DataFrame, window: float) -> DataFrame:
    """pair, i, j, local_cost over the corridor of series (pair, i, z) and (pair, j, z)."""
    sizes = left.groupBy("pair").agg(F.count("*").alias("n")).join(right.groupBy("pair").agg(F.count("*").alias("m")), "pair")
    rows = corridor(sizes, window).join(left.withColumnRenamed("z", "za"), ["pair", "i"])
    cells = rows.select("pair", "i", "za", F.explode(F.sequence("start", "end")).alias("j"))
    return cells.join(right.select("pair", F.col("j").cast("long").alias("j"), F.col("z").alias("zb")), ["pair", "j"]).select("pair", "i", F.col("j").cast("int").alias("j"), F.abs(F.col("za") - F.col("zb")).alias("local_cost"))


def packed_local_costs(pairs: DataFrame, window: float) -> DataFrame:
    """The same for series that are packed (pair, a, b: arrays): no join and no shuffle, each pair's cells come from its own row."""
    sized = pairs.select("pair", "a", "b", F.size("a").alias("n"), F.size("b").alias("m")).withColumn("band", band(F.col("n"), F.col("m"), window))
    rows = sized.select("pair", "b", "n", "m", "band", F.posexplode("a").alias("i", "za"))
    args = (F.col("i"), F.col("n"), F.col("m"), F.col("band"))
    cells = F.transform(F.sequence(first_column(*args), last_column(*args)), lambda j: F.struct(j.cast("int").alias("j"), F.abs(F.col("za") - F.get("b", j.cast("int"))).alias("local_cost")))
    return rows.select("pair", "i", F.inline(cells))


def transposed(a: Column, b: Column) -> Column:
    """Whether the second of two arrays goes into the rows."""
    differ = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] != p["y"])
    first = F.get(differ, F.lit(0))
    return F.when(F.size(a) != F.size(b), F.size(a) < F.size(b)).otherwise(F.coalesce(first["x"] < first["y"], F.lit(False)))


def fold_costs(pairs: DataFrame, options: WarpOptions | None = None) -> DataFrame:
    """pair, total_cost, path_length (pair, a, b: arrays) without Python: rows folded over rows, each an array of (cost, length) cells.

    For series of a few hundred values, since a row is copied for each of its cells; the kernel is for longer ones, which raise here.
    """
    o = options or WarpOptions()
    long = F.raise_error(F.concat(F.lit(f"series of more than {FOLDED} values need the kernel: pair "), F.col("pair").cast("string"))).cast("array<double>")
    p = pairs.withColumn("a", F.when(F.greatest(F.size("a"), F.size("b")) > FOLDED, long).otherwise(F.col("a")))
    p = p.withColumn("swap", transposed(F.col("a"), F.col("b")))
    p = p.select("pair", F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("r"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("c"))
    p = p.select("pair", "r", "c", F.size("r").alias("n"), F.size("c").alias("m"))
    p = p.withColumn("band", band(F.col("n"), F.col("m"), o.window))
    cell = "struct<cost:double,length:long,move:int>"
    none = F.lit(None).cast(cell)

    def row(above: Column, i: Column) -> Column:
        lo, hi = first_column(i, F.col("n"), F.col("m"), F.col("band")), last_column(i, F.col("n"), F.col("m"), F.col("band"))

        def put(done: Column, j: Column) -> Column:
            local = F.abs(F.get("r", i) - F.get("c", j))
            diagonal, up, left = F.when(j > 0, F.get(above, j - 1)), F.get(above, j), F.when(j > 0, F.get(done, j - 1))

            def step(of: Column, penalty: float, move: int) -> Column:
                return F.when(of.isNotNull(), F.struct((of["cost"] + F.lit(penalty)).alias("cost"), of["length"].alias("length"), F.lit(move).alias("move")))

            best = F.array_min(F.array_compact(F.array(step(diagonal, 0.0, 1), step(up, o.warp_penalty, 2), step(left, o.warp_penalty, 3))))
            start = F.struct(local.alias("cost"), F.lit(1).cast("long").alias("length"), F.lit(0).alias("move"))
            value = F.struct((best["cost"] + local).alias("cost"), (best["length"] + 1).alias("length"), best["move"].alias("move"))
            here = F.when((j < lo) | (j > hi), none).when((i == 0) & (j == 0), start).when(best.isNotNull(), value)
            return F.concat(done, F.array(here))

        return F.aggregate(F.sequence(F.lit(0), F.col("m") - 1), F.array().cast(f"array<{cell}>"), put)

    last = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array().cast(f"array<{cell}>"), row)
    return p.select("pair", F.element_at(last, -1).alias("x")).select("pair", F.col("x.cost").alias("total_cost"), F.col("x.length").alias("path_length"))


ALIGNED = (
    "pair long, i array<int>, j array<int>, local_cost array<double>, total_cost double, normalized_cost double, mean_local_cost double, warp_penalty double, "
    "diagonal_steps int, up_steps int, left_steps int, max_warp_run int, boundary_fraction double"
)


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs over all tasks: aligning one takes far longer than moving it, so small tables are not put into one task."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def align_pairs(pairs: DataFrame, options: WarpOptions | None = None) -> DataFrame:
    """The alignment of each pair (pair, a, b: arrays), one row per pair; a batch of pairs is in a task at a time."""
    o = asdict(options or WarpOptions())

    def each(batches):
        for pdf in batches:
            out = []
            found = align_many(list(zip(pdf["a"], pdf["b"], strict=True)), WarpOptions(**o))
            for pair, r in zip(pdf["pair"], found, strict=True):
                out.append((pair, r.path[:, 0], r.path[:, 1], r.local_cost, r.total_cost, r.normalized_cost, r.mean_local_cost, r.warp_penalty, r.diagonal_steps, r.up_steps, r.left_steps, r.max_warp_run, r.boundary_fraction))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ALIGNED.split(", ")])

    found = dealt(pairs.select(F.col("pair").cast("long").alias("pair"), "a", "b")).mapInPandas(each, ALIGNED)
    return found.select("pair", F.arrays_zip("i", "j").alias("path"), *(c for c in found.columns if c not in ("pair", "i", "j")))


def path_rows(aligned: DataFrame) -> DataFrame:
    """pair, path_index, i, j, local_cost from packed alignments."""
    rows = aligned.select("pair", F.posexplode(F.arrays_zip("path", "local_cost")).alias("path_index", "x"))
    return rows.select("pair", "path_index", F.col("x.path.i").alias("i"), F.col("x.path.j").alias("j"), F.col("x.local_cost").alias("local_cost"))


def decorate(path: DataFrame, sizes: DataFrame, warp_penalty: float, window: float) -> DataFrame:
    """path rows (pair, path_index, i, j, local_cost) with move, cumulative_cost and boundary_hit; sizes: pair, n, m."""
    return decorate_sized(path.join(sizes.select("pair", "n", "m"), "pair"), warp_penalty, window).drop("n", "m")


def decorate_sized(path: DataFrame, warp_penalty: float, window: float) -> DataFrame:
    """The same for rows that have n and m; all windows share one partitioning."""
    di, dj = F.col("i") - F.lag("i").over(along()), F.col("j") - F.lag("j").over(along())
    move = F.when(di.isNull(), "start").when((di == 1) & (dj == 1), "diagonal").when(di == 1, "up").otherwise("left")
    rows = path.withColumn("move", move)
    paid = F.col("local_cost") + F.when(F.col("move").isin("up", "left"), float(warp_penalty)).otherwise(0.0)
    rows = rows.withColumn("cumulative_cost", F.sum(paid).over(along().rowsBetween(W.unboundedPreceding, W.currentRow)))
    b = band(F.col("n"), F.col("m"), window)
    edge = (F.col("j") == first_column(F.col("i"), F.col("n"), F.col("m"), b)) | (F.col("j") == last_column(F.col("i"), F.col("n"), F.col("m"), b))
    inner = (F.col("path_index") > 0) & F.lead("i").over(along()).isNotNull()
    return rows.withColumn("boundary_hit", edge & inner)


def warp_runs(decorated: DataFrame) -> DataFrame:
    """pair, max_warp_run: the longest run of equal moves that are not diagonal, by islands."""
    new = (F.col("move") != F.lag("move").over(along())) | F.lag("move").over(along()).isNull()
    islands = decorated.select("pair", "move", new.cast("int").alias("new"), "path_index")
    islands = islands.withColumn("island", F.sum("new").over(along().rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = islands.groupBy("pair", "island").agg(F.first("move").alias("move"), F.count("*").alias("n"))
    return runs.groupBy("pair").agg(F.coalesce(F.max(F.when(F.col("move").isin("up", "left"), F.col("n"))), F.lit(0)).cast("int").alias("max_warp_run"))


def path_quality(decorated: DataFrame, warp_penalty: float) -> DataFrame:
    """Costs, step counts and the boundary's share of each pair's path."""
    warps = F.count_if(F.col("move").isin("up", "left"))
    cost = F.sum("local_cost") + F.lit(float(warp_penalty)) * warps
    return decorated.groupBy("pair").agg(
        F.count("*").alias("path_length"), cost.alias("total_cost"), (cost / F.count("*")).alias("normalized_cost"), F.avg("local_cost").alias("mean_local_cost"),
        *(F.count_if(F.col("move") == name).cast("int").alias(f"{name}_steps") for name in ("diagonal", "up", "left")),
        F.avg(F.col("boundary_hit").cast("double")).alias("boundary_fraction"),
    )
