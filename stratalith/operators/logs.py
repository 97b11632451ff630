"""Cleaning, resampling and normalising of curves, as plans over any number of logs.

Rows are (log_id, md, value) with null for missing. Every operator keeps log_id as its partitioning key; the windows of one log share
one shuffle. A log has at most max_resampled_points rows after resampling, so its partition is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidInput, ResourceLimit
from ..functions.numbers import is_finite, nan_to_null, ulp
from ..options import LogOptions, require
from ..tables import cut


def by_log():
    return W.partitionBy("log_id")


def downwards():
    return by_log().orderBy("md")


def clean(raw: DataFrame, missing_values: tuple[float, ...]) -> DataFrame:
    """Means by depth of the values that are there. Sentinels are missing in the curve only; rows without depth, then depths without value, go."""
    rows = raw.select("log_id", nan_to_null(F.col("md").cast("double")).alias("md"), nan_to_null(F.col("value").cast("double")).alias("value"))
    if missing_values:
        rows = rows.withColumn("value", F.when(~F.col("value").isin(*map(float, missing_values)), F.col("value")))
    # -0.0 and 0.0 are one depth
    return rows.filter("md IS NOT NULL").groupBy("log_id", (F.col("md") + F.lit(0.0)).alias("md")).agg(F.avg("value").alias("value")).filter("value IS NOT NULL")


def gaps(cleaned: DataFrame) -> DataFrame:
    """log_id, md, next_md, gap between neighbouring depths."""
    after = F.lead("md").over(downwards())
    return cleaned.select("log_id", "md", after.alias("next_md"), (after - F.col("md")).alias("gap")).filter("next_md IS NOT NULL")


def median_steps(cleaned: DataFrame) -> DataFrame:
    return gaps(cleaned).groupBy("log_id").agg(F.median("gap").alias("step"))


def common_step(cleaned: DataFrame) -> DataFrame:
    """One row: the median of the logs' median steps, each log weighing the same."""
    steps = median_steps(cleaned).filter(is_finite(F.col("step")) & (F.col("step") > 0))
    return steps.agg(F.median("step").alias("step"))


def _magnitude(*parts: Column) -> Column:
    return F.greatest(*(F.abs(p) for p in parts), F.lit(1.0))


def wide_gaps(cleaned: DataFrame, step: float, limit: float | None) -> DataFrame:
    """log_id and its largest gap over the limit (ten steps unless given): md, next_md, gap."""
    bound = step * 10 if limit is None else limit
    ends = cleaned.groupBy("log_id").agg(F.min("md").alias("top"), F.max("md").alias("bottom"))
    ends = ends.select("log_id", F.greatest(F.lit(step * 1e-9), ulp(_magnitude(F.col("top"), F.col("bottom"))) * 8).alias("tolerance"))
    over = gaps(cleaned).join(ends, "log_id").filter(F.col("gap") > F.lit(bound) + F.col("tolerance"))
    # of equal gaps the uppermost
    return over.groupBy("log_id").agg(F.max_by(F.struct("md", "next_md", "gap"), F.struct("gap", -F.col("md"))).alias("g")).select("log_id", "g.*")


def grid_plan(cleaned: DataFrame, step: float) -> DataFrame:
    """log_id, top, bottom, intervals, append_end, n, tolerance: the regular grid of each log."""
    return grid_plan_of(cleaned.groupBy("log_id").agg(F.min("md").alias("top"), F.max("md").alias("bottom")), step)


def grid_plan_of(ends: DataFrame, step: float) -> DataFrame:
    span = F.col("bottom") - F.col("top")
    small = ulp(_magnitude(F.col("top"), F.col("bottom"), F.lit(step)))
    p = ends.withColumn("ratio", span / F.lit(step)).withColumn("ulp", small).withColumn("tolerance", F.greatest(F.lit(step * 1e-10), small * 4))
    first = F.when(F.col("ratio") < 9e15, F.floor("ratio"))
    p = p.withColumn("intervals", first - (F.col("top") + first * F.lit(step) > F.col("bottom") + F.col("tolerance")).cast("int"))
    p = p.withColumn("append_end", F.abs(F.col("top") + F.col("intervals") * F.lit(step) - F.col("bottom")) > F.col("tolerance"))
    return p.withColumn("n", F.col("intervals") + 1 + F.col("append_end").cast("int"))


def regular_grid(plan: DataFrame, step: float) -> DataFrame:
    """log_id, idx, md: depths top + k step; the last one is the log's end."""
    rows = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("idx"))
    return rows.select("log_id", "idx", F.when(F.col("idx") == F.col("n") - 1, F.col("bottom")).otherwise(F.col("top") + F.col("idx") * F.lit(step)).alias("md"))


def interpolate(grid: DataFrame, knots: DataFrame) -> DataFrame:
    """log_id, idx, md, value: linear between the knots around each depth.

    A knot knows the next one, so knots and depths in one order need the last knot so far only: two sorts and a running window, linear in
    a log's length, and no range join.
    """
    after = [F.lead(c).over(downwards()).alias(f"next_{c}") for c in ("md", "value")]
    k = knots.select("log_id", "md", "value", *after).select("log_id", F.lit(None).cast("int").alias("idx"), "md", F.struct("md", "value", "next_md", "next_value").alias("knot"))
    g = grid.select("log_id", "idx", "md", F.lit(None).cast("struct<md:double,value:double,next_md:double,next_value:double>").alias("knot"))
    down = by_log().orderBy("md", F.col("idx").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = k.unionByName(g).select("log_id", "idx", "md", F.last("knot", ignorenulls=True).over(down).alias("k")).filter("idx IS NOT NULL")
    slope = (F.col("k.next_value") - F.col("k.value")) / (F.col("k.next_md") - F.col("k.md"))
    value = F.when(F.col("k.next_md").isNull() | (F.col("k.md") == F.col("md")), F.col("k.value")).otherwise(slope * (F.col("md") - F.col("k.md")) + F.col("k.value"))
    return rows.select("log_id", "idx", "md", value.alias("value"))


def normalise(rows: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    """rows with z: centred on the middle of the range, scaled to it, clipped at two percentiles if wanted, then a z-score by the population's variance."""
    low, high = F.min("value").over(by_log()), F.max("value").over(by_log())
    r = rows.withColumn("_s", F.col("value") - (low / 2 + high / 2))
    r = r.withColumn("_m", F.max(F.abs("_s")).over(by_log())).withColumn("_s", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")))
    if clip is not None:
        a, b = (F.expr(f"percentile(_s, {p / 100!r}D)").over(by_log()) for p in clip)
        r = r.withColumn("_a", a).withColumn("_b", b).withColumn("_s", F.least(F.greatest("_s", "_a"), "_b"))
    r = r.withColumn("_c", F.col("_s") - F.avg("_s").over(by_log()))
    r = r.withColumn("_v", F.sqrt(F.avg(F.col("_c") * F.col("_c")).over(by_log())))
    return r.select(*rows.columns, F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).alias("z"))


def summary(raw: DataFrame, cleaned: DataFrame, step: float, options: LogOptions) -> DataFrame:
    """log_id, problem, detail: one row for each log that cannot be prepared with this step, by one pass over the cleaned rows."""
    seen = raw.groupBy("log_id").agg(F.max(F.coalesce((F.abs("md") == float("inf")) | (F.abs("value") == float("inf")), F.lit(False))).alias("infinite"))
    after = F.lead("md").over(downwards())
    rows = cleaned.select("*", after.alias("next_md"), (after - F.col("md")).alias("gap"))
    widest = F.max_by(F.struct("md", "next_md", "gap"), F.struct("gap", -F.col("md")))
    bounds = rows.groupBy("log_id").agg(
        F.count("*").alias("rows"), F.min("md").alias("top"), F.max("md").alias("bottom"), F.max((~is_finite(F.col("value"))).cast("int")).alias("bad"),
        (F.min("value") == F.max("value")).alias("flat"), widest.alias("widest"),
    )
    plan = grid_plan_of(bounds, step)
    limit = step * 10 if options.max_interpolation_gap is None else options.max_interpolation_gap
    tolerance = F.greatest(F.lit(step * 1e-9), ulp(_magnitude(F.col("top"), F.col("bottom"))) * 8)
    too_wide = F.lit(not options.interpolate_all_gaps) & (F.col("widest.gap") > F.lit(limit) + tolerance)
    too_many = F.col("n").isNull() | (F.col("n") > options.max_resampled_points) | (F.col("ratio") > options.max_resampled_points)
    found = seen.join(plan, "log_id", "left").select(
        "log_id",
        F.when(F.col("infinite"), "infinite")
        .when(F.coalesce("rows", F.lit(0)) < 2, "few")
        .when(F.col("bad") == 1, "not finite")
        .when(too_many, "limit")
        .when((F.lit(step) <= F.col("ulp") * 8) | (F.col("n") < 2), "step")
        .when(too_wide, "gap")
        .when(F.col("flat"), "constant")
        .alias("problem"),
        "widest",
    )
    return found.filter("problem IS NOT NULL")


MESSAGES = {
    "infinite": "infinite values", "few": "fewer than two depths with values", "not finite": "values that are not finite", "limit": "its grid has too many points; take a larger step",
    "step": "the step is too small for its depths", "constant": "the curve is constant",
}


def prepare(raw: DataFrame, options: LogOptions | None = None) -> DataFrame:
    """log_id, idx, md, z of every log on its regular grid; raises for logs that the options do not allow.

    One small query finds the first log with a problem, another, where no step is given, the common step.
    """
    o = options or LogOptions()
    cleaned = cut(clean(raw, o.missing_values))  # read for the step, for the problems and for the result
    step = o.step
    if step is None:
        step = common_step(cleaned).first()["step"]
    # without any step no log has two depths; which one says so follows below
    if bad := summary(raw, cleaned, step or 1.0, o).orderBy("log_id").first():
        if bad["problem"] == "gap":
            g = bad["widest"]
            raise InvalidInput(f"log {bad['log_id']}: the gap of {g['gap']:.12g} from {g['md']:.12g} to {g['next_md']:.12g} is too wide")
        raise (ResourceLimit if bad["problem"] == "limit" else InvalidInput)(f"log {bad['log_id']}: {MESSAGES[bad['problem']]}")
    require(step is not None, "no common step can be found")
    out = normalise(interpolate(regular_grid(grid_plan(cleaned, step), step), cleaned), o.clip_percentiles)
    # clipping, or a grid that misses every change, may leave a constant: rare enough to be told when the rows are made
    z = F.when(F.col("z").isNull() | F.isnan("z"), F.raise_error(F.concat(F.lit("log "), F.col("log_id").cast("string"), F.lit(": the curve is constant"))).cast("double")).otherwise(F.col("z"))
    return out.select("log_id", "idx", "md", z.alias("z"))
