"""Correlation kept up to date while curves arrive.

Raw rows (log_id, md, value) stream in; each micro-batch is appended to the raw table, and the logs that it touches, with their
neighbours, are correlated again from that table. Only their pairs are rewritten: one folder per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs
from ..options import CORRELATE, LogOptions, WarpOptions, require
from ..plans.correlation import correlate_prepared


def start(stream: DataFrame, wells: DataFrame, raw_path: str, out_path: str, checkpoint: str, options: LogOptions, warp: WarpOptions = CORRELATE) -> StreamingQuery:
    """Starts the query; wells (log_id, ord, name) is static and options must hold a step, which all batches share."""
    require(options.step is not None, "a stream needs a fixed step")

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        # a batch that is run again writes the same folder again
        rows.select("log_id", "md", "value").write.mode("overwrite").parquet(f"{raw_path}/batch={number}")
        touched = rows.select("log_id").distinct().join(wells, "log_id")
        pairs = touched.select(F.explode(F.array(F.col("ord").cast("long") - 1, F.col("ord").cast("long"))).alias("pair")).distinct()
        near = wells.join(pairs.select(F.explode(F.array("pair", F.col("pair") + 1)).alias("ord")).distinct(), "ord")
        raw = spark.read.parquet(raw_path).drop("batch").join(near.select("log_id"), "log_id", "left_semi")
        ready = logs.clean(raw, options.missing_values).groupBy("log_id").count().filter("count > 1").select("log_id")
        prepared = logs.prepare(raw.join(ready, "log_id", "left_semi"), options)
        table = correlate_prepared(prepared, near, warp).join(pairs, "pair", "left_semi")
        table.withColumn("part", F.col("pair")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(out_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
