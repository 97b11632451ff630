"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble by position.

A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points in at least
``min_docs`` documents loses all its lines, in every document.

Nulls: a null text is one empty line; null ids are one id. Rows that repeat an id count as one document; each gives its own
result row. An empty table gives none. All columns of docs stay as they are, whatever their names; a result whose name one of
them has gets an underscore behind it. Very long texts: a row holds its text, its lines' hashes (16 bytes each) and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, hashed_lines, ids_unique, keys_once, keys_placed

MIN_CHARS, MIN_DOCS = 1, 10
RESULTS = ("n_lines", "n_dropped", "kept_text")


def frequent_keys(lines: DataFrame, min_docs: int, unique: bool) -> DataFrame:
    """h1, h2: the hashes of the keys to drop. Each row sends a key once; counts are summed before the shuffle. unique: no id stands in two rows."""
    count = F.count("*") if unique else F.count_distinct(F.struct("doc_id"))
    return keys_once(lines, "doc_id").groupBy("h1", "h2").agg(count.alias("c")).filter(F.col("c") >= min_docs).select("h1", "h2")


def _deduped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row (the columns of docs) and the results. Only hashes and positions are exploded; each text is shuffled once, to its dropped positions."""
    lines = hashed_lines(docs, min_chars, "doc_id")
    # as a table of its own it is dealt anew for the join below, whose hot keys can then be split
    gone = cut(frequent_keys(lines, min_docs, ids_unique(docs, "doc_id")))
    lost = keys_placed(lines, "doc_id", "th").join(gone, ["h1", "h2"], "left_semi").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("lost"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th"), "lost")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("th"))
    both = rows.join(lost.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("lost_id")) & F.col("th").eqNullSafe(F.col("lost_th")), "left")
    both = both.withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    rest = F.array_join(F.transform(places, lambda p: F.get(F.col("lines"), p)), "\n")
    return both.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(rest).alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text) with n_lines, n_dropped and kept_text."""
    own = docs.columns
    return _deduped(docs, min_chars, min_docs).select(*(F.col("row")[c].alias(c) for c in own), *(F.col(r).alias(free_name(r, own)) for r in RESULTS))


def clean(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs, with all their columns, less the dropped lines; n_chars, if there, follows a text that lost some."""
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _deduped(docs, min_chars, min_docs).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
