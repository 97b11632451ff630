"""A training corpus from documents, in stages: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Each stage gets what its predecessor kept, as a table that was written and read again. All but the last return the columns of documents;
extra columns stay with their rows and keep their values, whatever their names.

Nulls: a document with a null text has too few words and goes in the first stage; null hosts are one host; documents without id are
never near duplicates of others and stay. Empty and very short texts go in the first stage; a text that line dedup empties stays, as one
end token. Very long texts are read whole by every stage and cut into pieces by packing only. Ties: of equal documents that of smallest id
stays; rows that repeat an id stay or go together in the third stage and each give their pieces. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from stratalith.llm.common import new_folder, remove, scratch, table
from stratalith.session import ship

#: SQL cannot tokenise or pack; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines above the host's limits."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that ten documents share; n_chars follows."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document of smallest id stays; so do documents without id and, of rows that repeat an id, all of that one."""
    found = ngram_join.join(docs).filter("component_id = doc_id OR doc_id IS NULL").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(found["_id"]), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any item go: a single item's passage leaks that item as surely as two would.

    The operator's own flag needs MIN_ITEMS; that limit is for reports, not for a corpus that must not hold test items.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of each document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """A stage that may be called alone: the executors get the package first."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return call


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _shipped(quality)),
    ("line_dedup", _shipped(lines)),
    ("ngram_jaccard_join", _shipped(near_duplicates)),
    ("decontamination", _shipped(decontaminated)),
    ("best_fit_packing", _shipped(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared folder and read again. A stage's table goes when the next one is written, its own tables when its rows are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = new_folder(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
