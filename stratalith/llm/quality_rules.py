"""Quality rules: rules on each text, then cross-document line frequency by host.

A line's key is the line without blanks at its ends, A-Z lower-cased; lines of blanks have none. Keys are hashed (96 bits) and
their distinct documents counted for each host. A key in more than ``min_docs`` documents of a host and in more than
``max_percent`` of a hundred of its documents is above the limits: its lines go, but in the host's document of smallest id,
so that of a group of copies one stays whole. A document is depleted, and rejected, if less than ``min_kept_percent`` of the
characters of its keys are left.

Nulls: a null text is empty, has no words and fails; null hosts are one host; null ids are one id. Rows that repeat an id
count once for a line; each gives its own result row, with what it loses itself, and so do wholly repeated rows. An empty table
gives no rows. score() reads doc_id, source and text only; clean() keeps all columns, whatever their names. Very long texts: a
row holds its words' and windows' ranks, about 40 bytes a word, and 16 bytes for each line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hashed_lines, ids_unique, keys_once, keys_placed, line_key, same, tidy, with_lines

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_DOCS, MAX_PERCENT, MIN_KEPT_PERCENT = 20, 1, 20


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows that stand in the list twice or more. Exact: windows are ranked by doubling, not hashed."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = 1
    while width < size:
        step = min(width, size - width)
        m = len(rank) - step
        pair = rank[:m] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_features(text: str | None) -> tuple[int, int, int, int, int, int]:
    """FEATURES of a text: words, their code points, symbols, repeated lines, words in repeated windows, code points of line keys."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup, keyed = 0, len(text)
    for line in raw.split(b"\n"):
        inner = line.strip()
        keyed -= len(line) - len(inner) + 1
        if inner:
            dup += line in seen
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words), keyed + 1


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars")
LINES = "th long, h1 array<long>, h2 array<int>, n array<int>"
SCHEMA = f"doc_id long, source string, {LINES}, " + ", ".join(f"{x} long" for x in FEATURES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text in its place."""
    for b in batches:
        rows = [text_features(t.as_py()) for t in b.column("text")]
        kept = [c for c in b.schema.names if c != "text"]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], [*kept, *FEATURES])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")


def _above(lines: DataFrame, docs: DataFrame, min_docs: int, max_percent: int) -> DataFrame:
    """source, h1, h2, first: the keys above the limits and the smallest id that has each."""
    count = F.count("*") if ids_unique(docs, "doc_id") else F.count_distinct(F.struct("doc_id"))
    often = keys_once(lines, "doc_id", "source").groupBy("source", "h1", "h2").agg(count.alias("c"), F.min("doc_id").alias("first")).filter(F.col("c") > min_docs)
    hosts = docs.groupBy("source").agg(F.count("*").alias("n_host"))
    return often.join(hosts, same(often, hosts, "source")).filter(F.col("c") * 100 > F.col("n_host") * max_percent).select(often["source"], "h1", "h2", "first")


def _lines(docs: DataFrame) -> DataFrame:
    return hashed_lines(docs, 1, "doc_id", "source")


def removed_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT) -> DataFrame:
    """source, h1, h2, first: the keys above the limits and the smallest id that has each."""
    docs = _keyed(docs)
    return _above(_lines(docs), docs, min_docs, max_percent)


def _lost(lines: DataFrame, docs: DataFrame, min_docs: int, max_percent: int) -> DataFrame:
    """lost_id, lost_source, lost_th (the text's hash), removed, hs: characters and hashes of the keys that a row loses; rows that lose none are not there.

    Equal rows lose the same lines, each in the same place: as a set of places they count once.
    """
    # as a table of its own it is dealt anew for the join below, whose hot keys can then be split
    gone = cut(_above(lines, docs, min_docs, max_percent))
    own = keys_placed(lines, "doc_id", "source", "th")
    hit = own.join(gone, same(own, gone, "source", "h1", "h2") & ~own["doc_id"].eqNullSafe(gone["first"]))
    hit = hit.select(own["doc_id"].alias("lost_id"), own["source"].alias("lost_source"), own["th"].alias("lost_th"), F.struct("pos", own["h1"], own["n"]).alias("line"))
    hit = hit.groupBy("lost_id", "lost_source", "lost_th").agg(F.collect_set("line").alias("ls"))
    removed = F.aggregate("ls", F.lit(0).cast("long"), lambda x, y: x + y["n"])
    return hit.select("lost_id", "lost_source", "lost_th", removed.alias("removed"), F.array_distinct("ls.h1").alias("hs"))


def _at(id_: Column, source: Column, th: Column) -> Column:
    return id_.eqNullSafe(F.col("lost_id")) & source.eqNullSafe(F.col("lost_source")) & th.eqNullSafe(F.col("lost_th"))


def _failed(words: str, repeated: str):
    return (F.col(words) < MIN_WORDS) | (F.col(repeated) * 100 > F.col(words) * MAX_REPEAT_PERCENT)


def score(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """doc_id, source, the features, base_failed, removed_chars, depleted, kept, for each row of docs (doc_id, text, source). Texts are not shuffled."""
    docs = _keyed(docs)
    # texts are read once, for their features and for their lines' hashes
    read = cut(with_lines(docs, 1, "doc_id", "source", "text").mapInArrow(tidy(_features), SCHEMA))
    base, lost = read.select("doc_id", "source", "th", *FEATURES), _lost(read, docs, min_docs, max_percent).drop("hs")
    out = base.join(lost, _at(base["doc_id"], base["source"], base["th"]), "left").select("doc_id", "source", *FEATURES, _failed("n_words", "n_repeat_words").alias("base_failed"), F.coalesce("removed", F.lit(0)).alias("removed_chars"))
    depleted = (F.col("line_chars") - F.col("removed_chars")) * 100 < F.col("line_chars") * min_kept_percent
    return out.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = MAX_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """The kept rows of docs, with all their columns, less the lines above the limits; n_chars, if there, follows the text."""
    whole = docs.schema.fields

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t.as_py()) for t in b.column("row").field("text")]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 4, 5)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "n_words", "n_repeated", "n_keyed"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("th"))
    scored = rows.mapInArrow(tidy(each), T.StructType([*rows.schema.fields, *(T.StructField(x, T.LongType()) for x in ("n_words", "n_repeated", "n_keyed"))]))
    keyed = _keyed(docs)
    lost = _lost(_lines(keyed), keyed, min_docs, max_percent)
    at = _at(F.col("row.doc_id").cast("long"), F.col("row.source").cast("string"), F.col("th"))
    both = scored.filter(~_failed("n_words", "n_repeated")).join(lost.hint("shuffle_hash"), at, "left")
    left = F.col("n_keyed") - F.coalesce("removed", F.lit(0))
    rest = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x: ~F.array_contains("hs", F.xxhash64(line_key(x)))), "\n")
    text = F.when(F.col("hs").isNull(), F.col("row.text")).otherwise(rest)
    kept = both.filter(left * 100 >= F.col("n_keyed") * min_kept_percent).select("row", "hs", text.alias("rest"))
    new = {"text": F.col("rest")}
    for f in whole:
        if f.name == "n_chars":
            new["n_chars"] = F.when(F.col("hs").isNull(), F.col("row.n_chars")).otherwise(F.length("rest").cast(f.dataType))
    return kept.select(*(new.get(f.name, F.col("row")[f.name]).alias(f.name) for f in whole))
