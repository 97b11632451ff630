"""The registered queries of the training-data operators: each gets its rows through its operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_formatting, decontamination, license_scans, line_dedup, ngram_join, packing, quality_rules, secret_scans, token_counts, warc
from .common import new_folder, remove, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op1(quality_rules.score(table(spark, sf_dir, "documents")))


def quality_rules_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with limits that bind on small tables too: lines of three documents go, documents that lose a tenth are depleted."""
    return _op1(quality_rules.score(table(spark, sf_dir, "documents"), min_docs=2, max_percent=0, min_kept_percent=90))


def _op1(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "removed_chars", "depleted")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents")).drop("found")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    found = warc.captures(table(spark, sf_dir, "pages"), folder, payload=False)
    remove(spark, folder)  # what was read stands in a table
    digest = F.regexp_replace("response.payload_digest", "^sha256:", "")
    return found.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.kind").alias("record_type"), "refers_to")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    back = chat_formatting.read_back(chat_formatting.format_chats(rows.unionByName(more)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_words",
    )


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with typed parts: every second turn holds its text, an image, its role as a text, an audio and a document part."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    at, fields = "CAST(turn AS STRING)", "'type', {}, 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {}"
    none = "CAST(NULL AS {})".format
    part = lambda kind, text="CAST(NULL AS STRING)", ref="CAST(NULL AS STRING)", width=none("LONG"), height=none("LONG"), seconds=none("DOUBLE"), pages=none("LONG"): f"named_struct({fields.format(repr(kind), text, ref, width, height, seconds, pages)})"
    parts = [
        part("text", "text"), part("image", ref=f"concat('i', {at})", width="CAST(100 * (turn + 1) AS LONG)", height="500L"), part("text", "role"),
        part("audio", ref=f"concat('a', {at})", seconds="turn * 1.5D"), part("document", ref=f"concat('d', {at})", pages="CAST(turn AS LONG)"),
    ]
    rows = rows.withColumn("parts", F.expr(f"CASE WHEN turn % 2 = 0 THEN array({', '.join(parts)}) END"))
    back = chat_formatting.read_back(chat_formatting.format_chats(rows))
    refs = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["number"].cast("string"), a["type"], a["ref"], a["tokens"].cast("string"))), ",")
    parsed = F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], F.concat_ws(":", p["number"].cast("string"), p["ref"])), F.lit("\n")))))
    return back.select(
        "conv_id", "n_turns", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens", "n_words", "formatted_chars",
        F.sha2("formatted", 256).alias("formatted_sha256"), F.sha2(refs, 256).alias("refs_sha256"), F.sha2(F.array_join(parsed, ""), 256).alias("parts_sha256"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source is the repository, lang the directory in it."""
    return _op6(spark, sf_dir, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def license_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in nested directories: by the hex digits h of doc_id's MD5 files are licence files at the repository's top (h1 of 0, 1) or in directory h2 (2 to 5), or other files in h2/h3."""
    h, ident = F.md5(F.col("doc_id").cast("string")), F.col("doc_id").cast("string")
    top, second = F.substring(h, 1, 1), F.substring(h, 2, 1)
    inner = F.when(top < "2", F.concat(F.lit("LICENSE."), ident)).when(top < "6", F.concat(second, F.lit("/COPYING."), ident)).otherwise(F.concat(second, F.lit("/"), F.substring(h, 3, 1), F.lit("/"), ident))
    return _op6(spark, sf_dir, F.concat_ws("/", "source", inner))


def _op6(spark: SparkSession, sf_dir: str, path: Column) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    found = license_scans.scan(files)
    return found.select(F.col("file_id").alias("doc_id"), "path", "license", "score", "origin", "license_path")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_license_scans": op6_license_scans,
    "op7_warc": op7_warc,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "quality_rules_tight": quality_rules_tight,
    "license_directories": license_directories,
    "chat_typed_parts": chat_typed_parts,
}
