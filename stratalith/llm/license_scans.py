"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then nearest-ancestor directory inheritance.

Of each file several passages are taken, each for itself: its notice (the lines that name a licence, a copyright or an SPDX id, pooled),
each such line, each paragraph and each run of comment lines that speaks of licences or grants (``HINT``), these paragraphs pooled, and of
files named LICENSE, COPYING, NOTICE, ... the whole text. Paragraphs are divided by lines without letters and digits. Passages and
templates are bags of words;
a word weighs its count times the inverse document frequency among the templates (words of none weigh as much as the rarest), in whole
thousandths, so that sums do not depend on their order. The best template by cosine, if it reaches ``min_percent``, is the passage's
licence; the file's own is that of its best passage: a whole text whose template has more than ``NOTICE_WORDS`` words (full texts and
headers, which quote notices) before all others, then the higher score, then the longer passage. A whole text that is a notice among other
words stands behind the notice itself. A mere reservation of rights (``RESERVED``) counts only where no passage has another licence. A file is a licence file if its name says so or if
its best passage makes up most of its text; then it
also holds for its directory and those below. Any other file without a licence of its own inherits from the nearest ancestor directory
that has a licence file.

Templates (by default ``TEMPLATES`` and ``license_texts``) are a parameter, held in every task; more than ``MAX_TEMPLATE_WORDS`` of their words are joined by a shuffle instead.
Nulls: a null text has no passage, a null path is in no directory. Ties go to the template, or licence file, of the smallest name. Rows
that repeat give one result each. No rows from an empty table. Other columns of files are not read. Equal passages are matched once; two are
taken for equal if 96 bits of hashes agree. Very long texts: a file's passages are held twice at most, beside its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import LOWER, UPPER, cut, hashed

# Short notices as licensors word them, by SPDX id.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction. MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)
NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
CUE = r"licen[sc]e|copyright|spdx|all rights reserved|public domain"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What a paragraph or comment must hold to be a passage: a cue, or a word of grants and disclaimers.
HINT = CUE + r"|permission|redistribut|warrant|unencumbered"
# possessive, so that long runs take no stack
PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
COMMENTS = r"(?m)(?:^[ \t]*+(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*+(?:\n|\z))++"
WORDS = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright[^\n]*?(?:\(c\)|©|[0-9]{4}|<year>|\[y+\])|\(c\)|©)[^\n]*?(?=all rights reserved|$)"
RESERVED = "Proprietary"
MIN_PERCENT, FILE_PERCENT, MAX_TEMPLATE_WORDS = 60, 50, 100_000
#: Fixed value: the longest grant among the templates has 43 words, the shortest full text 67.
NOTICE_WORDS = 50


def low(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bag(text: Column) -> Column:
    """Words, without copyright lines (but for a reservation of rights at their end); an id's 2.0+ is 2.0-or-later."""
    plain = F.regexp_replace(low(text), COPYRIGHT, "")
    return F.regexp_extract_all(F.regexp_replace(plain, r"(gpl-[0-9.]+)\+", "$1-or-later"), F.lit(WORDS), F.lit(0))


def template_words(templates: DataFrame) -> DataFrame:
    """template (number), license, word, weight, the template's squared norm and whether it is longer than a notice; templates: number, license, text."""
    tf = templates.select(F.col("number").alias("template"), "license", F.explode(bag(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = templates.count()
    w = tf.join(df, "word").withColumn("weight", F.col("tf") * _idf(F.col("df"), n))
    sums = w.groupBy("template").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm2"), (F.sum("tf") > NOTICE_WORDS).alias("long"))
    return w.join(sums, "template").select("template", "license", "word", "weight", "norm2", "long", "df")


def _idf(df: Column, n: int) -> Column:
    return F.floor(F.log(F.lit(float(n + 1)) / df) * 1000 + F.lit(0.5)).cast("long")


def directory(path: Column) -> Column:
    """The path without its last part; '' for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and those above it, down to '', the top."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def default_templates(files: DataFrame) -> DataFrame:
    rows = [(k, name, text) for k, (name, text) in enumerate([*TEMPLATES, *license_texts.templates()])]
    values = ", ".join("({}L, '{}', '{}')".format(k, a, b.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")) for k, a, b in rows)
    return files.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(number, license, text)")


def named(path: Column) -> Column:
    """Whether the path's last part is a licence file's name."""
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(NAMES)


def passages() -> Column:
    """The passages of a file (path, text): array of structs text, whole, n (its length), key (hashes); empty for most files."""
    text, whole = F.coalesce(F.col("text"), F.lit("")), F.coalesce(named(F.col("path")), F.lit(False))
    cues = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("(?i)" + CUE))
    hints = F.filter(F.split(text, PARAGRAPHS, -1), lambda x: x.rlike("(?i)" + HINT))
    comments = F.filter(F.regexp_extract_all(text, F.lit(COMMENTS), F.lit(0)), lambda x: x.rlike("(?i)" + HINT))
    parts = F.array_distinct(F.concat(F.array(F.array_join(cues, "\n"), F.array_join(hints, "\n")), cues, hints, comments))
    parts = F.when(text.rlike("(?i)" + HINT), parts).otherwise(F.array().cast("array<string>"))
    parts = F.when(whole, F.array_union(F.array(text), parts)).otherwise(parts)
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(x.alias("text"), (whole & (x == text)).alias("whole"), F.length(x).alias("n"), F.struct(*hashed(x)).alias("key")))


def scan(files: DataFrame, templates: DataFrame | None = None, min_percent: int = MIN_PERCENT, file_percent: int = FILE_PERCENT) -> DataFrame:
    """path, file_id, license, score (whole percent of the own match), origin (own, file, inherited, none), license_path, for each row of files (file_id, path, text)."""
    templates = default_templates(files) if templates is None else templates
    words = cut(template_words(templates))
    vocabulary = words.groupBy("word").agg(F.max("df").alias("df"))
    if words.count() <= MAX_TEMPLATE_WORDS:
        words, vocabulary = F.broadcast(words), F.broadcast(vocabulary)
    # texts are searched once; rows get a number, as ids may repeat
    rows = cut(files.select(F.monotonically_increasing_id().alias("row"), "file_id", "path", F.length(F.coalesce("text", F.lit(""))).alias("n_text"), passages().alias("passages")))
    # equal passages are matched once, however many files have them
    texts = rows.select(F.explode("passages").alias("p")).groupBy("p.key").agg(F.min("p.text").alias("text"))
    tf = cut(texts.select("key", F.explode(bag(F.col("text"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf")))
    n = templates.count()
    tf = tf.join(vocabulary, "word", "left").select("key", "word", (F.col("tf") * _idf(F.coalesce("df", F.lit(1)), n)).alias("w"))
    norms = tf.groupBy("key").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    dots = tf.join(words, "word").groupBy("key", "template", "license", "norm2", "long").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    score = F.floor(F.col("dot") * 100.0 / F.sqrt(F.col("n2").cast("double") * F.col("norm2")) + F.lit(1e-6)).cast("long")
    best = dots.join(norms, "key").select("key", score.alias("score"), "license", "template", "long").filter(F.col("score") >= min_percent)
    best = best.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "template", "long")).alias("b")).select("key", (-F.col("b.s")).alias("score"), F.col("b.license").alias("license"), F.col("b.long").alias("long"))
    # a table of its own, so that a passage of many files can be split
    best = cut(best)
    held = rows.select("row", F.explode("passages").alias("p")).select("row", "p.whole", "p.n", "p.key").join(best, "key")
    order = F.struct((F.col("license") == RESERVED).alias("reserved"), (~(F.col("whole") & F.col("long"))).alias("part"), (-F.col("score")).alias("s"), (-F.col("n")).alias("n"), "license")
    own = held.groupBy("row").agg(F.min(order).alias("b")).select("row", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (-F.col("b.n")).alias("n_held"))
    owned = rows.drop("passages").join(own, "row", "left")
    is_file = F.col("license").isNotNull() & F.coalesce(named(F.col("path")) | (F.col("n_held") * 100 >= F.col("n_text") * file_percent), F.lit(False))
    owned = cut(owned.select("file_id", "path", "license", "score", is_file.alias("is_file"), directory(F.col("path")).alias("dir")))
    heads = owned.filter(F.col("is_file") & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "license")).alias("head"))
    # each directory finds its nearest head once; then files look up their directory
    folders = owned.filter(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    up = folders.select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    near = up.join(heads.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "head")).alias("x")).select("dir", F.col("x.head").alias("head"))
    near = cut(near)
    out = owned.join(near, "dir", "left")
    got = F.col("license").isNull() & F.col("head").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "own").when(got, "inherited").otherwise("none")
    return out.select(
        "file_id", "path", F.coalesce("license", "head.license").alias("license"), "score", origin.alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).when(got, F.col("head.path")).alias("license_path"),
    )
