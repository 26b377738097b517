"""License notices in whole texts by an exact set-similarity join, in built-in functions only.

A text is cut into blocks at lines without a word. A block's and a template's
tokens are their distinct shingles of two words; a block matches where it holds at
least THRESHOLD of the template's tokens. Tokens no template has cannot count and
are left out as a block is read. The others are ordered by the number of blocks
that hold them, rarest first, over all documents. A pair that shares ``least``
tokens shares one among the first |T| - least + 1 of the template and the first
|B| - least + 1 of the block; blocks with fewer than ``least`` tokens and places
behind which too few tokens are left are passed over. Each pair is taken at its
first common token only and then counted exactly, so nothing is lost or doubled.

A notice often holds most of a relative's words (the lesser license most of the
general one's): within a family a block keeps the templates it holds most of.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import LOWER, UPPER

#: What stands between words of a lower-cased text, and a line without any.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n"
SHINGLE, THRESHOLD = 2, 0.8

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Family, label and wording of public license notices.
TEMPLATES = [
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                   "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                   "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
                   "the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mozilla", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gnu", "gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gnu", "gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gnu", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                   "the Free Software Foundation"),
    ("gnu", "lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                    "published by the Free Software Foundation"),
    ("gnu", "agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                    "published by the Free Software Foundation"),
    ("cc", "cc-by", "Licensed under CC BY 4.0."),
    ("cc", "cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc", "cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc long", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc long", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc long", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc long", "cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("public domain", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public domain", "unlicense", "This is free and unencumbered software released into the public domain."),
]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Runs of ``width`` words joined by spaces, repeats included; a longer one than the text is null."""
    out = words
    for k in range(1, width):
        out = F.zip_with(out, F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def plain_shingles(text: str, width: int = SHINGLE) -> list[str]:
    """A template's distinct tokens, by the same rule; templates are a parameter, not data."""
    import re

    words = [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]
    return sorted({" ".join(words[i : i + width]) for i in range(len(words) - width + 1)})


def needed(size: int, threshold: float) -> int:
    """Fewest common tokens that reach the threshold."""
    return max(1, math.ceil(round(threshold * size, 9)))


def template_rows(spark: SparkSession, templates: list[tuple[str, str, str]], threshold: float, width: int) -> DataFrame:
    """template, family, label, least, own (tokens): one row per template of at least one token."""
    rows = [(i, f, lab, plain_shingles(t, width)) for i, (f, lab, t) in enumerate(templates)]
    made = [F.struct(F.lit(i).alias("template"), F.lit(f).alias("family"), F.lit(lab).alias("label"), F.lit(needed(len(own), threshold)).alias("least"),
                     F.array(*map(F.lit, own)).alias("own")) for i, f, lab, own in rows if own]
    return spark.range(1).select(F.explode(F.array(*made)).alias("x")).select("x.*") if made else spark.range(0).selectExpr(
        "0 AS template", "'' AS family", "'' AS label", "0 AS least", "array('') AS own")


# --- phrases ---------------------------------------------------------------

def phrase_columns(joined: Column) -> list[Column]:
    """n_base, first_word, last_word, base_labels of a text given as its words, each with a space before it, and a space at the end.

    No phrase ends as one begins, so that places do not overlap and one pattern counts them.
    """
    any_phrase = "(?:" + "|".join(PHRASES) + ")(?= )"
    found = F.coalesce(F.regexp_count(joined, F.lit(f" {any_phrase}")), F.lit(0)).cast("long")
    before = lambda lazy: F.regexp_extract(joined, f"(?s)^(.*{lazy}) {any_phrase}", 1)
    spaces = lambda c: (F.length(c) - F.length(F.translate(c, " ", ""))).cast("long")
    labels = F.array_compact(F.array(*[F.when(F.contains(joined, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()]))
    return [found.alias("n_base"), F.when(found > 0, spaces(before("?"))).alias("first_word"), F.when(found > 0, spaces(before(""))).alias("last_word"),
            F.when(found > 0, labels).otherwise(F.array().cast("array<string>")).alias("base_labels")]


def read_texts(docs: DataFrame, vocabulary: list[str], least: int, width: int) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base_labels and blocks (block, first, tokens) of every document, narrow rows only.

    Blocks with fewer than ``least`` tokens of the vocabulary are left out: no
    template can be met there.
    """
    t = F.col("t")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lowered(F.col("text")).alias("t"))
    own = own.withColumn("b", F.transform(F.split(t, BLANK), lambda x: words_of(x))).withColumn("s", F.transform("b", lambda w: F.size(w)))
    # a phrase can only stand in a text that holds one of its words
    may = F.contains(t, F.lit("license")) | F.contains(t, F.lit("cc"))
    own = own.withColumn("joined", F.when(may, F.concat(F.lit(" "), F.array_join(F.flatten("b"), " "), F.lit(" "))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    tokens = lambda w: F.array_distinct(F.filter(shingles(w, width), lambda x: x.isin(vocabulary)))
    held = F.filter(F.transform("b", lambda w, i: F.struct(i.alias("block"), tokens(w).alias("tokens"))), lambda x: F.size(x["tokens"]) >= least)
    own = own.withColumn("held", held)
    blocks = F.transform("held", lambda x: F.struct(
        x["block"].alias("block"), total(F.slice("s", F.lit(1), x["block"])).alias("first"), x["tokens"].alias("tokens")))
    return own.select("row", "doc_id", total(F.col("s")).alias("n_words"), *phrase_columns(F.col("joined")), blocks.alias("blocks"))


# --- the join --------------------------------------------------------------

def matches(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """row, doc_id, block, first, template, label, common, containment of every block and template that meet the threshold.

    The only shuffles are the count of the vocabulary, which is combined before
    it, and the blocks' own tokens, by row and block.
    """
    blocks = texts.select("row", "doc_id", F.explode("blocks").alias("x")).select("row", "doc_id", "x.*")
    pairs = blocks.select("row", "doc_id", "block", "first", F.explode("tokens").alias("token"))
    seen = pairs.groupBy("token").agg(F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    left = pairs.join(seen, "token").groupBy("row", "doc_id", "block", "first").agg(in_order.alias("bt"))
    right = templates.select("template", "family", "label", "least", F.explode("own").alias("token")).join(seen, "token", "left")
    right = right.withColumn("n", F.coalesce("n", F.lit(0))).groupBy("template", "family", "label", "least").agg(in_order.alias("tt"))
    size = lambda c: F.size(c)
    prefix = right.select("*", F.posexplode(F.slice("tt", F.lit(1), size("tt") - F.col("least") + 1)).alias("i", "token"))
    left = left.select("*", F.posexplode("bt").alias("j", "token"))
    long_enough = size("bt") >= F.col("least")
    in_prefix = F.col("j") <= size("bt") - F.col("least")
    enough_left = F.least(size("tt") - F.col("i"), size("bt") - F.col("j")) >= F.col("least")
    first_common = ~F.arrays_overlap(F.slice("bt", F.lit(1), F.col("j")), F.slice("tt", F.lit(1), F.col("i")))
    met = left.join(prefix, "token").filter(long_enough & in_prefix & enough_left & first_common)
    met = met.withColumn("common", size(F.array_intersect("bt", "tt"))).filter("common >= least")
    met = met.withColumn("containment", F.col("common") / size("tt"))
    best = F.max("containment").over(Window.partitionBy("row", "block", "family"))
    return met.withColumn("best", best).filter("containment = best").select("row", "doc_id", "block", "first", "template", "label", "common", "containment")


def prepared(docs: DataFrame, templates: list[tuple[str, str, str]], threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    own = [plain_shingles(t, width) for _, _, t in templates]
    vocabulary = sorted({token for tokens in own for token in tokens})
    least = min((needed(len(tokens), threshold) for tokens in own if tokens), default=1)
    texts = stage(read_texts(docs, vocabulary or [""], least, width), "license-texts")
    return texts, matches(texts, template_rows(docs.sparkSession, templates, threshold, width))


def notices(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """doc_id, block, first (its first word's place), template (number), label, common, containment: one row per block and template met.

    Null texts are empty; equal rows give equal notices each; a template shorter
    than a shingle is never met.
    """
    return prepared(docs, TEMPLATES if templates is None else templates, threshold, width)[1].drop("row")


def scanned(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The score is 1 where a phrase stands, else the largest containment of a notice,
    else 0. Rows without an id, and repeated ones, are told apart by a row number
    that is written with them.
    """
    texts, met = prepared(docs, TEMPLATES if templates is None else templates, threshold, width)
    found = met.groupBy(F.col("row").alias("of_row")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("held"))
    joined = texts.join(found, F.col("row") == F.col("of_row"), "left")
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    labels = F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base_labels")).alias("base_labels"),
                         text(labels).alias("labels"), score.alias("score"))


def oracle(templates: list[tuple[str, str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The result as SQL that compares every block with every template, on two-word shingles."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(i, f, lab, plain_shingles(t, 2)) for i, (f, lab, t) in enumerate(TEMPLATES if templates is None else templates)]
    values = ",\n  ".join(f"({i}, {quoted(f)}, {quoted(lab)}, {needed(len(own), threshold)}, [{', '.join(map(quoted, own))}])" for i, f, lab, own in rows)
    phrases = ", ".join(f"({quoted(label)}, string_split({quoted(p)}, ' '))" for p, label in PHRASES.items())
    split = "list_filter(string_split_regex({0}, '" + BETWEEN + "'), lambda w: w <> '')"
    return f"""
WITH templates(template, family, label, least, own) AS (VALUES
  {values}),
phrases(label, p) AS (VALUES {phrases}),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, {split.format('t')} AS w FROM d),
places AS (
  SELECT row, label, i FROM w, phrases, LATERAL (SELECT unnest(range(len(w) - len(p) + 1)) AS i) WHERE w[i + 1:i + len(p)] = p),
base AS (
  SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base_labels FROM places GROUP BY row),
blocks AS (SELECT row, unnest(range(len(b))) AS block, unnest(b) AS b FROM (SELECT row, string_split_regex(t, '{BLANK}') AS b FROM d)),
block_words AS (SELECT row, block, {split.format('b')} AS bw FROM blocks),
tokens AS MATERIALIZED (
  SELECT row, block, list_distinct(list_transform(range(1, len(bw)), lambda i: bw[i] || ' ' || bw[i + 1])) AS bt FROM block_words),
met AS (
  SELECT row, block, family, label, len(list_intersect(bt, own)) / len(own) AS held FROM tokens, templates WHERE len(list_intersect(bt, own)) >= least),
best AS (SELECT row, label, held FROM met QUALIFY held = max(held) OVER (PARTITION BY row, block, family)),
more AS (SELECT row, list(DISTINCT label) AS more, max(held) AS held FROM best GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(held, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN more USING (row)
"""
