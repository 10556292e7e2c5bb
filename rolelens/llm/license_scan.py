"""License scans by diagonal voting.

All rolling word k-grams of a document are joined with the positions of the templates' k-grams. A hit at
word p of the document and word t of a template votes for the diagonal p - t, where the template would
begin. Votes are summed per diagonal; neighbouring diagonals of a longer template (words added or left
out in between) are merged, and a span stands if enough of the template's words, and all its telling
words, were hit in place. Phrases of at most ``GRAM`` words are one gram: each hit is a place.

The template table is a constant of the program, so it is broadcast. Only hits and one marker row per
document are shuffled.

Defined results: a NULL or empty text has no words and no labels; repeated rows are scanned one by one;
overlapping places all count. The score is the largest share of a template's words in place, 0 without
any span that stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolelens.llm.text import gram_hashes, hash_words, let, scan_windows, word_array

GRAM = 3
#: Diagonals up to this many words apart belong to one place of a longer template.
BAND = 3
#: Share of a longer template's words that has to stand in place.
MIN_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    telling: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())


# The base phrases with their labels.
PHRASES = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)

# Wordings of common notices, with the words that tell them apart.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are "
             "permitted provided that the following conditions are met", ("redistribution",)),
    Template("cc-by", "licensed under a creative commons attribution 4.0 international license", ("attribution",)),
    Template("cc-by-nc", "licensed under cc by-nc 4.0", ("nc",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation", ("gnu",)),
    Template("mit", "released under the mit license", ("mit",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission", "granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla",)),
)


def _template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """t_no, t_pos, t_words, t_len, t_hash: every gram of every template, and a marker with t_no -1."""
    rows = [(-1, -1, [])]
    for number, template in enumerate(templates):
        words = template.words
        k = min(GRAM, len(words))
        rows += [(number, i, words[i : i + k]) for i in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "t_no int, t_pos int, t_words array<string>")
    lengths = _lengths(templates)

    def own(found: dict[int, Column]) -> Column:
        return F.coalesce(*[F.get(F.when(F.size("t_words") == n, found[n]), F.lit(0)) for n in lengths], F.lit(0).cast("long"))

    hashed = let(hash_words(F.col("t_words")), lambda h: gram_hashes(h, lengths, own))
    return grams.select("*", F.size("t_words").alias("t_len"), hashed.alias("t_hash"))


def _lengths(templates: tuple[Template, ...]) -> list[int]:
    return sorted({min(GRAM, len(t.words)) for t in templates})


def places(documents: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Spans that stand, by word position: _row, doc_id, n_words, t_no, start, end, share.

    Each document has one more row with t_no -1.
    """
    docs = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        let(word_array(F.col("text")), lambda words: scan_windows(words, _lengths(templates))).alias("scan"),
    )
    rows = docs.select(
        "_row", "doc_id", F.size("scan.words").cast("long").alias("n_words"),
        F.col("scan.words").alias("words"), F.explode("scan.grams").alias("g"),
    )
    same = F.slice(F.col("words"), F.col("g.pos") + 1, F.col("t_len")) == F.col("t_words")
    hits = rows.join(
        F.broadcast(_template_grams(documents.sparkSession, templates)),
        (F.col("g.hash") == F.col("t_hash")) & (F.col("g.len") == F.col("t_len")) & ((F.col("t_len") == 0) | same),
    ).select("_row", "doc_id", "n_words", "t_no", "t_len", "t_pos", F.col("g.pos").alias("pos"))

    end = F.col("pos") + F.col("t_len")
    diagonals = hits.groupBy("_row", "doc_id", "n_words", "t_no", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("start"), F.max(end).alias("end"),
        F.collect_set(F.struct("t_pos", "t_len")).alias("votes"),  # at most one per template word
    )
    # neighbouring diagonals: close, and together no longer than the template with some words added
    sizes = F.array(*[F.lit(len(t.words)) for t in templates])
    size = F.coalesce(F.get(sizes, F.col("t_no")), F.lit(0))
    along = Window.partitionBy("_row", "t_no").orderBy("diagonal")
    apart = (size <= GRAM) | (F.col("diagonal") - F.lag("diagonal").over(along) > BAND)
    numbered = diagonals.withColumn("new", F.coalesce(apart.cast("int"), F.lit(1)))
    numbered = numbered.withColumn("place", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("_row", "doc_id", "n_words", "t_no", "place").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.collect_list("votes").alias("votes")
    )
    covered = F.array_distinct(
        F.flatten(F.transform(F.flatten("votes"), lambda v: F.sequence(v["t_pos"], v["t_pos"] + F.greatest(v["t_len"], F.lit(1)) - 1)))
    )
    telling = [
        F.array(*[F.lit(i) for i, w in enumerate(t.words) if w in t.telling]).cast("array<int>") for t in templates
    ]
    found = merged.withColumn("covered", covered).select(
        "_row", "doc_id", "n_words", "t_no", "start", "end",
        F.coalesce(F.try_divide(F.size("covered"), size), F.lit(0.0)).alias("share"),
        (F.size(F.array_except(F.coalesce(F.get(F.array(*telling), F.col("t_no")), F.array().cast("array<int>")), F.col("covered"))) == 0).alias("told"),
    )
    return found.where((F.col("t_no") < 0) | (F.col("told") & (F.col("share") >= MIN_SHARE))).drop("told")


def licenses(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = PHRASES + NOTICES
    names = F.array(*[F.lit(t.label) for t in templates])
    base = F.col("t_no").between(0, len(PHRASES) - 1)
    label = F.when(F.col("t_no") >= 0, F.get(names, F.col("t_no")))

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return (
        places(documents, templates)
        .groupBy("_row", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            joined(label).alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("_row")
    )
