"""Licence notices by an exact set-similarity join of text blocks with notice templates.

A block is a line, or the words around the end of a line (``reach`` on each side, blank lines skipped), so that
a notice wrapped over lines stands in one block; blocks and templates are sets of words. A block meets a template of size s if it
contains at least ``ceil(threshold * s)`` of its words. Words are ordered by their frequency over all
documents, rarest first. The join uses three filters that lose nothing: a block must hold a word of the
template's prefix (its s - needed + 1 rarest words), at least ``needed`` template words in all (length), and
enough of them from the matching word on (position). Survivors are verified on the full sets.

Only DataFrame functions are used. Words that are in no template cannot add to an overlap, so a block is
carried as its template words; one pass over the texts gives these, the frequencies and the base phrases.

Defined cases: null and empty texts have no words, no labels, null positions and score 0; rows with equal
ids are separate; texts and lines of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Short public licence notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.8


def _needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def lower_words(c: Column) -> Column:
    """Words of a text, A-Z folded. Other letters are folded too, which no comparison here can see, as all
    templates are ASCII; the one character that folds into ASCII (the Kelvin sign) is replaced first."""
    plain = F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("K"), F.lit("é")))
    return F.filter(F.split(plain, BREAK), lambda w: w != "")


def reach(templates=TEMPLATES, threshold: float = THRESHOLD) -> int:
    """Words that a notice may span: the longest template, with room for words put in."""
    return math.ceil(max(len(t.split()) for _, t in templates) / threshold - 1e-9)


def _joined(lines: Column) -> Column:
    """All words, each line that has some closed by a line end (which no word holds)."""
    return F.flatten(F.transform(F.filter(lines, lambda ws: F.size(ws) > 0), lambda ws: F.concat(ws, F.array(F.lit("\n")))))


def _around_ends(words: Column, known: Column, width: int) -> Column:
    """Template words around each line end of a ``_joined`` column: a run of ``width`` words over line ends is whole in
    the block of its first."""
    def block(e: Column) -> Column:
        before = F.slice(words, F.greatest(e - width, F.lit(0)) + 1, F.least(e, F.lit(width)))
        after = F.slice(F.array_remove(F.slice(words, e + 2, 2 * width), "\n"), 1, width)
        return F.array_intersect(F.concat(before, after), known)

    ends = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.get(words, i) == "\n")
    return F.when(F.size(words) > 1, F.transform(ends, block)).otherwise(F.array().cast("array<array<string>>"))


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        ok = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == p)
        return ok

    rare = max(parts, key=len) if "cc" not in parts else "cc"
    none = F.array().cast("array<int>")
    return F.when(F.array_contains(words, rare), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(none)


def read_texts(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One written row per document: counts, base places, template words seen, and possible blocks."""
    vocab = sorted({w for _, t in templates for w in t.split()})
    least = min(_needed(len(set(t.split())), threshold) for _, t in templates)
    known = F.array(*[F.lit(w) for w in vocab])
    df = docs.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lower_words).alias("lines"))
    df = df.select("doc_id", "lines", _joined(F.col("lines")).alias("joined"))  # a column, so lambdas do not build it again
    df = df.select("doc_id", F.flatten("lines").alias("words"),
                   F.concat(F.transform("lines", lambda ws: F.array_intersect(ws, known)),
                            _around_ends(F.col("joined"), known, reach(templates, threshold))).alias("hits"))
    places = [_starts(F.col("words"), p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)]
    df = df.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", *places)
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    return X.written(df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_distinct(labels).alias("base"), F.array_distinct(F.flatten("hits")).alias("seen"),
        F.array_distinct(F.filter("hits", lambda h: F.size(h) >= least)).alias("blocks")), "licences")


def join_blocks(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) of every block and template at or above the threshold."""
    spark = texts.sparkSession
    # at most one row per template word reaches the driver
    seen = {r.w: r.c for r in texts.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).collect()}
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, t in templates:
        words = sorted(set(t.split()), key=rank.get)
        need = _needed(len(words), threshold)
        index += [(w, label, words, len(words), need, q) for q, w in enumerate(words[:len(words) - need + 1])]
    prefix = spark.createDataFrame(index, "word string, label string, template array<string>, size int, need int, q int")
    by_rank = F.array(*[F.lit(w) for w in order])
    blocks = (texts.select("row", F.explode("blocks").alias("block"))
              .select("row", F.array_intersect(by_rank, F.col("block")).alias("block")))
    probes = blocks.select("row", "block", F.posexplode("block").alias("p", "word"))
    met = (probes.join(F.broadcast(prefix), "word")  # the prefix index is fixed by the templates
           .where((F.size("block") >= F.col("need"))
                  & (1 + F.least(F.size("block") - F.col("p") - 1, F.col("size") - F.col("q") - 1) + F.least("p", "q") >= F.col("need"))))
    overlap = F.size(F.array_intersect("block", "template"))
    return met.where(overlap >= F.col("need")).select("row", "label", (overlap / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base places, labels and score of every document; the score is the best containment found (1 for a phrase)."""
    texts = read_texts(docs, templates, threshold)
    found = (join_blocks(texts, templates, threshold).groupBy("row")
             .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")))
    out = texts.drop("seen", "blocks").join(found, "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
                      F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"))
