"""Spelling variants by permuterm rotations.

1. Letter runs are counted over the whole table (partial sums before the shuffle); frequent words are the vocabulary.
2. A word is closed by a terminator and turned so that each of its letters comes last once. Words that agree on such
   a rotation but for its last letter differ by one replaced letter; a word whose whole rotation equals another's
   without the last letter lacks just that letter. So every rotation stands under its prefix (as an edited word) and
   under itself (as a whole word), and all near words are neighbours in the sorted rotations.
3. Groups of equal prefix are scanned once: a group holds one word per letter of the alphabet and one whole word at
   most (``LETTERS + 1``), and gives each of its words a count and its best neighbour, not pairs.
   In a run of equal letters only the first is dropped, so each near pair is counted once.
4. The best neighbour of enough weight is the word's form. Forms are followed to the root by doubling; each step
   multiplies the count by ``ratio`` or more, so the rounds are known from the largest count.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty text in the hash; repeated rows count each; ties go to
the smallest word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

#: letters of a run, in the syntax of Java's expressions; the terminator is none of them
ALPHABET = r"[A-Za-z\u00C0-\u00FF]"
LETTERS = 26 + 64
END = "$"


def noisy(run: Column, doc_id: Column, every: int) -> Column:
    """The run as counted: one letter is missing where ``every`` divides the checksum of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """word and n of the frequent words. Shorter runs cannot reach the length and are not cut out at all."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{ALPHABET}{{{min_length},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), X.lower_ascii(F.col("run"))).otherwise(F.col("run"))
    rows = rows.select("doc_id", low.alias("run")).select(noisy(F.col("run"), F.col("doc_id"), every).alias("word"))
    return (rows.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """key, word, n, whole, first: each word under its rotations (whole) and under those less the last letter.
    ``first``: the letter left out differs from the one before it."""
    closed, length = F.concat("word", F.lit(END)), F.length("word")
    at = F.sequence(F.lit(0), length)  # letters before the turn
    turned = F.transform(at, lambda i: F.struct(
        F.concat(F.substring(closed, i + 1, length + 1), F.substring(F.col("word"), F.lit(1), i)).alias("key"),
        F.lit(True).alias("whole"), F.lit(False).alias("first")))
    edited = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.concat(F.substring(closed, i + 2, length), F.substring(F.col("word"), F.lit(1), i)).alias("key"),
        F.lit(False).alias("whole"),
        ((i == 0) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i + 1, F.lit(1)))).alias("first")))
    return words.select("word", "n", F.explode(F.concat(turned, edited)).alias("r")).select("r.key", "word", "n", "r.whole", "r.first")


def near(words: DataFrame) -> DataFrame:
    """word, n_near and best (struct of the negative count and the word) of all words that have near words."""
    groups = (rotations(words).groupBy("key")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("a"), "word", "whole", "first"))).alias("all"))
              .where(F.size("all") > 1))
    groups = groups.select("all", F.filter("all", lambda m: ~m.whole).alias("cut"), F.filter("all", lambda m: m.whole).alias("full"))
    groups = groups.withColumn("lead", F.filter("cut", lambda m: m.first))

    def named(m: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m.a.alias("a"), m.word.alias("word")))

    def seen(m: Column) -> Column:
        other = F.when(F.get("cut", F.lit(0)).word == m.word, F.get("cut", F.lit(1))).otherwise(F.get("cut", F.lit(0)))
        longer = F.when(m.first, F.get("full", F.lit(0)))
        count = F.when(m.whole, F.size("lead")).otherwise(F.size("cut") - 1 + F.when(m.first, F.size("full")).otherwise(0))
        return F.struct(m.word.alias("word"), count.alias("c"),
                        F.when(m.whole, named(F.get("lead", F.lit(0)))).otherwise(F.least(named(other), named(longer))).alias("best"))

    met = groups.select(F.explode(F.transform("all", seen)).alias("x")).select("x.*").where("c > 0")
    return met.groupBy("word").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of the rows (word, form), for chains of at most ``steps`` forms."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = at.select(F.col("word").alias("next"), F.col("root").alias("far"))
        at = X.written(at.join(ahead, F.col("root") == F.col("next"), "left")
                       .select("word", F.coalesce("far", "root").alias("root")), "roots")
    return at


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word."""
    words = X.written(vocabulary(docs, min_length, min_count, every), "words")
    enough = -F.col("best.a") >= ratio * F.col("n")
    named = X.written(words.join(near(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.a")).alias("form_n")), "forms")
    top = named.agg(F.max("n")).first()[0] or 1
    steps, n = 0, min_count
    while n * ratio <= top:
        steps, n = steps + 1, n * ratio
    linked = X.written(named.where("form is not null").select("word", "form"), "links")
    ends = roots(linked, steps).select(F.col("word").alias("w"), "root")
    return named.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
