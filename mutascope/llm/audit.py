"""Which filter removes what, in every order: path counting over the lattice of filter subsets.

1. One pass gives each document the set of filters it fails, as a bit mask. The copy filter needs the whole table:
   rows are counted by (text digest, part, mask, labels) with their smallest id, so copies meet only as counts.
2. What is left is a count per (part, mask), at most ``2 ** filters`` rows a part. All later work is on these.
3. A state of the lattice is the set of filters already applied, an edge applies one more. A document lives in a
   state if it fails none of the state's filters; an edge removes the living documents that fail its filter.
4. Forward counts say how many orders reach a state, backward counts how many ways lead from it to the full set.
   Their product is the number of orders that use an edge, hence its weight in the filter's Shapley sum. The steps of
   each order are read from the same edges.

Defined cases: a null text is empty (no words; two empty texts are identical); a null part is the empty string; a null
doc_id has no label and is neither smaller nor larger than another id, so such rows never fail the copy filter and
make no other row fail it; of rows with equal id and text none is the copy of the other; a document labelled
on several rows has a label if one of them gives it; an empty table gives no rows. Texts are compared by SHA-256.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascope.llm import text as X

SPACES = r"[\x20\x09-\x0D]+"


def conditions() -> dict[str, Column]:
    """Failure of each row filter, on the columns ``text``, ``n_words`` and ``n_distinct``."""
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def forward_backward(size: int) -> tuple[list[int], list[int]]:
    """Orders that reach each state from the empty set, and ways from each state to the full set."""
    states = range(1 << size)
    forward, backward = [0] * len(states), [0] * len(states)
    forward[0] = backward[-1] = 1
    for s in states:
        for f in range(size):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(states):
        for f in range(size):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return forward, backward


def failing(docs: DataFrame, rules: dict[str, Column], part: str = "lang") -> DataFrame:
    """doc_id, part, digest and mask (bit k: fails rule k) of every row; texts stay where they are read."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.select("doc_id", "part", "text", F.size("words").alias("n_words"),
                       F.size(F.array_distinct("words")).alias("n_distinct"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame, copies: int) -> DataFrame:
    """part, mask, n, good and toxic: documents by the filters they fail, bit ``copies`` being that of the copy filter."""
    marks = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")))
    of = ["digest", "part", "mask", "good", "toxic"]
    known = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        "doc_id", "digest", "part", "mask", F.coalesce("q", F.lit(0)).alias("good"), F.coalesce("t", F.lit(0)).alias("toxic"))
    by_id = known.groupBy("doc_id", *of).agg(F.count(F.lit(1)).alias("n"))
    texts = by_id.groupBy(*of).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    here = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    split = F.array(F.struct(F.col("mask").alias("m"), here.alias("c")),
                    F.struct((F.col("mask") + (1 << copies)).alias("m"), (F.col("n") - here).alias("c")))
    return (texts.select("part", "good", "toxic", F.explode(split).alias("x")).groupBy("part", F.col("x.m").alias("mask"))
            .agg(F.sum("x.c").alias("n"), F.sum(F.col("x.c") * F.col("good")).alias("good"),
                 F.sum(F.col("x.c") * F.col("toxic")).alias("toxic")))


def edge_sums(counts: DataFrame, size: int) -> DataFrame:
    """part, state, filter (its number), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    forward, backward = forward_backward(size)
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << size) for f in range(size) if not s >> f & 1]
    fan = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight"))
                    for s, f, w in edges])
    rows = counts.select("part", "mask", "n", "good", "toxic", F.explode(fan).alias("e")).select(
        "part", "mask", "n", "good", "toxic", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, alive = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("state")) == 0

    def total(c: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(c)).otherwise(0))

    out = rows.groupBy("part", "state", "filter", "weight").agg(
        total("n", alive & ~fails).alias("kept"), total("n", alive & fails).alias("removed"),
        total("n", fails & ~alive).alias("redundant"), total("n", F.col("mask") == bit).alias("unique_fails"),
        total("good", alive & fails).alias("good_lost"), total("toxic", alive & fails).alias("toxic_lost"))
    of_filter = Window.partitionBy("part", "filter")
    return out.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(of_filter)).drop("weight")


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, Column] | None = None, copies: str = "E",
          part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step. ``rules`` are named row filters (by default those of
    ``conditions``); the filter ``copies`` joins them. The orders are all permutations, so use few filters."""
    rules = conditions() if rules is None else rules
    names = [*rules, copies]
    counts = X.written(mask_counts(failing(docs, rules, part), labels, len(rules)), "masks")
    steps = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(names[k] for k in order), step, state, f))
            state |= 1 << f
    steps = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int"))
    return edge_sums(counts, len(names)).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
