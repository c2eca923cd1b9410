"""Host-level quality rules.

Every document is measured by itself (word, symbol, repeated-line and repeated-window counts).
Rule failures are summed by host (the ``source`` column); each host's failure rate is shrunk
towards the rate of all hosts with a beta prior whose two parameters come from the spread of the
host rates (method of moments). A host whose shrunk rate exceeds ``max_rate`` is poor. The verdict
goes back to the documents: in a poor host every rule is enforced, elsewhere only the base rules
are, so clean documents of a poor host stay.

Defined cases: a null or empty text has no words and fails the word rule; a null source belongs to
no host and is judged by the base rules alone; repeated rows count once each; an empty table gives an
empty result. Lines and word windows are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
HOSTS_BROADCAST = 200_000  # hosts (one short row each) that may be broadcast; more are joined by shuffle


@dataclass(frozen=True)
class Rules:
    """Thresholds. The first two are the base rules, the others apply in poor hosts."""
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10       # symbols per 100 word characters
    max_dup_line_per_100_words: int = 5
    min_word_chars: int = 2            # mean characters of a word
    max_word_chars: int = 15
    max_rate: float = 0.4              # shrunk failure rate above which a host is poor


def _measure(part: pa.RecordBatch) -> list:
    col, n = part.column("text"), part.num_rows
    raw, off = X.buffers(col)
    starts, ends, doc = X.segments(raw, off, X.NOT_SPACE)
    n_words = np.bincount(doc, minlength=n)
    head = (raw & 0xC0) != 0x80  # first bytes of code points
    chars = np.concatenate([[0], np.cumsum(head & X.NOT_SPACE[raw])])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[raw])])

    line_start, line_end, line_doc = X.segments(raw, off, X.NOT_NEWLINE)
    full = chars[line_end] > chars[line_start]  # lines with a word
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    lines = X.keyed(X.fingerprints(raw, line_start, line_end), line_doc)
    _, first = np.unique(lines, return_index=True)
    n_dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)

    grams, at = X.windows(X.fingerprints(raw, starts, ends), doc, 3)
    _, back, count = np.unique(X.keyed(grams, doc[at]), return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    hit = np.zeros(len(doc), bool)
    for k in range(3):
        hit[again + k] = True
    return [n_words, chars[off[1:]] - chars[off[:-1]], symbols[off[1:]] - symbols[off[:-1]], n_dup,
            np.bincount(doc[hit], minlength=n)]


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The five counts of every row (one pass, no shuffle)."""
    return X.map_rows(docs, list(keep), FIELDS, lambda: lambda part: [pa.array(a, pa.int64()) for a in _measure(part)])


def base_failed(r: Rules) -> Column:
    return (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))


def rule_failed(r: Rules) -> Column:
    """Any rule, base rules included."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return (base_failed(r) | (100 * F.col("n_symbols") > r.max_symbol_percent * chars)
            | (100 * F.col("n_dup_lines") > r.max_dup_line_per_100_words * words)
            | (chars < r.min_word_chars * words) | (chars > r.max_word_chars * words))


def host_verdicts(stats: DataFrame, r: Rules = Rules(), host: str = "source") -> DataFrame:
    """(host, n, failed, rate, poor): failure rates by host, shrunk with an empirical beta prior.

    The mean m is that of all documents; the between-host variance v is the spread of the host rates, weighted
    by documents, less what sampling alone would give. The prior's strength is m(1-m)/v - 1; no spread
    means full shrinkage to m. Sums are exact integers.
    """
    hosts = (stats.where(F.col(host).isNotNull()).groupBy(host)
             .agg(F.count(F.lit(1)).alias("n"), F.sum(rule_failed(r).cast("long")).alias("failed")))
    hosts = X.written(hosts, "hosts")
    one = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("k"), F.count(F.lit(1)).alias("h"),
                    F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    m = one.k / one.n if one.h else 0.0
    gap = F.col("failed") / F.col("n") - m
    spread = hosts.agg(F.sum(F.col("n") * gap * gap).alias("s")).first().s
    room = one.n - one.nn / one.n if one.h else 0.0
    var = (spread - (one.h - 1) * m * (1 - m)) / room if room > 0 else 0.0
    strength = max(m * (1 - m) / var - 1, 0.0) if var > 0 else float("inf")
    if strength == float("inf"):
        shrunk = F.lit(float(m))
    else:
        shrunk = (F.col("failed") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("poor", F.col("rate") > r.max_rate)


def judged(stats: DataFrame, hosts: DataFrame, r: Rules = Rules(), host: str = "source") -> DataFrame:
    """``stats`` with ``base_failed``, ``host_poor``, ``kept``; hosts are joined back to their documents."""
    poor = X.small(hosts.where("poor").select(F.col(host).alias("_host")), HOSTS_BROADCAST)
    out = stats.join(poor, stats[host] == poor["_host"], "left")
    bad = F.col("_host").isNotNull()
    return (out.withColumn("base_failed", base_failed(r)).withColumn("host_poor", bad)
            .withColumn("kept", ~F.col("base_failed") & ~(bad & rule_failed(r))).drop("_host"))


def quality(docs: DataFrame, r: Rules = Rules()) -> DataFrame:
    """Counts and verdict of every document."""
    stats = X.written(measures(docs, ("doc_id", "source")), "quality")
    return judged(stats, host_verdicts(stats, r), r)


def keep_good(docs: DataFrame, r: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are measured twice: once for the host rates, once beside the rows that are kept, so the
    texts themselves are neither shuffled nor stored.
    """
    hosts = host_verdicts(X.written(measures(docs, ("source",)), "quality"), r)
    rows, back = X.hidden(docs, "text", "source")
    return judged(measures(rows, tuple(rows.columns)), hosts, r).where("kept").select(*back)
