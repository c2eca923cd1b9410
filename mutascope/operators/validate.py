"""Row-level quality checks: sequence validation, request checks, position specs.

The request handlers of a web service reject the first bad item; at table scale
each row instead gets an ``error`` column (NULL = valid) so callers can split
good and bad rows in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascope.functions import messages as MSG
from mutascope.functions.residues import (
    LONG_SEQUENCE, MAX_RESIDUES, NON_STANDARD_PATTERN, non_standard_residues, strip_upper,
)


def sequence_error(seq, max_len: int = MAX_RESIDUES):
    """Error text for a cleaned sequence (checks in order: empty, length, alphabet)."""
    n = F.length(seq)
    return (F.when(n == 0, F.lit(MSG.EMPTY))
            .when(n > max_len, F.concat(n.cast("string"), F.lit(MSG.LONG.format(max_len))))
            .when(seq.rlike(NON_STANDARD_PATTERN), F.concat(
                F.lit(MSG.LETTERS),
                F.array_join(non_standard_residues(seq), ", "))))


def validate_sequences(df: DataFrame, seq_col: str, max_len: int = MAX_RESIDUES,
                       long_threshold: int = LONG_SEQUENCE) -> DataFrame:
    """Add ``sequence`` (stripped, upper-cased), ``length``, ``error``, ``is_long``."""
    out = df.withColumn("sequence", strip_upper(seq_col))
    seq = F.col("sequence")
    return (out.withColumn("length", F.length(seq))
               .withColumn("error", sequence_error(seq, max_len))
               .withColumn("is_long", F.col("length") > long_threshold))


def overlength(df: DataFrame, seq_col: str, policy: str = "truncate",
               max_len: int = MAX_RESIDUES) -> DataFrame:
    """Apply one over-length policy: ``skip`` (drop), ``truncate`` or ``reject`` (error)."""
    n = F.length(seq_col)
    if policy == "skip":
        return df.where(n <= max_len)
    if policy == "truncate":
        return df.withColumn(seq_col, F.substring(seq_col, 1, max_len))
    if policy == "reject":
        return df.withColumn("error", F.when(n > max_len, F.concat(n.cast("string"), F.lit(MSG.LONG.format(max_len)))))
    raise ValueError(f"unknown over-length policy: {policy}")


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_positions(df: DataFrame, spec_col: str, len_col: str,
                    out_col: str = "positions") -> DataFrame:
    """Parse ``"10,15,20-30"`` specs into sorted distinct 1-based positions.

    Blank tokens are skipped, out-of-range positions dropped, a reversed range
    is empty; a token that is not an integer (or integer range) sets ``error``
    and leaves the position list empty.
    """
    toks = F.filter(F.transform(F.split(F.col(spec_col), ","), _strip), lambda t: t != "")

    def parse(t):
        has_dash = F.instr(t, "-") > 0
        first = F.substring_index(t, "-", 1)
        rest = F.regexp_replace(t, "^[^-]*-", "")
        a = F.when(has_dash, _strip(first).try_cast("int")).otherwise(t.try_cast("int"))
        b = F.when(has_dash, _strip(rest).try_cast("int")).otherwise(t.try_cast("int"))
        return F.struct(t.alias("t"), a.alias("a"), b.alias("b"))

    parsed = F.transform(toks, parse)
    n = F.col(len_col)
    bad = F.try_element_at(F.filter(parsed, lambda x: x["a"].isNull() | x["b"].isNull()), F.lit(1))
    ranges = F.transform(parsed, lambda x: F.when(
        F.greatest(x["a"], F.lit(1)) <= F.least(x["b"], n),
        F.sequence(F.greatest(x["a"], F.lit(1)), F.least(x["b"], n))
    ).otherwise(F.array().cast("array<int>")))
    positions = F.array_sort(F.array_distinct(F.flatten(ranges)))
    return (df.withColumn("_bad", bad)
              .withColumn(out_col, F.when(F.col("_bad").isNull(), positions)
                          .otherwise(F.array().cast("array<int>")))
              .withColumn("error", F.when(F.col("_bad").isNotNull(), F.concat(
                  F.when(F.instr(F.col("_bad.t"), "-") > 0, F.lit(MSG.BAD_RANGE))
                   .otherwise(F.lit(MSG.BAD_POSITION)),
                  F.col("_bad.t"))))
              .drop("_bad"))


def validate_scan_requests(df: DataFrame, seq_col: str = "sequence", top_n_col: str = "top_n",
                           positions_col: str = "positions", max_len: int = MAX_RESIDUES,
                           default_top_n: int = 20, max_top_n: int = 500,
                           show_below: int = 5, show_above: int = 10) -> DataFrame:
    """Scan-request checks V1-V4, V6-V8: sequence, top_n range, positions.

    An error text names the first ``show_below`` / ``show_above`` offending positions.

    Adds ``sequence``, ``length``, ``top_n`` (defaulted), ``positions`` (sorted
    distinct, or NULL = every position) and ``error``.
    """
    v = validate_sequences(df, seq_col, max_len)
    top = F.coalesce(F.col(top_n_col), F.lit(default_top_n))
    pos = F.col(positions_col)
    below = F.filter(pos, lambda p: p < 1)
    above = F.filter(pos, lambda p: p > F.col("length"))
    err = (F.coalesce(F.col("error"),
                      F.when(~top.between(1, max_top_n), F.concat(
                          F.lit(MSG.TOP_N[0]), top.cast("string"), F.lit(MSG.TOP_N[1].format(max_top_n)))),
                      F.when(F.size(below) > 0, F.concat(
                          F.lit(MSG.BELOW),
                          F.array_join(F.slice(below, 1, show_below), ", "))),
                      F.when(F.size(above) > 0, F.concat(
                          F.lit(MSG.ABOVE[0]), F.col("length").cast("string"), F.lit(MSG.ABOVE[1]),
                          F.array_join(F.slice(F.array_sort(F.array_distinct(above)), 1, show_above), ", ")))))
    # the error is computed on the positions as requested (order kept in the
    # message), then the list is replaced by its sorted distinct form
    return (v.withColumn("error", err)
             .withColumn(top_n_col, top)
             .withColumn(positions_col, F.when(pos.isNotNull(), F.array_sort(F.array_distinct(pos)))))
