"""Table preparation: non-strict casts, null filters, keep-first dedup, schema
conformance, union, and the descriptive summaries printed after loading."""

from __future__ import annotations

import logging
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def safe_cast(df: DataFrame, cols: Iterable[str], to: str = "double") -> DataFrame:
    """Cast string columns to ``to`` without failing: unparseable text -> NULL.

    Only columns read as strings are touched (numeric columns stay as they are).
    Plain ``cast`` raises under ANSI mode; ``try_cast`` does not.
    """
    types = dict(df.dtypes)
    for c in cols:
        if c in types and types[c] == "string":
            df = df.withColumn(c, F.col(c).try_cast(to))
    return df


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every column in ``cols`` is not NULL."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df if cond is None else df.where(cond)


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (an explicit input-order column).

    ``min_by`` over a struct aggregates partially on the map side, so a key
    holding a third of all rows sends one candidate per task to the shuffle.
    ``order`` must make the pick unique (append a row id if needed).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def with_source(df: DataFrame, label: str, col: str = "source") -> DataFrame:
    return df.withColumn(col, F.lit(label))


def conform_schema(df: DataFrame, schema: T.StructType | Sequence[tuple[str, str]]) -> DataFrame:
    """Fixed columns in fixed order: missing ones added as typed NULLs, extras dropped."""
    fields = ([(f.name, f.dataType.simpleString()) for f in schema.fields]
              if isinstance(schema, T.StructType) else list(schema))
    present = set(df.columns)
    missing = [n for n, _ in fields if n not in present]
    if missing:
        log.warning("columns not found, will be null: %s", missing)
    return df.select(*[(F.col(n).cast(t) if n in present else F.lit(None).cast(t)).alias(n)
                       for n, t in fields])


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Vertical concatenation by column name (schemas must agree)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def conform(df: DataFrame, schema, source: str, key: str, order: Sequence[str],
            numeric_text_cols: Sequence[str] = (), required: Sequence[str] = (),
            seq_col: str | None = None, length_col: str = "seq_length") -> DataFrame:
    """Per-file preparation: safe casts, required non-nulls, keep-first by key,
    source label, character length, fixed schema."""
    out = safe_cast(df, numeric_text_cols)
    out = drop_missing(out, required)
    out = keep_first(out, key, order)
    out = with_source(out, source)
    if seq_col:
        out = out.withColumn(length_col, F.length(seq_col))
    return conform_schema(out, schema)


# ---------------------------------------------------------------------------
# Summaries
# ---------------------------------------------------------------------------

def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: NULL count and percent of rows, columns with NULLs only.

    One aggregation pass (``count_if`` per column), then an unpivot of the
    single result row.
    """
    aggs = [F.count(F.lit(1)).alias("_total")] + [
        F.count_if(F.col(c).isNull()).alias(f"_n_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stacked = one.select("_total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("n_null"))
        for i, c in enumerate(cols)])).alias("_s"))
    return (stacked.select(F.col("_s.column").alias("column"), F.col("_s.n_null").alias("n_null"),
                           (F.col("_s.n_null") * F.lit(100.0) / F.col("_total")).alias("pct_null"))
            .where(F.col("n_null") > 0))


def describe_numeric(df: DataFrame, col: str, quantile: str = "nearest",
                     qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, mean, sample std, population std, min, quantiles, max of non-NULL values.

    Quantiles are exact order statistics from a selection in a few narrow passes,
    the first of which gives the moments too.
    """
    from mutascope.operators.ordinal import exact_quantiles

    v = F.col(col).cast("double")
    names = ["n", "mean", "std", "std_pop", "min", "max"]
    got = exact_quantiles(df.select(v.alias("v")), "v", qs, method=quantile, more=[
        F.count("v"), F.avg("v"), F.stddev_samp("v"), F.stddev_pop("v"), F.min("v"), F.max("v")])
    row = dict(zip(names, (got[i] for i in range(len(names)))))
    ps = [f"p{int(round(q * 100))}" for q in qs]
    schema = ", ".join(["n long", *[f"{c} double" for c in ("mean", "std", "std_pop", "min", *ps, "max")]])
    return df.sparkSession.createDataFrame([(row["n"], row["mean"], row["std"], row["std_pop"], row["min"], *[got[q] for q in qs], row["max"])], schema)


def length_summary(df: DataFrame, length_col: str) -> DataFrame:
    """min, max, mean and (interpolated) median of a length column, from two passes over it."""
    from mutascope.operators.ordinal import exact_quantiles

    got = exact_quantiles(df, length_col, (0.5,), more=[F.min(length_col), F.max(length_col), F.avg(length_col)])
    kind = df.schema[length_col].dataType.simpleString()
    median = None if got[0.5] is None else float(got[0.5])
    return df.sparkSession.createDataFrame([(got[0], got[1], got[2], median)], f"min {kind}, max {kind}, mean double, median double")


def round_cols(df: DataFrame, cols: Sequence[str], scale: int) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.bround(F.col(c), scale))
    return df


__all__ = ["safe_cast", "drop_missing", "keep_first", "with_source", "conform_schema",
           "union_sources", "conform", "count_by", "null_report", "describe_numeric",
           "length_summary", "round_cols"]
