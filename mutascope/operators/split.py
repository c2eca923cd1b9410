"""Target-stratified train/validation/test split and its summaries.

Strata are the quartiles of the target (linear-interpolated edges; a value
equal to an edge goes to the upper stratum). Inside a stratum rows are put in
a seeded pseudo-random order -- md5 of (seed, key), key as tie-break -- and
the first ``floor(n * train)`` go to train, the next ``floor(n * val)`` to
validation, the rest to test. The order is a pure function of (seed, key):
any partitioning, retry or re-run gives the same split.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutascope.operators.ordinal import exact_quantiles

SPLITS = ("train", "val", "test")
CELLS = 1024  # parts of a hash range that are counted at once; a part of at most as many rows is read


def quartile_edges(df: DataFrame, target: str) -> list[float]:
    q = exact_quantiles(df, target, (0.25, 0.5, 0.75), method="linear")
    return [q[0.25], q[0.5], q[0.75]]


def stratum_expr(target: str, edges: Sequence[float]) -> F.Column:
    v = F.col(target)
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(v < F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return out


def shuffle_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _order_cuts(rows: DataFrame, wanted: dict[int, list[int]], sizes: dict[int, int]) -> dict[tuple[int, int], tuple]:
    """(hash, key) of the row at each wanted 1-based place of each stratum's order; ``rows``: stratum, _shuffle, _key.

    The hash is evenly spread, so a place lies in a known narrow range of it. Passes count the rows in ``CELLS`` parts of
    the ranges and go on with the part that holds the place, until it has few rows; only those are read.
    """
    share = F.conv(F.substring("_shuffle", 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = rows.withColumn("_share", share)
    span = {}
    for s, places in wanted.items():
        for r in places:
            f, n = r / sizes[s], sizes[s]
            half = 6 * (f * (1 - f) / n) ** 0.5 + 6 / n
            span[s, r] = (max(f - half, 0.0), min(f + half, 1.0))
    done, few = {}, {}
    while span:
        asked = sorted(span)
        cell = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col("stratum") == s, F.least(F.greatest(
            F.floor((F.col("_share") - lo) * (CELLS / (hi - lo))), F.lit(-1)), F.lit(CELLS)).cast("int")).alias("c"))
            for i, (s, _) in enumerate(asked) for lo, hi in [span[asked[i]]]])
        counts = (rows.select(F.explode(cell).alias("x")).where("x.c is not null").groupBy("x.i", "x.c")
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        for i, (s, r) in enumerate(asked):
            before, (lo, hi) = 0, span.pop((s, r))
            for c, n in sorted((x.c, x.n) for x in counts if x.i == i):
                if before < r <= before + n:
                    edge = [lo + (hi - lo) * k / CELLS for k in (c, c + 1)]
                    if c < 0:
                        span[s, r] = (0.0, lo)
                    elif c == CELLS:
                        span[s, r] = (hi, 1.0 + 2.0 ** -52)
                    elif n > CELLS and edge[0] < edge[1]:
                        span[s, r] = tuple(edge)
                    else:
                        few[s, r] = (c, lo, hi, r - before)
                    break
                before += n
    if few:
        hit = F.lit(False)
        for (s, _), (c, lo, hi, _) in few.items():
            hit = hit | ((F.col("stratum") == s) & (F.floor((F.col("_share") - lo) * (CELLS / (hi - lo))) == c))
        held = sorted((x["stratum"], x["_share"], x["_shuffle"], x["_key"]) for x in rows.where(hit).select("stratum", "_share", "_shuffle", "_key").collect())
        for (s, r), (c, lo, hi, k) in few.items():
            own = [x for x in held if x[0] == s and int(math.floor((x[1] - lo) * (CELLS / (hi - lo)))) == c]
            done[s, r] = own[k - 1][2:]
    return done


def stratified_split(df: DataFrame, target: str, key: str,
                     fractions: tuple[float, float] = (0.8, 0.1), seed: int = 42,
                     edges: Sequence[float] | None = None) -> DataFrame:
    """Add ``stratum`` (0-3) and ``split`` (train/val/test) columns.

    The last train and validation row of each stratum's order are selected by narrow passes over target and key;
    the rows themselves are compared with them where they are, without an exchange. ``key`` is unique.
    """
    edges = list(edges) if edges is not None else quartile_edges(df, target)
    staged = df.withColumn("stratum", stratum_expr(target, edges)).withColumn("_shuffle", shuffle_key(key, seed))
    narrow = staged.select("stratum", "_shuffle", F.col(key).alias("_key"))
    sizes = {r["stratum"]: r["n"] for r in narrow.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    train_f, val_f = fractions
    ends = {s: (math.floor(n * train_f), math.floor(n * train_f) + math.floor(n * val_f)) for s, n in sizes.items()}
    cuts = _order_cuts(narrow, {s: sorted({r for r in e if 0 < r < sizes[s]}) for s, e in ends.items()}, sizes)

    def upto(k: int) -> F.Column:
        """Whether the row stands among the first ``ends[stratum][k]`` of its stratum."""
        out = F.lit(False)
        for s, e in ends.items():
            if e[k] >= sizes[s]:
                here = F.lit(True)
            elif e[k] <= 0:
                here = F.lit(False)
            else:
                digest, last = cuts[s, e[k]]
                here = (F.col("_shuffle") < digest) | ((F.col("_shuffle") == digest) & (F.col(key) <= F.lit(last)))
            out = F.when(F.col("stratum") == s, here).otherwise(out)
        return out

    split = F.when(upto(0), F.lit("train")).when(upto(1), F.lit("val")).otherwise(F.lit("test"))
    return staged.withColumn("split", split).drop("_shuffle")


def split_summary(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Rows, % of total, target mean and sample std per split, plus a total row.

    ``rollup`` gives the per-split rows and the grand total in one aggregation;
    the percentage divides by the total row of that (4-row) result.
    """
    g = df.rollup(split_col).agg(
        F.grouping(split_col).alias("_g"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"))
    grand = F.max(F.when(F.col("_g") == 1, F.col("rows"))).over(Window.partitionBy(F.lit(0)))
    return g.select(
        F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(split_col)).alias(split_col),
        "rows", (F.col("rows") * F.lit(100.0) / grand).alias("pct"), "mean", "std")


def split_by_source(df: DataFrame, levels: Sequence[str], split_col: str = "split",
                    source_col: str = "source") -> DataFrame:
    """Count per split x source level, absent combinations as 0."""
    return (df.groupBy(split_col).pivot(source_col, list(levels))
              .agg(F.count(F.lit(1))).na.fill(0, subset=list(levels)))


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One Parquet folder per split (``split=train`` ...), snappy."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(split_col).parquet(path)
