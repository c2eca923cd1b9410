"""Regression evaluation: metrics overall and by slice, histograms, density grids.

All metrics come from one-pass aggregates (partial on the map side). Spearman's
rho needs ranks: average ranks of y and of p are computed per group within
ordered buckets (no single-task global window, no join of rows), then correlated.
Undefined correlations (a constant side) are NULL rather than an ANSI error.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascope.operators.ordinal import cut_points, rank_offsets, with_average_rank
from mutascope.session import materialize

METRIC_COLS = ["R2", "RMSE", "MAE", "Pearson_r", "Spearman_rho"]
LENGTH_EDGES = [0, 100, 300, 500, 1000]
LENGTH_LABELS = ["0-100", "100-300", "300-500", "500-1000", "1000+"]


def _guarded_corr(a: str, b: str) -> F.Column:
    """Pearson correlation, NULL when either side is constant.

    Written as covariance over the product of deviations: the built-in
    ``corr`` raises DIVIDE_BY_ZERO under ANSI even when guarded. Constant means
    min = max: a deviation merged from several tasks need not be exactly zero.
    """
    return F.when(_varies(a) & _varies(b), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def _varies(c: str) -> F.Column:
    return F.min(c) < F.max(c)


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (),
                       spearman: bool = True, round_to: int | None = None) -> DataFrame:
    """n, R2, RMSE, MAE, Pearson r, Spearman rho per group (NULL y/p rows ignored).

    R2 follows the usual convention for a constant target: 1 for a perfect
    fit, else 0.
    """
    by = list(by)
    base = df.select(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")) \
             .where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    if spearman:
        # The rows are read several times (cut points, two tables of bucket offsets, the
        # ranks): cut them once so an expensive upstream (model scoring, joins) runs once.
        base = materialize(base)
        _, cuts = cut_points(base, ["_y", "_p"])
        offsets = {value: rank_offsets(base, value, by, cuts[value]) for value in ("_y", "_p")}
        for value, name in (("_y", "_ry"), ("_p", "_rp")):
            base = with_average_rank(base, offsets[value], value, by, name, cuts[value])
    err = F.col("_p") - F.col("_y")
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(err * err).alias("_ss_res"),
            (F.var_pop("_y") * F.count(F.lit(1))).alias("_ss_tot"),
            _varies("_y").alias("_varies"),
            F.sqrt(F.avg(err * err)).alias("RMSE"),
            F.avg(F.abs(err)).alias("MAE"),
            _guarded_corr("_y", "_p").alias("Pearson_r")]
    if spearman:
        aggs.append(_guarded_corr("_ry", "_rp").alias("Spearman_rho"))
    else:
        aggs.append(F.lit(None).cast("double").alias("Spearman_rho"))
    g = base.groupBy(*by).agg(*aggs) if by else base.agg(*aggs)
    r2 = F.when(F.col("_varies"), F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot")) \
          .when(F.col("_ss_res") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    out = g.select(*by, "n", r2.alias("R2"), "RMSE", "MAE", "Pearson_r", "Spearman_rho")
    if round_to is not None:
        for c in METRIC_COLS:
            out = out.withColumn(c, F.bround(c, round_to))
    return out


def bucket_expr(col: str, edges: Sequence[float] = LENGTH_EDGES,
                labels: Sequence[str] = LENGTH_LABELS) -> F.Column:
    """Right-open buckets [e0,e1) ... [ek, inf); values below e0 get NULL."""
    v = F.col(col)
    out = F.lit(None).cast("string")
    for i in reversed(range(len(edges))):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        cond = (v >= edges[i]) & (v < hi) if hi is not None else (v >= edges[i])
        out = F.when(cond, F.lit(labels[i])).otherwise(out)
    return out


def metrics_by_bucket(df: DataFrame, y: str, p: str, col: str,
                      edges: Sequence[float] = LENGTH_EDGES,
                      labels: Sequence[str] = LENGTH_LABELS, min_n: int = 10,
                      round_to: int | None = None) -> DataFrame:
    """Metrics per length bucket; buckets with fewer than ``min_n`` rows dropped."""
    b = df.withColumn("bucket", bucket_expr(col, edges, labels)).where(F.col("bucket").isNotNull())
    return regression_metrics(b, y, p, ["bucket"], round_to=round_to).where(F.col("n") >= min_n)


def _range(df: DataFrame, col: str) -> tuple[float, float]:
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def error_histogram(df: DataFrame, y: str, p: str, bins: int = 120) -> DataFrame:
    """Counts of ``p - y`` in ``bins`` equal bins over its [min, max] (last bin closed).

    Empty bins are omitted. The range is two scalars fetched first.
    """
    e = df.select((F.col(p) - F.col(y)).alias("e")).where(F.col("e").isNotNull())
    lo, hi = _range(e, "e")
    if lo is None:
        return e.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("count")).limit(0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col("e") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)),
                  F.lit(bins - 1)).cast("int")
    return (e.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
             .withColumn("lo_edge", F.lit(lo) + F.col("bin") * F.lit(width))
             .withColumn("hi_edge", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def density_grid(df: DataFrame, x: str, y: str, gridsize: int = 80) -> DataFrame:
    """Square 2-D histogram: ``gridsize`` x ``gridsize`` cells over the data range."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    r = d.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    (x0, x1, y0, y1) = (r[0], r[1], r[2], r[3])
    if x0 is None:
        return d.select(F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(0).cast("long").alias("count")).limit(0)

    def cell(c, lo, hi):
        if hi == lo:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(lo)) * F.lit(float(gridsize)) / F.lit(hi - lo)),
                       F.lit(gridsize - 1)).cast("int")

    return d.groupBy(cell("_x", x0, x1).alias("ix"), cell("_y", y0, y1).alias("iy")) \
            .agg(F.count(F.lit(1)).alias("count"))


def hex_params(x0: float, x1: float, y0: float, y1: float, gridsize: int) -> dict:
    """Hexagonal lattice geometry over the data range (as in common hexbin plots)."""
    def nonsingular(lo, hi):
        if lo == hi:
            return (lo - 0.1 * abs(lo), hi + 0.1 * abs(hi)) if lo != 0 else (-0.1, 0.1)
        return lo, hi
    x0, x1 = nonsingular(x0, x1)
    y0, y1 = nonsingular(y0, y1)
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    px, py = 1e-9 * (x1 - x0), 1e-9 * (y1 - y0)
    x0, x1, y0, y1 = x0 - px, x1 + px, y0 - py, y1 + py
    return {"x0": x0, "y0": y0, "sx": (x1 - x0) / nx, "sy": (y1 - y0) / ny, "nx": nx, "ny": ny}


def density_hex(df: DataFrame, x: str, y: str, gridsize: int = 80) -> DataFrame:
    """Hexagonal binning: nearest centre of two offset rectangular lattices.

    Output: lattice (1 or 2), ix, iy, count; empty cells omitted.
    """
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    r = d.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if r[0] is None:
        return d.select(F.lit(1).alias("lattice"), F.lit(0).alias("ix"), F.lit(0).alias("iy"),
                        F.lit(0).cast("long").alias("count")).limit(0)
    h = hex_params(r[0], r[1], r[2], r[3], gridsize)
    xs = (F.col("_x") - F.lit(h["x0"])) / F.lit(h["sx"])
    ys = (F.col("_y") - F.lit(h["y0"])) / F.lit(h["sy"])
    staged = d.select(xs.alias("xs"), ys.alias("ys"))
    ix1, iy1 = F.bround("xs", 0), F.bround("ys", 0)
    ix2, iy2 = F.floor("xs"), F.floor("ys")
    d1 = (F.col("xs") - ix1) ** 2 + F.lit(3.0) * (F.col("ys") - iy1) ** 2
    d2 = (F.col("xs") - ix2 - 0.5) ** 2 + F.lit(3.0) * (F.col("ys") - iy2 - 0.5) ** 2
    first = d1 < d2
    return (staged.select(
                F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("lattice"),
                F.when(first, ix1).otherwise(ix2).cast("long").alias("ix"),
                F.when(first, iy1).otherwise(iy2).cast("long").alias("iy"))
            .groupBy("lattice", "ix", "iy").agg(F.count(F.lit(1)).alias("count")))


def axis_limits(df: DataFrame, y: str, p: str, margin: float = 0.05) -> DataFrame:
    """Shared axis range of actual and predicted, widened by ``margin``; mean error."""
    g = df.agg(F.least(F.min(y), F.min(p)).alias("vmin"), F.greatest(F.max(y), F.max(p)).alias("vmax"),
               F.avg(F.col(p) - F.col(y)).alias("mean_error"))
    m = (F.col("vmax") - F.col("vmin")) * F.lit(margin)
    return g.select((F.col("vmin") - m).alias("lim_lo"), (F.col("vmax") + m).alias("lim_hi"), "mean_error")


def compare_models(preds: DataFrame, y: str = "y", p: str = "p", model: str = "model",
                   round_to: int | None = None, spearman: bool = True) -> DataFrame:
    """Side-by-side metrics from stacked predictions (id, model, y, p)."""
    return regression_metrics(preds, y, p, [model], spearman=spearman, round_to=round_to)


def upsert_metrics(existing: DataFrame, new: DataFrame, pattern: str, model: str = "model") -> DataFrame:
    """Idempotent refresh: drop rows whose model matches ``pattern``, append ``new``."""
    return existing.where(~F.col(model).rlike(pattern)).unionByName(new)


def best_model(metrics: DataFrame, by: str = "RMSE", order_col: str | None = None,
               model: str = "model") -> DataFrame:
    """The model with the lowest ``by`` (first in ``order_col`` on ties)."""
    key = F.struct(F.col(by), F.col(order_col)) if order_col else F.struct(F.col(by), F.col(model))
    return metrics.agg(F.min_by(model, key).alias(model), F.min(by).alias(by))
