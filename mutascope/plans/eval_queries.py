"""Registered evaluation queries on ``lineitem``.

Actual value y = extended price / 1e5; predictions are fixed linear functions
of other columns (no trained model is involved), so every metric has an exact
SQL twin. Metric values are rounded half-even to 9 dp in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mutascope.operators import metrics as M
from mutascope.operators import split as SP
from mutascope.plans.views import table

R = 9
MODELS = [("linear_q", "l_quantity * 0.02"),
          ("linear_qd", "l_quantity * 0.02 * (1 - l_discount)"),
          ("constant", "0.25")]


def _preds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("y"),
        (F.col("l_quantity") * F.lit(0.02)).alias("p"),
        F.floor(F.col("l_extendedprice") / F.lit(100.0)).cast("long").alias("seq_length"))


PREDS_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag,
  l_extendedprice / CAST(100000.0 AS DOUBLE) AS y,
  l_quantity * CAST(0.02 AS DOUBLE) AS p,
  CAST(floor(l_extendedprice / CAST(100.0 AS DOUBLE)) AS BIGINT) AS seq_length
FROM lineitem"""


def metrics_sql(src: str, by: list[str], y: str = "y", p: str = "p", where: str = "") -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    part_y = f"PARTITION BY {', '.join(by + [y])}"
    part_p = f"PARTITION BY {', '.join(by + [p])}"
    sel = ", ".join(by) + ", " if by else ""
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    e = f"({p} - {y})"
    return f"""SELECT * FROM (
SELECT {sel}count(*) AS n,
  round_even(CASE WHEN var_pop({y}) * count(*) > 0 THEN 1 - sum({e} * {e}) / (var_pop({y}) * count(*))
                  WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END, {R}) AS R2,
  round_even(sqrt(avg({e} * {e})), {R}) AS RMSE,
  round_even(avg(abs({e})), {R}) AS MAE,
  round_even(CASE WHEN stddev_pop({y}) > 0 AND stddev_pop({p}) > 0 THEN corr({y}, {p}) END, {R}) AS Pearson_r,
  round_even(CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rp) > 0 THEN corr(ry, rp) END, {R}) AS Spearman_rho
FROM (SELECT *,
        rank() OVER ({part} ORDER BY {y}) + (count(*) OVER ({part_y}) - 1) / 2.0 AS ry,
        rank() OVER ({part} ORDER BY {p}) + (count(*) OVER ({part_p}) - 1) / 2.0 AS rp
      FROM ({src}) s0 WHERE {y} IS NOT NULL AND {p} IS NOT NULL) s1
{grp}) s2 {where}"""


def q_metrics_overall(spark, sf):
    return M.regression_metrics(_preds(spark, sf), "y", "p", round_to=R)


def q_metrics_by_length(spark, sf):
    return M.metrics_by_bucket(_preds(spark, sf), "y", "p", "seq_length", round_to=R)


def q_metrics_by_source(spark, sf):
    return M.regression_metrics(_preds(spark, sf), "y", "p", ["l_returnflag"], round_to=R)


_BUCKET_SQL = """CASE WHEN seq_length >= 1000 THEN '1000+' WHEN seq_length >= 500 THEN '500-1000'
  WHEN seq_length >= 300 THEN '300-500' WHEN seq_length >= 100 THEN '100-300'
  WHEN seq_length >= 0 THEN '0-100' END"""

SQL_METRICS_OVERALL = metrics_sql(PREDS_SQL, [])
SQL_METRICS_BY_LENGTH = metrics_sql(
    f"SELECT *, {_BUCKET_SQL} AS bucket FROM ({PREDS_SQL}) b WHERE {_BUCKET_SQL} IS NOT NULL",
    ["bucket"], where="WHERE n >= 10")
SQL_METRICS_BY_SOURCE = metrics_sql(PREDS_SQL, ["l_returnflag"])


def q_error_hist(spark, sf):
    return M.error_histogram(_preds(spark, sf), "y", "p", bins=120)


SQL_ERROR_HIST = f"""
WITH e AS (SELECT p - y AS e FROM ({PREDS_SQL}) t WHERE p - y IS NOT NULL),
r AS (SELECT min(e) AS lo, max(e) AS hi FROM e)
SELECT CAST(least(floor((e - lo) * CAST(120.0 AS DOUBLE) / (hi - lo)), 119) AS INTEGER) AS bin,
       count(*) AS count,
       any_value(lo) + CAST(least(floor((e - lo) * CAST(120.0 AS DOUBLE) / (hi - lo)), 119) AS INTEGER)
         * any_value((hi - lo) / 120) AS lo_edge,
       any_value(lo) + (CAST(least(floor((e - lo) * CAST(120.0 AS DOUBLE) / (hi - lo)), 119) AS INTEGER) + 1)
         * any_value((hi - lo) / 120) AS hi_edge
FROM e, r GROUP BY 1"""


def q_density_grid(spark, sf):
    g = M.density_grid(_preds(spark, sf), "y", "p", gridsize=80)
    return g.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "count")


SQL_DENSITY_GRID = f"""
WITH d AS (SELECT y AS x_, p AS y_ FROM ({PREDS_SQL}) t WHERE y IS NOT NULL AND p IS NOT NULL),
r AS (SELECT min(x_) AS x0, max(x_) AS x1, min(y_) AS y0, max(y_) AS y1 FROM d)
SELECT CAST(least(floor((x_ - x0) * CAST(80.0 AS DOUBLE) / (x1 - x0)), 79) AS BIGINT) AS ix,
       CAST(least(floor((y_ - y0) * CAST(80.0 AS DOUBLE) / (y1 - y0)), 79) AS BIGINT) AS iy,
       count(*) AS count
FROM d, r GROUP BY 1, 2"""


def q_density_hex(spark, sf):
    d = _preds(spark, sf).withColumn("residual", F.col("p") - F.col("y"))
    return M.density_hex(d, "p", "residual", gridsize=80)


SQL_DENSITY_HEX = f"""
WITH d AS (SELECT p AS x_, p - y AS y_ FROM ({PREDS_SQL}) t WHERE p IS NOT NULL AND p - y IS NOT NULL),
r0 AS (SELECT min(x_) AS a0, max(x_) AS a1, min(y_) AS b0, max(y_) AS b1 FROM d),
r AS (SELECT a0 - 1e-9 * (a1 - a0) AS x0, a1 + 1e-9 * (a1 - a0) AS x1,
             b0 - 1e-9 * (b1 - b0) AS y0, b1 + 1e-9 * (b1 - b0) AS y1 FROM r0),
g AS (SELECT x0, y0, (x1 - x0) / 80 AS sx, (y1 - y0) / 46 AS sy FROM r),
s AS (SELECT (x_ - x0) / sx AS xs, (y_ - y0) / sy AS ys FROM d, g),
c AS (SELECT xs, ys,
        (xs - round_even(xs, 0)) * (xs - round_even(xs, 0)) + 3.0 * (ys - round_even(ys, 0)) * (ys - round_even(ys, 0)) AS d1,
        (xs - floor(xs) - 0.5) * (xs - floor(xs) - 0.5) + 3.0 * (ys - floor(ys) - 0.5) * (ys - floor(ys) - 0.5) AS d2
      FROM s)
SELECT CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice,
       CAST(CASE WHEN d1 < d2 THEN round_even(xs, 0) ELSE floor(xs) END AS BIGINT) AS ix,
       CAST(CASE WHEN d1 < d2 THEN round_even(ys, 0) ELSE floor(ys) END AS BIGINT) AS iy,
       count(*) AS count
FROM c GROUP BY 1, 2, 3"""


def q_axis_limits(spark, sf):
    a = M.axis_limits(_preds(spark, sf), "y", "p")
    return a.select(*[F.bround(c, R).alias(c) for c in a.columns])


SQL_AXIS_LIMITS = f"""
SELECT round_even(vmin - (vmax - vmin) * CAST(0.05 AS DOUBLE), {R}) AS lim_lo,
       round_even(vmax + (vmax - vmin) * CAST(0.05 AS DOUBLE), {R}) AS lim_hi,
       round_even(mean_error, {R}) AS mean_error
FROM (SELECT least(min(y), min(p)) AS vmin, greatest(max(y), max(p)) AS vmax, avg(p - y) AS mean_error
      FROM ({PREDS_SQL}) t) s"""


# ---------------------------------------------------------------------------
# Model comparison (M9), upsert (U3), best model (T8), validation/test tables (U4)
# ---------------------------------------------------------------------------

def _stacked(spark, sf, li=None, carry=()):
    """Predictions of all models from one scan: one array of (model, p) per row."""
    li = li if li is not None else table(spark, sf, "lineitem")
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.expr(expr).cast("double").alias("p")) for name, expr in MODELS])
    return (li.select("l_orderkey", "l_linenumber", *carry, (F.col("l_extendedprice") / F.lit(100000.0)).alias("y"),
                      F.explode(each).alias("m"))
            .select("l_orderkey", "l_linenumber", *carry, "m.model", "y", "m.p"))


def _stacked_sql(src: str = "lineitem") -> str:
    parts = [f"SELECT l_orderkey, l_linenumber, '{name}' AS model, "
             f"l_extendedprice / CAST(100000.0 AS DOUBLE) AS y, "
             f"CAST({expr.replace('0.02', 'CAST(0.02 AS DOUBLE)').replace('0.25', 'CAST(0.25 AS DOUBLE)')} AS DOUBLE) AS p "
             f"FROM {src}" for name, expr in MODELS]
    return " UNION ALL ".join(parts)


def q_model_compare(spark, sf):
    return M.compare_models(_stacked(spark, sf), round_to=R)


SQL_MODEL_COMPARE = metrics_sql(_stacked_sql(), ["model"])


def q_metric_upsert(spark, sf):
    """Metric CSV written (W7), read back (S8), refreshed idempotently."""
    from mutascope.session import scratch_path
    from mutascope.sources.sinks import write_metrics_csv
    from mutascope.sources.tables import read_metrics_csv
    path = scratch_path(spark, "metrics")
    write_metrics_csv(M.compare_models(_stacked(spark, sf), round_to=R).drop("n"), path)
    existing = read_metrics_csv(spark, path)
    li = table(spark, sf, "lineitem")
    refit = li.select(F.lit("linear_q_refit").alias("model"),
                      (F.col("l_extendedprice") / F.lit(100000.0)).alias("y"),
                      (F.col("l_quantity") * F.lit(0.021)).alias("p"))
    new = M.compare_models(refit, round_to=R).drop("n")
    return M.upsert_metrics(existing, new, "^linear_q")


SQL_METRIC_UPSERT = f"""
SELECT * EXCLUDE (n) FROM ({metrics_sql(_stacked_sql(), ['model'])}) e WHERE NOT regexp_matches(model, '^linear_q')
UNION ALL
SELECT * EXCLUDE (n) FROM ({metrics_sql("SELECT 'linear_q_refit' AS model, l_extendedprice / CAST(100000.0 AS DOUBLE) AS y, "
             "l_quantity * CAST(0.021 AS DOUBLE) AS p FROM lineitem", ['model'])}) r"""


def q_best_model(spark, sf):
    m = M.compare_models(_stacked(spark, sf), round_to=R, spearman=False)
    order = F.when(F.col("model") == "linear_q", 0).when(F.col("model") == "linear_qd", 1).otherwise(2)
    return M.best_model(m.withColumn("ord", order), "RMSE", "ord")


SQL_BEST_MODEL = f"""
SELECT model, RMSE FROM (
  SELECT *, CASE model WHEN 'linear_q' THEN 0 WHEN 'linear_qd' THEN 1 ELSE 2 END AS ord
  FROM ({metrics_sql(_stacked_sql(), ['model'])}) x) y
ORDER BY RMSE, ord LIMIT 1"""


def q_eval_tables(spark, sf):
    """Validation and test metrics per model, tagged, validation first (U4).

    Lineitems inherit the split of their order (stratified on total price).
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    split = SP.stratified_split(orders, "o_totalprice", "o_orderkey").select(
        F.col("o_orderkey").alias("l_orderkey"), "split")
    li = table(spark, sf, "lineitem").join(split, "l_orderkey")
    part = _stacked(spark, sf, li.where(F.col("split").isin("val", "test")), ["split"])
    m = M.regression_metrics(part, "y", "p", ["split", "model"], round_to=R)
    return m.select(F.when(F.col("split") == "val", "validation").otherwise("test").alias("split"),
                    F.concat("split", F.lit(".parquet")).alias("source_file"),
                    *[c for c in m.columns if c != "split"])


_SPLIT_SQL = """SELECT l.*, s.split FROM lineitem l JOIN (
  SELECT o_orderkey, CASE WHEN ord <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
           WHEN ord <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val'
           ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, o_orderkey) AS ord,
               count(*) OVER (PARTITION BY stratum) AS n
        FROM (SELECT o_orderkey, CASE WHEN o_totalprice < q1 THEN 0 WHEN o_totalprice < q2 THEN 1
                                      WHEN o_totalprice < q3 THEN 2 ELSE 3 END AS stratum,
                     md5('42|' || CAST(o_orderkey AS VARCHAR)) AS h
              FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
                                   quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) q) a) b) s
  ON l.l_orderkey = s.o_orderkey"""

SQL_EVAL_TABLES = f"""
SELECT 'validation' AS split, 'val.parquet' AS source_file, * FROM (
  {metrics_sql(_stacked_sql(f"({_SPLIT_SQL}) sv WHERE split = 'val'"), ['model'])}) v
UNION ALL
SELECT 'test' AS split, 'test.parquet' AS source_file, * FROM (
  {metrics_sql(_stacked_sql(f"({_SPLIT_SQL}) st WHERE split = 'test'"), ['model'])}) t"""


QUERIES = {
    "metrics_overall": q_metrics_overall,
    "metrics_by_length": q_metrics_by_length,
    "metrics_by_source": q_metrics_by_source,
    "error_hist": q_error_hist,
    "density_grid": q_density_grid,
    "density_hex": q_density_hex,
    "axis_limits": q_axis_limits,
    "model_compare": q_model_compare,
    "metric_upsert": q_metric_upsert,
    "best_model": q_best_model,
    "eval_tables": q_eval_tables,
}

ORACLES = {
    "metrics_overall": SQL_METRICS_OVERALL,
    "metrics_by_length": SQL_METRICS_BY_LENGTH,
    "metrics_by_source": SQL_METRICS_BY_SOURCE,
    "error_hist": SQL_ERROR_HIST,
    "density_grid": SQL_DENSITY_GRID,
    "density_hex": SQL_DENSITY_HEX,
    "axis_limits": SQL_AXIS_LIMITS,
    "model_compare": SQL_MODEL_COMPARE,
    "metric_upsert": SQL_METRIC_UPSERT,
    "best_model": SQL_BEST_MODEL,
    "eval_tables": SQL_EVAL_TABLES,
}
