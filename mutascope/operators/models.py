"""Models: standardisation, ridge, boosted trees, dense-network head, joins to labels.

Fitting uses MLlib (distributed aggregation of sufficient statistics / trees);
scoring is a column expression (linear) or an Arrow batch map (dense network).
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------------------
# Joins of vectors to labels / metadata
# ---------------------------------------------------------------------------

def join_labels(emb: DataFrame, labels: DataFrame, key: str, order: str | None = None,
                on_duplicate: str = "last", how: str = "inner", strict: bool = False) -> DataFrame:
    """Attach label rows to vectors by key.

    ``last``: duplicate label keys resolve to the last row in ``order``, which
    is required (aggregated with ``max_by``, partial on the map side);
    ``expand``: every duplicate multiplies the vector row (plain equi-join).
    ``strict``: a vector without a label is an error (one anti-join is run).
    """
    if on_duplicate == "last":
        if order is None:
            raise ValueError("on_duplicate='last' needs an order column")
        rest = [c for c in labels.columns if c != key]
        labels = labels.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(
            key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    elif on_duplicate != "expand":
        raise ValueError(f"unknown duplicate policy {on_duplicate}")
    if strict:
        lost = [r[key] for r in missing_labels(emb, labels, key).select(key).limit(3).collect()]
        if lost:
            raise ValueError(f"vectors without a label, for example {lost}")
    return emb.join(labels, key, how)


def missing_labels(emb: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Vector rows without a label (strict mode fails when this is non-empty)."""
    return emb.join(labels.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------------------
# Standardisation (population std; zero variance -> scale 1)
# ---------------------------------------------------------------------------

def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] if r[f"s_{c}"] else 1.0) for c in cols}


def standardize(df: DataFrame, cols: Sequence[str], scaler: dict | None = None,
                prefix: str = "z_") -> DataFrame:
    scaler = scaler or fit_scaler(df, cols)
    for c in cols:
        m, s = scaler[c]
        df = df.withColumn(f"{prefix}{c}", (F.col(c) - F.lit(m)) / F.lit(s))
    return df


# ---------------------------------------------------------------------------
# Ridge
# ---------------------------------------------------------------------------

def _vector(df: DataFrame, features: str | Sequence[str], out: str = "_features") -> DataFrame:
    if isinstance(features, str):
        dtype = dict(df.dtypes)[features]
        if dtype.startswith("array"):
            return df.withColumn(out, array_to_vector(F.col(features).cast("array<double>")))
        return df.withColumn(out, F.col(features))
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def fit_ridge(df: DataFrame, features: str | Sequence[str], label: str, alpha: float = 1.0) -> dict:
    """Ridge with an unpenalised intercept on standardised features.

    Minimises sum (y - b - x_s.w)^2 + alpha * |w|^2 with x_s standardised by the
    population std; returns weights on the raw feature scale. Solved by
    MLlib's normal-equation solver (one distributed pass for the Gram matrix,
    d x d solve on the driver; d <= 4096).
    """
    data = _vector(df.where(F.col(label).isNotNull()), features).select(
        "_features", F.col(label).cast("double").alias("_y"))
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_y").alias("sy")).first()
    n, sy = st["n"], st["sy"] or 0.0
    # MLlib scales its penalty by the label std and the sample count.
    reg = alpha / n * sy if sy > 0 else 0.0
    lr = LinearRegression(featuresCol="_features", labelCol="_y", solver="normal",
                          elasticNetParam=0.0, standardization=True, regParam=reg, fitIntercept=True)
    model = lr.fit(data)
    return {"weights": [float(w) for w in model.coefficients], "intercept": float(model.intercept),
            "n": n, "alpha": alpha}


def score_linear(df: DataFrame, features: str | Sequence[str], weights: Sequence[float],
                 intercept: float, out: str = "prediction") -> DataFrame:
    """Dot product + intercept as a column expression, single precision out."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    if isinstance(features, str):
        x = F.col(features).cast("array<double>")
    else:
        x = F.array(*[F.col(c).cast("double") for c in features])
    dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn(out, (dot + F.lit(float(intercept))).cast("float"))


# ---------------------------------------------------------------------------
# Boosted trees
# ---------------------------------------------------------------------------

# Depth 6, 500 rounds, learning rate 0.05, row/column sampling 0.8, seed 42.
# Node ids are cached and checkpointed every 10 rounds (long lineages at scale).
GBT_DEFAULTS = dict(maxDepth=6, maxIter=500, stepSize=0.05, subsamplingRate=0.8,
                    featureSubsetStrategy="0.8", seed=42, maxBins=256,
                    cacheNodeIds=True, checkpointInterval=10)


ROWS_PER_PART = 8192  # training rows a task holds on average, however many there are


def _patience_stop(rmse: list[float], patience: int) -> tuple[int, bool]:
    """(best round count, whether the patience rule fired within ``rmse``)."""
    best, best_i, since = float("inf"), 0, 0
    for i, r in enumerate(rmse):
        if r < best:
            best, best_i, since = r, i, 0
        else:
            since += 1
            if since >= patience:
                return best_i + 1, True
    return best_i + 1, False


def _prefix(model, rounds: int):
    """The model of the first ``rounds`` trees of a fitted one (no refit)."""
    sc = SparkContext._active_spark_context
    tree_class = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = sc._gateway.new_array(tree_class, rounds), sc._gateway.new_array(sc._jvm.double, rounds)
    for k, (tree, weight) in enumerate(zip(model._java_obj.trees(), model.treeWeights)):
        if k == rounds:
            break
        trees[k], weights[k] = tree, float(weight)
    short = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, weights, model.numFeatures)
    return GBTRegressionModel(model._java_obj.copyValues(short, model._java_obj.extractParamMap()))


def fit_gbt(train: DataFrame, features: str | Sequence[str], label: str, key: str,
            val: DataFrame | None = None, patience: int = 20, num_partitions: int = 8, **params):
    """Gradient-boosted regression trees with patience-based early stopping.

    Tree k depends only on its seed (seed + k) and the trees before it, so a
    k-round fit is the prefix of any longer fit. Rounds are fitted in growing
    batches (2 x patience, doubling, up to ``maxIter``); after each, the
    validation RMSE of every prefix is read (``evaluateEachIteration``) and the
    patience rule applied; the result is the best prefix of the longest fit.

    Row sampling is drawn per partition in row order, so training rows are dealt
    into partitions by ``key`` (unique) and sorted by it: the same rows give the
    same model however the input was partitioned. There are ``num_partitions``,
    or as many as give each ``ROWS_PER_PART`` rows if those are more, so that
    the work of a task stays bounded; their number is a parameter of the model.
    Returns ``(model, best_rounds, val_rmse_per_round)``.
    """
    p = dict(GBT_DEFAULTS)
    p.update(params)
    from mutascope.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(train.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        return _vector(df, features).select(F.col(key).alias("_key"), "_features", F.col(label).cast("double").alias("_y"))

    parts = max(num_partitions, -(-train.count() // ROWS_PER_PART))
    tr = rows(train).repartition(parts, "_key").sortWithinPartitions("_key").cache()
    max_iter = p["maxIter"]

    def fit(rounds):
        q = dict(p)
        q["maxIter"] = rounds
        return GBTRegressor(featuresCol="_features", labelCol="_y", **q).fit(tr)

    if val is None:
        model = fit(max_iter)
        tr.unpersist()
        return model, max_iter, []
    va = rows(val).cache()
    rounds = min(max_iter, max(2 * patience, 1))
    while True:
        model = fit(rounds)
        # squared-error loss of every ensemble prefix = mean (y - f_k)^2
        rmse = [math.sqrt(v) for v in model.evaluateEachIteration(va, "squared")]
        best, fired = _patience_stop(rmse, patience)
        if fired or rounds >= max_iter:
            break
        rounds = min(max_iter, rounds * 2)
    if best < rounds:
        model = _prefix(model, best)
    tr.unpersist()
    va.unpersist()
    return model, best, rmse


def score_model(model, df: DataFrame, features: str | Sequence[str], out: str = "prediction") -> DataFrame:
    """Score with a fitted MLlib model; single-precision output column."""
    scored = model.transform(_vector(df, features))
    return scored.withColumn(out, F.col("prediction").cast("float")).drop("_features")


def feature_importances(spark, model, names: Sequence[str], k: int = 10) -> DataFrame:
    """Top-``k`` importances with feature names (a small table)."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature").limit(k)


# ---------------------------------------------------------------------------
# Dense network head (inference only)
# ---------------------------------------------------------------------------

MLP_WEIGHTS_SCHEMA = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("weight", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("bias", T.ArrayType(T.DoubleType())),
    T.StructField("bn_gamma", T.ArrayType(T.DoubleType())),
    T.StructField("bn_beta", T.ArrayType(T.DoubleType())),
    T.StructField("bn_mean", T.ArrayType(T.DoubleType())),
    T.StructField("bn_var", T.ArrayType(T.DoubleType())),
])
BN_EPS = 1e-5
MAX_WEIGHTS = 50_000_000


# Rational coefficients of erf (W. J. Cody 1969) on |x| < 0.5, 0.5..4 and above; fixed values.
_ERF_A = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
_ERF_B = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_ERF_C = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
          8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
_ERF_D = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
          3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
_ERF_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
_ERF_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function to double precision, whole arrays at a time."""
    a = np.abs(x)
    low, mid = np.minimum(a, 0.5), np.clip(a, 0.46875, 4.0)
    high = np.clip(a, 4.0, 6.5)
    small = low * np.polyval(_ERF_A, low * low) / np.polyval(_ERF_B, low * low)
    middle = 1.0 - np.exp(-mid * mid) * np.polyval(_ERF_C, mid) / np.polyval(_ERF_D, mid)
    z = 1.0 / (high * high)
    tail = z * np.polyval(_ERF_P, z) / np.polyval(_ERF_Q, z)
    large = 1.0 - np.exp(-high * high) / high * (1.0 / math.sqrt(math.pi) - tail)
    return np.sign(x) * np.where(a <= 0.46875, small, np.where(a <= 4.0, middle, large))


def fold_layers(weights: list[dict]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Fold batch-norm into each hidden linear layer: W' = W*g/sqrt(v+eps) ..."""
    layers = []
    ordered = sorted(weights, key=lambda r: r["layer"])
    for i, r in enumerate(ordered):
        w = np.asarray(r["weight"], dtype=np.float64)      # [out, in]
        b = np.asarray(r["bias"], dtype=np.float64)
        hidden = r.get("bn_gamma") is not None and i < len(ordered) - 1
        if hidden:
            g = np.asarray(r["bn_gamma"]) / np.sqrt(np.asarray(r["bn_var"]) + BN_EPS)
            w = w * g[:, None]
            b = (b - np.asarray(r["bn_mean"])) * g + np.asarray(r["bn_beta"])
        layers.append((w, b, hidden))
    return layers


def mlp_forward(x: np.ndarray, layers) -> np.ndarray:
    h = x.astype(np.float64)
    for w, b, hidden in layers:
        h = h @ w.T + b
        if hidden:
            h = 0.5 * h * (1.0 + _erf(h / math.sqrt(2.0)))      # exact GELU
    return h[:, 0].astype(np.float32)


def score_mlp(df: DataFrame, features: str, weights: DataFrame, id_col: str,
              out: str = "prediction") -> DataFrame:
    """Score an array<float> column with a dense network given as a weight table.

    The weight table has one row per layer; it is collected and shipped with the
    task closure after a check of its size (``MAX_WEIGHTS`` numbers). Rows stream
    through in Arrow batches.
    """
    size = weights.agg(F.sum(F.size(F.flatten("weight"))).alias("n")).first().n or 0
    if size > MAX_WEIGHTS:
        raise ValueError(f"dense head of {size} weights; the limit is {MAX_WEIGHTS}")
    rows = [r.asDict(recursive=True) for r in weights.collect()]
    layers = fold_layers(rows)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[features].values])
            yield pd.DataFrame({id_col: pdf[id_col].values, out: mlp_forward(x, layers)})

    id_type = dict(df.dtypes)[id_col]
    return df.select(id_col, features).mapInPandas(run, f"{id_col} {id_type}, {out} float")


__all__ = ["join_labels", "missing_labels", "fit_scaler", "standardize", "fit_ridge", "score_linear",
           "fit_gbt", "score_model", "feature_importances", "score_mlp", "mlp_forward", "fold_layers"]
