"""Boosted regression trees with second-order histogram splits.

Features are binned once at the cut points of a quantile sketch. A tree grows level by level: one pass over the
binned rows sums gradient and row count per (node, feature, bin) inside each task, one aggregation merges them,
prefix sums over the bins give every split's gain, and the best split of each node (at most ``2 ** depth`` rows) reaches
the driver. Leaves are ``-G / (H + l2)``. Columns are drawn per tree, rows per tree by a hash of their key. The
validation error of the trees so far comes with the first pass of the next tree, so early stopping costs no job.

Gradients (squared error) are whole numbers of ``1 / SCALE``, so sums, gains and trees do not depend on how the
rows are partitioned or merged. Predictions so far are written with the rows every ``KEEP`` trees: a pass evaluates
few trees, and lost executors cost tasks of one pass.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutascope.session import scratch_path

SCALE = 1_000_000  # gradient units
KEEP = 10          # trees after which the predictions are written
TREE_SCHEMA = "tree int, node int, feature int, threshold double, gain double, cover long, value double"


@dataclass(frozen=True)
class Params:
    """The reference's settings, and the usual defaults of second-order boosting for the rest."""
    depth: int = 6
    rounds: int = 500
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42
    patience: int = 20
    bins: int = 256
    l2: float = 1.0
    min_cover: int = 1
    min_gain: float = 1e-6


@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2n and 2n + 1); a leaf has feature -1 and a value."""
    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n))

    def place(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The node each row of ``x`` ends in; rows go right above ``cut`` of their node."""
        at = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + right, at)


@dataclass
class Boosted:
    """A fitted model: start value and trees, with the validation error after each round fitted."""
    base: float
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        """``TREE_SCHEMA``: one row per node; the start value is the leaf of tree 0."""
        rows = [(0, 1, -1, None, None, None, float(self.base))]
        for t, tree in enumerate(self.trees, 1):
            for n in np.flatnonzero(tree.cover):
                inner = tree.feature[n] >= 0
                rows.append((t, int(n), int(tree.feature[n]), float(tree.threshold[n]) if inner else None,
                             float(tree.gain[n]) if inner else None, int(tree.cover[n]), None if inner else float(tree.value[n])))
        return spark.createDataFrame(rows, TREE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        rows = spark.read.parquet(path).orderBy("tree", "node").collect()
        out = cls(next(r.value for r in rows if r.tree == 0))
        for t in range(1, max(r.tree for r in rows) + 1):
            own = [r for r in rows if r.tree == t]
            tree = Tree.empty(max(r.node for r in own).bit_length() - 1)
            for r in own:
                tree.feature[r.node], tree.cover[r.node] = r.feature, r.cover
                tree.threshold[r.node], tree.gain[r.node], tree.value[r.node] = r.threshold or 0.0, r.gain or 0.0, r.value or 0.0
            out.trees.append(tree)
        return out


def tree_columns(p: Params, tree: int, d: int) -> list[int]:
    """The features a tree may split on."""
    return sorted(random.Random(f"{p.seed}|{tree}").sample(range(d), max(1, int(p.columns * d))))


def in_tree(p: Params, tree: int, key: str) -> Column:
    """Whether a row takes part in a tree: a pure function of seed, tree and key."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{p.seed}|{tree}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return head < int(p.rows * (1 << 32))


def feature_cuts(rows: DataFrame, features: str, d: int, bins: int, group: int = 256) -> list[np.ndarray]:
    """At most ``bins - 1`` distinct cut points per feature, from quantile sketches (one pass for ``group`` features)."""
    shares = [k / bins for k in range(1, bins)]
    out = []
    for first in range(0, d, group):
        sketches = [F.percentile_approx(F.get(F.col(features), F.lit(j)).cast("double"), shares, 10_000).alias(f"c{j}")
                    for j in range(first, min(first + group, d))]
        row = rows.agg(*sketches).first()
        out += [np.unique(np.array(c or [], float)) for c in row]
    return out


def binned(rows: DataFrame, features: str, cuts: list[np.ndarray], start: float) -> DataFrame:
    """_key, _y, _val, _at (prediction so far) and _bins (one byte per feature): how many cut points are below the value."""
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("_x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(cuts))
            out = np.empty(x.shape, np.uint8)
            for j, c in enumerate(cuts):
                out[:, j] = np.searchsorted(c, x[:, j], side="left")
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y"), batch.column("_val"),
                                              pa.array(np.full(len(x), start)), pa.array([r.tobytes() for r in out], pa.binary())],
                                             names=["_key", "_y", "_val", "_at", "_bins"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_key", "_y", "_val", F.col(features).alias("_x")).mapInArrow(
        run, f"_key {kind}, _y double, _val boolean, _at double, _bins binary")


def _advanced(at: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        at = at + tree.value[tree.place(bins, tree.bin)]
    return at


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_bins").to_pylist()), np.uint8).reshape(batch.num_rows, d)


def histograms(rows: DataFrame, d: int, trees: list[Tree], growing: Tree, level: int, columns: list[int]) -> DataFrame:
    """(node, feature, bin, g, h): gradient and row sums of the growing tree's nodes on ``level``; the squared error and
    count of the validation rows stand under node 0. ``trees`` are those since the predictions were written."""
    first = 1 << level
    wide = np.array(columns)

    def run(batches):
        g = np.zeros(first * len(wide) * 256)
        h = np.zeros(first * len(wide) * 256)
        error, seen = 0, 0
        for batch in batches:
            bins = _matrix(batch, d)
            gap = _advanced(batch.column("_at").to_numpy(), bins, trees) - batch.column("_y").to_numpy()
            val = batch.column("_val").to_numpy(zero_copy_only=False).astype(bool)
            error += int(np.rint(gap[val] * gap[val] * SCALE).astype(np.int64).sum())
            seen += int(val.sum())
            bins, gap = bins[~val], gap[~val]
            node = growing.place(bins, growing.bin) - first
            here = node >= 0  # the others ended in a leaf above
            at = ((node[here, None] * len(wide) + np.arange(len(wide))) * 256 + bins[here][:, wide]).ravel()
            g += np.bincount(at, np.repeat(np.rint(gap[here] * SCALE), len(wide)), len(g))
            h += np.bincount(at, minlength=len(h))
        full = np.flatnonzero(h)
        node, rest = np.divmod(full, len(wide) * 256)
        feature, cell = np.divmod(rest, 256)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(node + first, 0).astype(np.int32)), pa.array(np.append(wide[feature], -1).astype(np.int32)),
             pa.array(np.append(cell, 0).astype(np.int32)), pa.array(np.append(g[full].astype(np.int64), error)),
             pa.array(np.append(h[full].astype(np.int64), seen))], names=["node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, "node int, feature int, bin int, g long, h long")


def best_splits(sums: DataFrame, p: Params) -> DataFrame:
    """Per node the split of largest gain (ties: lowest feature, lowest bin), with the sums left of it and in all."""
    sums = sums.repartition("node", "feature")  # tasks have summed already; one exchange serves the sums and the windows
    sums = sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    ahead = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")
    rows = sums.select("node", "feature", "bin", F.sum("g").over(ahead).alias("gl"), F.sum("h").over(ahead).alias("hl"),
                       F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h"))

    def part(g: Column, h: Column) -> Column:
        g = g.cast("double") / F.lit(float(SCALE))
        return g * g / (h.cast("double") + F.lit(p.l2))

    rest_g, rest_h = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = (part(F.col("gl"), F.col("hl")) + part(rest_g, rest_h) - part(F.col("g"), F.col("h"))) * F.lit(0.5)
    fits = (F.col("hl") >= p.min_cover) & (rest_h >= p.min_cover)
    rows = rows.withColumn("gain", F.when(fits, gain).otherwise(F.lit(-1.0)))
    top = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "g", "h")).alias("x")
    return rows.groupBy("node").agg(top).select("node", "x.gain", (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("bin"),
                                                "x.gl", "x.hl", "x.g", "x.h")


def fit_boosted(train: DataFrame, features: str, label: str, key: str, val: DataFrame | None = None, p: Params = Params()) -> Boosted:
    """Fit on ``train`` (``features``: an array column, ``key``: unique); with ``val`` stop after ``patience`` rounds without
    a better validation error and keep the best prefix."""
    if p.bins > 256:
        raise ValueError("at most 256 bins: a bin number is one byte")
    spark = train.sparkSession

    def rows_of(df: DataFrame, held: bool) -> DataFrame:
        return df.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_y"), F.lit(held).alias("_val"), F.col(features).alias("_f"))

    own = rows_of(train, False)
    head = own.agg(F.max(F.size("_f")).alias("d"), F.avg("_y").alias("m")).first()
    if head.d is None:
        raise ValueError("no training rows")
    d, model = head.d, Boosted(round(head.m, 6))
    cuts = feature_cuts(own, "_f", d, p.bins)

    def write(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boosting")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = write(binned(own if val is None else own.unionByName(rows_of(val, True)), "_f", cuts, model.base))
    recent: list[Tree] = []
    best, best_round = float("inf"), 0
    for t in range(1, p.rounds + 2):  # the last turn only reads the error of the last tree
        if t > p.rounds and val is None:
            break
        if len(recent) == KEEP:
            rows, recent = write(_moved(rows, d, recent)), []
        tree, columns = Tree.empty(p.depth), tree_columns(p, t, d)
        part = in_tree(p, t, "_key") & ~F.col("_val")
        for level in range(p.depth):
            of = rows.where(part | F.col("_val")) if level == 0 and val is not None else rows.where(part)
            found = {r.node: r for r in best_splits(histograms(of, d, recent, tree, level, columns), p).collect()}
            checked = found.pop(0, None)
            if level == 0 and t > 1 and checked is not None and checked.h:
                model.errors.append((checked.g / SCALE / checked.h) ** 0.5)
                if model.errors[-1] < best:
                    best, best_round = model.errors[-1], t - 1
                if t > p.rounds or t - 1 - best_round >= p.patience:
                    model.trees = model.trees[:best_round]
                    return model
            for n, r in found.items():
                _grow(tree, n, r, cuts, p)
            if not any(tree.feature[n] >= 0 for n in found):
                break
        if t <= p.rounds:
            model.trees.append(tree)
            recent.append(tree)
    return model


def _grow(tree: Tree, node: int, r, cuts: list[np.ndarray], p: Params) -> None:
    """Enter a node's best split, or make it a leaf; children are leaves until they are split."""
    def leaf(n: int, g: int, h: int) -> None:
        tree.value[n] = p.rate * (-(g / SCALE) / (h + p.l2))
        tree.cover[n] = h

    leaf(node, r.g, r.h)
    if r.gain > p.min_gain and r.bin < len(cuts[r.feature]):
        tree.feature[node], tree.bin[node], tree.gain[node] = r.feature, r.bin, r.gain
        tree.threshold[node], tree.value[node] = cuts[r.feature][r.bin], 0.0
        leaf(2 * node, r.gl, r.hl)
        leaf(2 * node + 1, r.g - r.gl, r.h - r.hl)


def _moved(rows: DataFrame, d: int, trees: list[Tree]) -> DataFrame:
    """The rows with the trees' values added to the prediction so far."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            at = _advanced(batch.column("_at").to_numpy(), _matrix(batch, d), trees)
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "_at" else pa.array(at) for c in names], names=names)

    return rows.mapInArrow(run, rows.schema)


def score_boosted(model: Boosted, df: DataFrame, features: str, id_col: str, out: str = "prediction") -> DataFrame:
    """``id_col`` and the single-precision prediction of every row."""
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            at = np.full(len(x), model.base)
            for tree in model.trees:
                at = at + tree.value[tree.place(x, tree.threshold)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.float32))], names=[id_col, out])

    return df.select(id_col, features).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, {out} float")


def importances(model: Boosted, spark: SparkSession, names: list[str], k: int = 10) -> DataFrame:
    """The ``k`` features of largest mean gain per split, as shares of all features' (ties by name)."""
    inner = model.table(spark).where("feature >= 0")
    mean = inner.groupBy("feature").agg(F.avg("gain").alias("gain"))
    total = mean.agg(F.sum("gain").alias("all"))
    named = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    return (mean.join(named, "feature").join(F.broadcast(total)).select(F.col("name").alias("feature"), (F.col("gain") / F.col("all")).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature").limit(k))


__all__ = ["Params", "Tree", "Boosted", "fit_boosted", "score_boosted", "importances", "feature_cuts", "best_splits", "histograms"]
