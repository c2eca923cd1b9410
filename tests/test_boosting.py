import numpy as np
import pytest

from mutascope.operators import boosting as B


def _rows(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = 3 * (x[:, 0] > 0.2) + x[:, 1] + 0.05 * rng.normal(size=n)
    return spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(n)], "id long, x array<double>, y double")


def _brute_root(x, y, bins, l2=1.0):
    """Best first split over all features and cut points, by definition."""
    g = np.rint((round(float(y.mean()), 6) - y) * B.SCALE) / B.SCALE
    best = (-1.0, None, None)
    for j in range(x.shape[1]):
        s = np.sort(x[:, j])
        for c in np.unique([s[int(np.ceil(k / bins * len(s))) - 1] for k in range(1, bins)]):
            left = x[:, j] <= c
            if 0 < left.sum() < len(x):
                gain = 0.5 * (g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - g.sum() ** 2 / (len(x) + l2))
                if gain > best[0] + 1e-9:
                    best = (gain, j, c)
    return best


def test_first_split_matches_brute_force_and_partitions_do_not_matter(spark):
    df = _rows(spark)
    p = B.Params(depth=3, rounds=2, rows=1.0, columns=1.0, bins=8)
    x = np.array([r.x for r in df.orderBy("id").collect()])
    y = np.array([r.y for r in df.orderBy("id").collect()])
    one, other = (B.fit_boosted(df.repartition(n), "x", "y", "id", p=p).table(spark).orderBy("tree", "node").collect() for n in (1, 7))
    assert one == other
    gain, j, c = _brute_root(x, y, 8)
    root = next(r for r in one if r.tree == 1 and r.node == 1)
    assert (root.feature, root.threshold) == (j, c) and root.gain == pytest.approx(gain) and root.cover == len(x)
    leaves = [r for r in one if r.tree == 1 and r.feature < 0]
    assert sum(r.cover for r in leaves) == len(x)


def test_early_stop_keeps_the_best_prefix_and_models_reload(spark, tmp_path):
    df = _rows(spark)
    p = B.Params(depth=2, rounds=14, patience=3, rate=0.9, bins=16)
    model = B.fit_boosted(df.where("id < 160"), "x", "y", "id", df.where("id >= 160"), p)
    best = int(np.argmin(model.errors)) + 1
    assert len(model.trees) == best and (len(model.errors) == best + 3 or len(model.errors) == 14)
    held = df.where("id >= 160")
    pred = {r.id: r.prediction for r in B.score_boosted(model, held, "x", "id").collect()}
    rmse = np.sqrt(np.mean([(r.y - pred[r.id]) ** 2 for r in held.collect()]))
    assert rmse == pytest.approx(model.errors[best - 1], abs=1e-3)
    model.save(spark, str(tmp_path / "m"))
    again = B.Boosted.load(spark, str(tmp_path / "m"))
    assert {r.id: r.prediction for r in B.score_boosted(again, held, "x", "id").collect()} == pred


def test_constant_target_and_no_rows(spark):
    df = spark.createDataFrame([(k, [float(k)], 2.0) for k in range(9)], "id long, x array<double>, y double")
    model = B.fit_boosted(df, "x", "y", "id", p=B.Params(rounds=1, rows=1.0))
    assert {r.prediction for r in B.score_boosted(model, df, "x", "id").collect()} == {2.0}
    with pytest.raises(ValueError, match="no training rows"):
        B.fit_boosted(df.where("id < 0"), "x", "y", "id")
