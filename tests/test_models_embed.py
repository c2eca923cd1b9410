import numpy as np
import pytest
from pyspark.sql import functions as F

from mutascope.operators import embed as E
from mutascope.operators import models as MD
from tests import reference_model as ref


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 4)) * np.array([1.0, 5.0, 0.1, 2.0])
    y = X @ np.array([0.5, -0.2, 3.0, 0.0]) + rng.normal(size=200) * 0.3 + 1.0
    df = spark.createDataFrame([(list(map(float, x)), float(t)) for x, t in zip(X, y)], "x array<double>, y double")
    alpha = 50.0
    fit = MD.fit_ridge(df, "x", "y", alpha=alpha)
    mu, sd = X.mean(0), X.std(0)
    Xs = (X - mu) / sd
    w_s = np.linalg.solve(Xs.T @ Xs + alpha * np.eye(4), Xs.T @ (y - y.mean()))
    w = w_s / sd
    assert np.allclose(fit["weights"], w, atol=1e-7)
    assert fit["intercept"] == pytest.approx(y.mean() - mu @ w, abs=1e-7)


def test_mlp_matches_numpy_loop(spark):
    from mutascope.plans.model_queries import toy_mlp_weights
    wdf = toy_mlp_weights(spark, dims=(3, 4, 2, 1))
    rows = [r.asDict(recursive=True) for r in wdf.orderBy("layer").collect()]
    x = np.array([[0.1, -0.2, 0.3], [1.0, 2.0, -1.0]])
    h = x.copy()
    for i, r in enumerate(rows):
        h = h @ np.array(r["weight"]).T + np.array(r["bias"])
        if i < len(rows) - 1:
            h = (h - np.array(r["bn_mean"])) / np.sqrt(np.array(r["bn_var"]) + 1e-5) * np.array(r["bn_gamma"]) \
                + np.array(r["bn_beta"])
            from math import erf
            h = 0.5 * h * (1 + np.vectorize(erf)(h / np.sqrt(2)))
    df = spark.createDataFrame([(0, x[0].tolist()), (1, x[1].tolist())], "id int, v array<double>")
    got = {r["id"]: r["prediction"] for r in MD.score_mlp(df, "v", wdf, "id").collect()}
    assert got[0] == pytest.approx(h[0, 0], rel=1e-5) and got[1] == pytest.approx(h[1, 0], rel=1e-5)


def test_mean_pool_ignores_markers(spark):
    big = 1e6
    tokens = [[big, big], [1.0, 2.0], [3.0, 4.0], [big, big], [big, big]]
    df = spark.createDataFrame([(tokens, 2)], "t array<array<float>>, n int")
    assert E.mean_pool(df, "t", "n").first()["embedding"] == [2.0, 3.0]
    enc = E.ResidueScaleEncoder()
    v = enc.encode(["AC", "W"])
    assert v[0][0] == pytest.approx(0.5) and v[0][1] == pytest.approx(0.5) and v[1][18] == pytest.approx(1.0)
    assert abs(v).max() < 10


def test_embed_job_resume_adds_nothing(spark, tmp_dir):
    df = spark.createDataFrame([("a", "MKV"), ("b", "A" * 1100), ("c", "WW")], "id string, s string")
    store = f"{tmp_dir}/store"
    r1 = E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), store, "id", "s")
    r2 = E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), store, "id", "s")
    assert (r1["embedded"], r1["skipped"], r1["stored"]) == (2, 1, 2)
    assert (r2["embedded"], r2["already_done"], r2["stored"]) == (0, 2, 2)


def test_kmer_encoder_counts(spark):
    enc = E.KmerHashEncoder(k=2, dim=16)
    v = enc.encode(["ACAC"])[0]
    assert v.sum() == pytest.approx(1.0)
    assert sorted(v[v > 0].tolist()) == pytest.approx([1 / 3, 2 / 3], rel=1e-6)


def test_join_labels_last_wins_and_expand(spark):
    emb = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9)], "id int, e double")
    lab = spark.createDataFrame([(1, 10.0, 0), (1, 11.0, 1), (2, 20.0, 2)], "id int, y double, o int")
    last = {r["id"]: r["y"] for r in MD.join_labels(emb, lab, "id", order="o").collect()}
    assert last == {1: 11.0, 2: 20.0}
    assert MD.join_labels(emb, lab.drop("o"), "id", on_duplicate="expand").count() == 3
    assert [r["id"] for r in MD.missing_labels(emb, lab, "id").collect()] == [3]


def test_gbt_patience(spark):
    rng = np.random.default_rng(1)
    rows = [(list(map(float, rng.normal(size=3))), float(i % 2), i) for i in range(120)]
    df = spark.createDataFrame(rows, "x array<double>, y double, id long")
    model, rounds, rmse = MD.fit_gbt(df, "x", "y", "id", df, patience=3, maxIter=12, maxDepth=2)
    assert 1 <= rounds <= 12 and len(rmse) >= rounds
    assert model.getNumTrees == rounds
    assert MD._patience_stop([5, 4, 4.5, 4.6, 4.7, 3], 3) == (2, True)
    assert MD._patience_stop([5, 4, 3], 3) == (3, False)
    # a shorter fit is the prefix of a longer one (same seed, same partitions)
    from pyspark.ml.regression import GBTRegressor
    tr = MD._vector(df, "x").select("_features", "y").repartition(1).cache()
    p = dict(MD.GBT_DEFAULTS, maxDepth=2)
    long = GBTRegressor(featuresCol="_features", labelCol="y", **dict(p, maxIter=6)).fit(tr)
    short = GBTRegressor(featuresCol="_features", labelCol="y", **dict(p, maxIter=3)).fit(tr)
    body = lambda t: t.toDebugString.split("\n", 1)[1]      # drop the uid line
    assert [body(t) for t in short.trees] == [body(t) for t in long.trees[:3]]


def test_embed_job_partitioned_by_split(spark, tmp_dir):
    df = spark.createDataFrame([("a", "MKV", "train"), ("b", "WWA", "val"), ("c", "AC", "test")],
                               "id string, s string, split string")
    store = f"{tmp_dir}/store"
    rep = E.embed_job(df, E.ResidueScaleEncoder(), store, "id", "s", split_col="split")
    assert rep["embedded"] == 3
    assert sorted(d for d in __import__("os").listdir(store) if d.startswith("split=")) == \
        ["split=test", "split=train", "split=val"]
    assert E.embed_job(df, E.ResidueScaleEncoder(), store, "id", "s", split_col="split")["embedded"] == 0


def test_scan_with_encoder_and_dense_head(spark):
    from mutascope.operators import scan as S
    from mutascope.operators.score import encoder_head_scorer
    from mutascope.plans.model_queries import toy_mlp_weights
    enc = E.ResidueScaleEncoder()
    weights = toy_mlp_weights(spark, dims=(enc.dim, 4, 1))
    layers = MD.fold_layers([r.asDict(recursive=True) for r in weights.collect()])
    scorer = encoder_head_scorer(enc, weights)
    seq = "MKVXA"
    df = spark.createDataFrame([("p", seq)], "id string, seq string")
    rows = {(r["position"], r["mutant_aa"]): r for r in S.scan(df, "id", "seq", scorer=scorer).collect()}
    f = lambda s: float(MD.mlp_forward(enc.encode([s]), layers)[0])
    wt = f(seq)
    assert len(rows) == 19 * 4 + 20
    for (pos, m), r in rows.items():
        mut = seq[:pos - 1] + m + seq[pos:]
        assert r["delta"] == pytest.approx(round(f(mut) - wt, 6), abs=1.1e-6)


def test_score_with_encoder_head_truncates_window(spark):
    from mutascope.operators.score import encoder_head_scorer, score
    from mutascope.plans.model_queries import toy_mlp_weights
    enc = E.ResidueScaleEncoder()
    weights = toy_mlp_weights(spark, dims=(enc.dim, 4, 1))
    layers = MD.fold_layers([r.asDict(recursive=True) for r in weights.collect()])
    seqs = [("a", "MKVLAG"), ("b", "W" * 1030)]
    df = spark.createDataFrame(seqs, "id string, seq string")
    got = {r["protein_id"]: r for r in score(df, "id", "seq", scorer=encoder_head_scorer(enc, weights)).collect()}
    for pid, s in seqs:
        want = float(MD.mlp_forward(enc.encode([s[:1022]]), layers)[0])
        assert got[pid]["predicted"] == pytest.approx(round(want, 6), abs=1.1e-6)
        assert got[pid]["sequence_length"] == len(s)


def test_gbt_does_not_depend_on_input_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(list(map(float, rng.normal(size=4))), float(rng.normal()), i) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, y double, id long")
    fits = [MD.fit_gbt(df.repartition(n), "x", "y", "id", df, patience=2, maxIter=8, maxDepth=3) for n in (2, 16)]
    assert fits[0][1] == fits[1][1] == fits[0][0].getNumTrees and fits[0][2] == pytest.approx(fits[1][2], rel=1e-9)
    a, b = ({r["id"]: r["prediction"] for r in MD.score_model(f[0], df, "x").collect()} for f in fits)
    assert a == pytest.approx(b, rel=1e-6)
    assert MD.score_model(fits[0][0], df, "x").where("prediction IS NULL").count() == 0


def test_strict_join_and_required_order(spark):
    emb = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    lab = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "id long, y long, o long")
    with pytest.raises(ValueError, match="order"):
        MD.join_labels(emb, lab, "id")
    with pytest.raises(ValueError, match="2"):
        MD.join_labels(emb, lab, "id", order="o", strict=True)
    assert MD.join_labels(emb.where("id = 1"), lab, "id", order="o", strict=True).first()["y"] == 6


def test_store_errors_are_not_an_empty_store(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/bad")
    with open(f"{tmp_dir}/bad/part-0.parquet", "wb") as f:
        f.write(b"not parquet at all")
    with pytest.raises(Exception):
        E.stored_ids(spark, f"{tmp_dir}/bad").collect()
    assert E.stored_ids(spark, f"{tmp_dir}/missing").collect() == []


def test_one_id_in_two_splits_is_embedded_in_both(spark, tmp_dir):
    rows = [("p1", "MKVLA", "train"), ("p1", "MKVLA", "test"), ("p2", "ACD", "train")]
    df = spark.createDataFrame(rows, "protein_id string, sequence string, split string")
    store = f"{tmp_dir}/store"
    enc = E.ResidueScaleEncoder()
    assert E.embed_job(df.where("split = 'train'"), enc, store, split_col="split")["embedded"] == 2
    assert E.embed_job(df, enc, store, split_col="split")["embedded"] == 1
    assert E.embed_job(df, enc, store, split_col="split")["embedded"] == 0


def test_gbt_returns_the_best_prefix_without_a_refit(spark, tmp_dir):
    """Noise labels: validation stops early, the result is a shorter model that scores, saves and loads."""
    from pyspark.ml.regression import GBTRegressionModel
    rng = np.random.default_rng(11)
    rows = [(list(map(float, rng.normal(size=3))), float(rng.normal()), i) for i in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, y double, id long")
    model, best, rmse = MD.fit_gbt(df.where("id < 140"), "x", "y", "id", df.where("id >= 140"), patience=3, maxIter=30, maxDepth=3)
    assert best < len(rmse) and model.getNumTrees == best and len(model.treeWeights) == best
    scored = MD.score_model(model, df.where("id >= 140"), "x").collect()
    assert np.sqrt(np.mean([(r["y"] - r["prediction"]) ** 2 for r in scored])) == pytest.approx(rmse[best - 1], rel=1e-4)
    model.write().overwrite().save(f"{tmp_dir}/gbt")
    assert GBTRegressionModel.load(f"{tmp_dir}/gbt").getNumTrees == best
    assert MD.feature_importances(spark, model, ["a", "b", "c"]).count() == 3
