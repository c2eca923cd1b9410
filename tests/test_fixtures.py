"""Cases listed in FIXTURES.md (hand-made rows)."""

from pyspark.sql import functions as F

from mutascope.operators import metrics as M
from mutascope.operators import prep as P
from mutascope.sources import requests as RQ


def test_length_bucket_edges_and_min_rows(spark):
    rows = []
    for length, n in [(99, 10), (100, 9), (299, 1), (300, 10), (1000, 10)]:
        rows += [(float(i), float(i) + 0.5, length) for i in range(n)]
    df = spark.createDataFrame(rows, "y double, p double, seq_length int")
    got = {r["bucket"]: r["n"] for r in M.metrics_by_bucket(df, "y", "p", "seq_length").collect()}
    # [100,300) has 9 + 1 = 10 rows; a bucket of 9 alone would be dropped
    assert got == {"0-100": 10, "100-300": 10, "300-500": 10, "1000+": 10}
    only9 = df.where(F.col("seq_length") == 100)
    assert M.metrics_by_bucket(only9, "y", "p", "seq_length").count() == 0


def test_best_model_ties_and_upsert(spark):
    m = spark.createDataFrame([("ridge", 0.9, 0.15, 0.1, 0.9, 0.9, 0), ("xgb", 0.8, 0.15, 0.1, 0.8, 0.8, 1),
                               ("mlp", 0.7, 0.2, 0.1, 0.7, 0.7, 2)],
                              "model string, R2 double, RMSE double, MAE double, Pearson_r double, "
                              "Spearman_rho double, ord int")
    assert M.best_model(m, "RMSE", "ord").first()["model"] == "ridge"
    new = spark.createDataFrame([("ESM-2 ridge", 0.95, 0.1, 0.1, 0.9, 0.9, 3)], m.schema)
    old = m.unionByName(spark.createDataFrame([("ESM-2 old", 0.1, 0.9, 0.1, 0.1, 0.1, 4)], m.schema))
    up = {r["model"] for r in M.upsert_metrics(old, new, "ESM-2").collect()}
    assert up == {"ridge", "xgb", "mlp", "ESM-2 ridge"}


def test_score_request_batch_sizes(spark):
    item = {"id": "x", "sequence": "MKV"}
    rows = [("one", [item]), ("max", [dict(item, id=f"s{i}") for i in range(64)]),
            ("over", [dict(item, id=f"s{i}") for i in range(65)]), ("zero", [])]
    out = RQ.answer_score_requests(spark.createDataFrame(rows, RQ.SCORE_REQUEST_SCHEMA), max_batch=64)
    ok = out.where(F.col("batch_error").isNull()).groupBy("batch_id").count()
    assert {r["batch_id"]: r["count"] for r in ok.collect()} == {"one": 1, "max": 64}
    bad = {r["batch_id"] for r in out.where(F.col("batch_error").isNotNull()).collect()}
    assert bad == {"over", "zero"}


def test_id_in_both_files_survives_twice(spark):
    schema = [("design_name", "string"), ("full_sequence", "string"), ("seq_length", "int"),
              ("source", "string"), ("target", "double")]
    a = spark.createDataFrame([("d1", "MKV", 0.5, 0), ("d2", "AA", 0.1, 1)], "design_name string, "
                              "full_sequence string, target double, row_id int")
    b = spark.createDataFrame([("d1", "WW", 0.7, 0)], "design_name string, full_sequence string, "
                              "target double, row_id int")
    ca = P.conform(a, schema, "af2", "design_name", ["row_id"], seq_col="full_sequence")
    cb = P.conform(b, schema, "pdb", "design_name", ["row_id"], seq_col="full_sequence")
    u = P.union_sources(ca, cb)
    assert sorted((r["design_name"], r["source"]) for r in u.collect()) == \
        [("d1", "af2"), ("d1", "pdb"), ("d2", "af2")]
