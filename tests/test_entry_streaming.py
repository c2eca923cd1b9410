import os

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from mutascope.sources import requests as RQ
from mutascope.streaming.requests import read_results, scan_request_stream


def test_entry_and_registry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    qs, sql = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_request_stream_restart_no_duplicates(spark, tmp_dir):
    rows = [("j1", "MKVLAG", 3, None), ("j2", "MKB", None, None), ("j3", "MKVL", 501, [1]),
            ("j4", "MKVL", 2, [2, 9]), ("j5", "MKVL", None, [])]
    req = spark.createDataFrame(rows, "job_id string, sequence string, top_n int, positions array<int>") \
        .withColumn("submitted_at", F.current_timestamp())
    req.write.json(os.path.join(tmp_dir, "in"))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    for _ in range(2):
        scan_request_stream(spark, os.path.join(tmp_dir, "in"), out, ck).awaitTermination()
    res = {r["job_id"]: r for r in read_results(spark, out).collect()}
    assert len(res) == 5 and read_results(spark, out).count() == 5
    assert res["j1"]["status"] == "done" and len(res["j1"]["result"]["top_mutations"]) == 3
    assert res["j1"]["result"]["num_mutations_scanned"] == 6 * 19
    assert res["j2"]["status"] == "failed" and "unknown letters" in res["j2"]["error"]
    assert "top_n" in res["j3"]["error"]
    assert "beyond the last" in res["j4"]["error"]
    assert res["j5"]["status"] == "done" and res["j5"]["result"]["num_mutations_scanned"] == 0
    batch = RQ.answer_scan_requests(RQ.plan_scan_requests(spark.read.schema(RQ.SCAN_REQUEST_SCHEMA)
                                                          .json(os.path.join(tmp_dir, "in"))))
    assert sorted(r["job_id"] for r in batch.where("status = 'done'").collect()) == ["j1", "j5"]


def test_score_requests_batches(spark):
    items = [{"id": f"s{i}", "sequence": "MKV"} for i in range(65)]
    rows = [("ok", items[:2]), ("big", items), ("bad", [{"id": "x", "sequence": "MKB"}]), ("empty", [])]
    df = spark.createDataFrame(rows, RQ.SCORE_REQUEST_SCHEMA)
    out = RQ.answer_score_requests(df, max_batch=64)
    got = {(r["batch_id"], r["protein_id"]): r for r in out.collect()}
    assert got[("ok", "s0")]["predicted"] is not None and got[("ok", "s1")]["sequence_length"] == 3
    assert "at most 64 fit" in got[("big", None)]["batch_error"]
    assert "unknown letters" in got[("bad", None)]["batch_error"]
    assert "empty" in got[("empty", None)]["batch_error"]


def test_scan_fasta_writes_one_folder_per_protein(spark, tmp_dir):
    from mutascope.operators.jobs import scan_fasta
    path = os.path.join(tmp_dir, "in.fasta")
    with open(path, "w") as fh:
        fh.write(">sp|P1|x desc\nmkv\nla\n>p/2\nACW\n>long\n" + "A" * 600 + "\n")
    out = os.path.join(tmp_dir, "out")
    res = scan_fasta(spark, path, out, positions_spec="1-3", confirm_long=False)
    back = spark.read.option("header", True).csv(out)
    assert {r["safe_id"] for r in back.select("safe_id").distinct().collect()} == {"p_2", "sp_P1_x"}
    assert all(r["n"] == 1 for r in back.groupBy("protein_id").agg(F.countDistinct("bucket").alias("n")).collect())
    assert back.count() == 2 * 3 * 19
    assert [r["protein_id"] for r in res["skipped"].collect()] == ["long"]
    assert res["top"].where("protein_id = 'p/2'").count() == 20


def test_score_request_stream(spark, tmp_dir):
    from mutascope.streaming.requests import score_request_stream
    rows = [("b1", [{"id": "a", "sequence": "MKV"}, {"id": "b", "sequence": " wwa "}]),
            ("b2", [{"id": "c", "sequence": "MKB"}])]
    spark.createDataFrame(rows, RQ.SCORE_REQUEST_SCHEMA).write.json(os.path.join(tmp_dir, "in"))
    out = os.path.join(tmp_dir, "out")
    score_request_stream(spark, os.path.join(tmp_dir, "in"), out, os.path.join(tmp_dir, "ck")).awaitTermination()
    got = {(r["batch_id"], r["protein_id"]): r for r in read_results(spark, out).collect()}
    assert got[("b1", "b")]["sequence_length"] == 3 and got[("b1", "a")]["predicted"] is not None
    assert "unknown letters" in got[("b2", None)]["batch_error"]


def test_public_api_smoke(spark, tmp_dir):
    from mutascope.functions.residues import FEATURE_NAMES, feature_vector, sequence_features
    from mutascope.operators import scan as S
    from mutascope.operators.models import fit_gbt, score_model
    from mutascope.sources.sinks import write_json, write_parquet
    from mutascope.sources.tables import read_store

    df = spark.createDataFrame([("a", "MKVLAG", "train"), ("b", "WWAC", "val")], "id string, seq string, split string")
    fv = feature_vector(sequence_features(df, "seq")).first()["features"]
    assert len(fv) == len(FEATURE_NAMES)
    write_parquet(df, f"{tmp_dir}/pq", partition_by=["split"])
    assert sorted(r["id"] for r in read_store(spark, f"{tmp_dir}/pq", ["id"]).collect()) == ["a", "b"]
    docs = S.scan_documents(S.scan_positions(df, "id", "seq"), top_n=3)
    write_json(docs, f"{tmp_dir}/docs")
    back = spark.read.json(f"{tmp_dir}/docs").collect()
    assert len(back) == 2 and all(len(r["result"]["top_mutations"]) == 3 for r in back)
    assert all(len(r["result"]["position_summary"]) in (6, 4) for r in back)
    req = spark.createDataFrame([("j1", "MKV", 3, None)], "job_id string, sequence string, top_n int, positions array<int>")
    req.write.json(f"{tmp_dir}/req")
    assert RQ.read_scan_requests(spark, f"{tmp_dir}/req").first()["job_id"] == "j1"
    tr = spark.createDataFrame([([float(i), float(i % 3)], float(i % 2), i) for i in range(40)], "x array<double>, y double, id long")
    model, _, _ = fit_gbt(tr, "x", "y", "id", maxIter=3, maxDepth=2)
    assert score_model(model, tr, "x").where("prediction IS NULL").count() == 0


def test_equal_ids_of_two_sources_stay_apart(spark):
    """Two records named p1: with a record key each keeps its own rankings and summaries."""
    from mutascope.operators import scan as S
    df = spark.createDataFrame([("a", "p1", "MKVLAGWW"), ("b", "p1", "ACDEFGHIKL"), ("b", "p2", "MMM")], "source string, id string, seq string")
    keyed = df.select(S.record_id("id", "source").alias("id"), "seq")
    top = S.top_mutations_additive(keyed, "id", "seq", n=20)
    assert top.groupBy("protein_id").count().where("count <> 20").count() == 0 and top.select("protein_id").distinct().count() == 3
    assert S.residue_summary_additive(keyed, "id", "seq").count() == 20 + 20 + 19
    generic = S.scan(keyed, "id", "seq", scorer=S.head_scorer())
    assert generic.count() == S.scan(keyed, "id", "seq").count() == 19 * (8 + 10 + 3)


def test_equal_job_ids_are_rejected_not_mixed(spark):
    rows = [("j1", 1, "MKVL", 3, None), ("j1", 2, "ACDE", 3, None), ("j2", 1, "WWWW", 2, [1, 2])]
    req = spark.createDataFrame(rows, "job_id string, t long, sequence string, top_n int, positions array<int>") \
        .withColumn("submitted_at", F.timestamp_seconds("t")).drop("t")
    out = RQ.answer_scan_requests(RQ.plan_scan_requests(req)).collect()
    assert sorted((r["job_id"], r["status"]) for r in out) == [("j1", "done"), ("j1", "failed"), ("j2", "done")]
    done = next(r for r in out if r["job_id"] == "j1" and r["status"] == "done")
    assert len(done["result"]["position_summary"]) == 4 and len(done["result"]["top_mutations"]) == 3


def test_new_checkpoint_keeps_results_and_answers_no_job_twice(spark, tmp_dir):
    from mutascope.streaming.requests import scan_request_stream
    out = os.path.join(tmp_dir, "out")

    def put(job, seq):
        spark.createDataFrame([(job, seq, 2)], "job_id string, sequence string, top_n int").write.mode("append").json(os.path.join(tmp_dir, "in"))

    put("j1", "MKV")
    scan_request_stream(spark, os.path.join(tmp_dir, "in"), out, os.path.join(tmp_dir, "ck1")).awaitTermination()
    put("j2", "ACD")
    scan_request_stream(spark, os.path.join(tmp_dir, "in"), out, os.path.join(tmp_dir, "ck2")).awaitTermination()
    put("j2", "WWW")
    scan_request_stream(spark, os.path.join(tmp_dir, "in"), out, os.path.join(tmp_dir, "ck2")).awaitTermination()
    assert sorted(r["job_id"] for r in read_results(spark, out).collect()) == ["j1", "j2"]


def test_batch_guard_is_a_parameter(spark):
    rows = [("b", [{"id": f"s{i}", "sequence": "MKV"} for i in range(65)])]
    req = spark.createDataFrame(rows, RQ.SCORE_REQUEST_SCHEMA)
    assert RQ.answer_score_requests(req).count() == 65
    assert "at most 64 fit" in RQ.answer_score_requests(req, max_batch=64).first()["batch_error"]
