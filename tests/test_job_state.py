import datetime as dt
import os

from pyspark.sql import functions as F

from mutascope.streaming import jobs as J
from mutascope.streaming.requests import read_results, scan_request_stream


def _put(spark, folder, rows):
    spark.createDataFrame([(j, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), s, 2) for j, t, s in rows],
                          "job_id string, submitted_at timestamp, sequence string, top_n int").coalesce(1).write.mode("append").json(folder)


def _log(spark, d, **kw):
    J.job_log_stream(spark, f"{d}/in", f"{d}/out", f"{d}/log", f"{d}/log-ck", **kw).awaitTermination()
    return {r.job_id: (r.status, r.error) for r in J.read_jobs(spark, f"{d}/log").collect()}


def test_status_follows_requests_and_results_and_oldest_leave(spark, tmp_dir):
    d = tmp_dir
    os.makedirs(f"{d}/out")
    _put(spark, f"{d}/in", [("a", 1, "MKV"), ("b", 2, "MKB"), ("c", 3, "ACD")])
    assert _log(spark, d, keep=3) == {j: ("running", None) for j in "abc"}
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    got = _log(spark, d, keep=3)
    assert got["a"] == ("done", None) and got["c"] == ("done", None) and got["b"][0] == "failed" and "unknown letters" in got["b"][1]
    _put(spark, f"{d}/in", [("old", 0, "MKV"), ("e", 5, "WWW"), ("d", 4, "MKV")])  # one is older than all that are kept
    assert sorted(_log(spark, d, keep=3)) == ["c", "d", "e"]
    before = spark.read.parquet(f"{d}/log").count()
    assert sorted(_log(spark, d, keep=3)) == ["c", "d", "e"] and spark.read.parquet(f"{d}/log").count() == before  # restart: nothing new
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    assert _log(spark, d, keep=3) == {"c": ("done", None), "d": ("done", None), "e": ("done", None)}
    assert read_results(spark, f"{d}/out").count() == 6  # the log is bounded, the answers are not


def test_events_in_any_order_and_twice_give_one_log(spark, tmp_dir):
    base = dt.datetime(2024, 1, 1)
    at = [base + dt.timedelta(seconds=(7 * k) % 50) for k in range(50)]
    rows = [(k % 2, f"j{k}", s, at[k], None, None) for k in range(50) for s in ("running", "done" if k % 3 else "failed")]
    for name, order in (("up", rows), ("down", rows[::-1] + rows)):
        for i in range(0, len(order), 20):
            spark.createDataFrame(order[i:i + 20], J.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/{name}")
        stream = spark.readStream.schema(J.EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_dir}/{name}")

        def store(batch, epoch, name=name):
            batch.write.mode("overwrite").parquet(f"{tmp_dir}/{name}-log/epoch={epoch}")

        (J.job_log(stream, keep=6).writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_dir}/{name}-ck")
         .trigger(availableNow=True).start().awaitTermination())
    want = {}
    for shard in (0, 1):
        latest = sorted((k for k in range(50) if k % 2 == shard), key=lambda k: (at[k], f"j{k}"))[-6:]
        want |= {f"j{k}": "done" if k % 3 else "failed" for k in latest}
    for name in ("up", "down"):
        assert {r.job_id: r.status for r in J.read_jobs(spark, f"{tmp_dir}/{name}-log").collect()} == want


def test_a_lost_epoch_is_replayed_without_reading_stored_results(spark, tmp_dir):
    """The last epoch's commit and results are lost: the restart answers the same jobs again, once, and old results stay unread."""
    d = tmp_dir
    _put(spark, f"{d}/in", [("a", 1, "MKV")])
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    _put(spark, f"{d}/in", [("b", 2, "ACD"), ("a", 3, "WWW")])
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    first = {r.job_id: r.result.wildtype_predicted for r in read_results(spark, f"{d}/out").collect()}
    assert sorted(first) == ["a", "b"]
    os.remove(f"{d}/ck/commits/1")
    if os.path.exists(f"{d}/ck/commits/.1.crc"):
        os.remove(f"{d}/ck/commits/.1.crc")
    q = scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck")
    q.awaitTermination()
    again = read_results(spark, f"{d}/out")
    assert again.count() == 2 and {r.job_id: r.result.wildtype_predicted for r in again.collect()} == first
    assert again.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0


def test_known_jobs_are_a_native_state_and_epochs_pass_whole_jobs(spark, tmp_dir):
    """No call of Python per job; all requests of a new id pass together, null id included, later ones and answered ones do not."""
    d = tmp_dir
    _put(spark, f"{d}/other", [("x", 1, "MKV"), ("y", 1, "MKV")])
    scan_request_stream(spark, f"{d}/other", f"{d}/out", f"{d}/ck0").awaitTermination()
    _put(spark, f"{d}/in", [("a", 1, "MKV"), ("a", 2, "ACD"), (None, 1, "MKV"), (None, 2, "MKB"), ("x", 5, "WWW")])
    q = scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck")
    q.awaitTermination()
    state = q.lastProgress["stateOperators"] if q.lastProgress["stateOperators"] else q.recentProgress[0]["stateOperators"]
    assert [s["operatorName"] for s in state] == ["dedupe"]
    assert state[0]["numRowsTotal"] == 4  # a, null, x and y

    def found():
        return sorted((str(r.job_id), r.status, r.submitted_at.second) for r in read_results(spark, f"{d}/out").collect())

    first = [("None", "failed", 2), ("a", "done", 1), ("a", "failed", 2), ("x", "done", 1), ("y", "done", 1)]
    assert [r for r in found() if r[0] != "None" or r[2] == 2] == first and len(found()) == 6
    _put(spark, f"{d}/in", [("a", 7, "MKV"), ("y", 8, "MKV"), (None, 9, "MKV"), ("b", 9, "MKV")])
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    assert sorted(set(found()) - {("None", "done", 1)}) == sorted([*first, ("b", "done", 9)]) and len(found()) == 7


def test_a_lost_first_epoch_is_answered_again(spark, tmp_dir):
    """Its own results, already stored, do not count as known before it."""
    d = tmp_dir
    _put(spark, f"{d}/in", [("a", 1, "MKV"), ("b", 2, "ACD")])
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    os.remove(f"{d}/ck/commits/0")
    if os.path.exists(f"{d}/ck/commits/.0.crc"):
        os.remove(f"{d}/ck/commits/.0.crc")
    scan_request_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ck").awaitTermination()
    assert sorted(r.job_id for r in read_results(spark, f"{d}/out").collect()) == ["a", "b"]
