"""Request streams: scan and score requests arriving as JSON files.

Each micro-batch is validated and answered as a table (see
``mutascope.sources.requests``). Keyed state remembers the jobs seen, so none is
answered twice and an epoch never reads the results stored before it; a new
checkpoint starts from the jobs that have a stored result, which are listed once
in its folder ``known``. Results are written
to ``out_dir/run=<name of the checkpoint>/epoch=<id>`` with overwrite: a replayed
epoch rewrites its own folder, and a stream with a new checkpoint on the same
``out_dir`` leaves finished results alone. Polling a job = reading that table, or
the bounded log of ``mutascope.streaming.jobs``.
The checkpoint location makes restarts resume where they stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascope.functions.heads import CompositionHead
from mutascope.sources.requests import (
    SCAN_REQUEST_SCHEMA, SCORE_REQUEST_SCHEMA, answer_scan_requests, answer_score_requests,
    plan_scan_requests,
)
from mutascope.session import materialize
from mutascope.streaming.jobs import marked_requests, new_requests


def _answered(spark: SparkSession, out_dir: str, key: str) -> DataFrame | None:
    """Keys with a stored result; None if there are no results yet."""
    try:
        return spark.read.parquet(out_dir).select(key).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _known(spark: SparkSession, out_dir: str, key: str, checkpoint: str) -> DataFrame | None:
    """Stream of the keys that had a stored result when the checkpoint was new; None if there were none."""
    path = f"{checkpoint.rstrip('/')}/known"
    if not _exists(spark, f"{checkpoint.rstrip('/')}/offsets"):  # no query has started with it yet
        answered = _answered(spark, out_dir, key)
        if answered is not None:
            answered.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(f"`{key}` string").parquet(path) if _exists(spark, path) else None


def _run(stream: DataFrame, handle, key: str, out_dir: str, checkpoint: str, available_now: bool):
    """``handle``: the answers to one epoch's new requests; it must read them once."""
    run = "r" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    marked = marked_requests(stream, key, _known(stream.sparkSession, out_dir, key, checkpoint))

    def process(batch: DataFrame, epoch_id: int) -> None:
        out = handle(new_requests(batch, key)).withColumn("finished_at", F.current_timestamp())
        out.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/run={run}/epoch={epoch_id}")

    w = marked.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def scan_request_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                        head: CompositionHead | None = None, available_now: bool = True,
                        max_files_per_trigger: int | None = None):
    """Start the scan-request stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(SCAN_REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(in_dir)
    return _run(stream, lambda b: answer_scan_requests(plan_scan_requests(b), head),
                "job_id", out_dir, checkpoint, available_now)


def score_request_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                         head: CompositionHead | None = None, available_now: bool = True,
                         max_batch: int | None = None):
    stream = spark.readStream.schema(SCORE_REQUEST_SCHEMA).json(in_dir)
    # these answers read their requests several times: they are written once per epoch
    return _run(stream, lambda b: answer_score_requests(materialize(b), head, max_batch), "batch_id", out_dir, checkpoint, available_now)


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result table written by a request stream."""
    return spark.read.parquet(out_dir)
