"""Keyed state of request streams: which jobs are known, and a bounded log of their status.

``marked_requests`` and ``new_requests`` let the requests of a job through when the job is new to the stream. The state is the job
ids in the state store, so an epoch's cost follows its own requests, not the results stored so far; no Python runs for a job.
Jobs known at the start come as a stream of their own. ``first_requests`` does the same within a streaming
frame and can forget jobs, at a call of Python for each.

``job_log`` keeps the latest jobs of each shard by submit time, from request and result events. Events may come in
any order and again: an entry takes the furthest status seen, and which jobs stay depends on their submit times alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mutascope.sources.requests import RETAIN_JOBS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FLAG = T.StructType([T.StructField("known", T.BooleanType())])
_JOB = T.StructType([T.StructField("job_id", T.StringType())])
_ENTRY = T.StructType([T.StructField("status", T.StringType()), T.StructField("submitted_at", T.TimestampType()),
                       T.StructField("finished_at", T.TimestampType()), T.StructField("error", T.StringType())])
EVENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("job_id", T.StringType()), *_ENTRY.fields])
BODY = "request_body_json"  # columns with a leading underscore lose their name on the way to the workers
MARK = "request_mark"  # of a streamed row: a request, the first sight of its key, or a key known at the start
REQUEST, FIRST, KNOWN = 0, 1, 2
#: a job's status never goes back; ``evicted`` ends the log's knowledge of it
STAGES = ("queued", "running", "done", "failed", "evicted")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store; another provider the session names is left alone."""
    if spark.conf.get(_STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKSDB)


class FirstRequests(StatefulProcessor):
    """Passes all rows of a key on when it is first seen, none later."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _FLAG, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.exists()
        for part in rows:
            if not known:
                yield part
        if not known:
            self.known.update((True,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.known.update((True,))

    def close(self) -> None:
        pass


def first_requests(stream: DataFrame, key: str, answered: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The stream's requests whose ``key`` no earlier epoch has had (nor ``answered``, distinct keys known at the first start).

    Request bodies cross to the workers as JSON; timestamps keep their own columns. ``ttl_ms`` forgets a
    key that long after it was seen; by default it is kept.
    """
    use_rocksdb(stream.sparkSession)
    times = [f.name for f in stream.schema if isinstance(f.dataType, T.TimestampType)]
    body = T.StructType([f for f in stream.schema if f.name != key and f.name not in times])
    narrow = stream.select(key, *times, F.to_json(F.struct(*[F.col(f.name) for f in body])).alias(BODY))
    fresh = narrow.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FirstRequests(ttl_ms), outputStructType=narrow.schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None", initialState=None if answered is None else answered.select(key).groupBy(key))
    parsed = fresh.withColumn(BODY, F.from_json(BODY, body))
    return parsed.select(*[F.col(f.name) if f.name == key or f.name in times else F.col(BODY)[f.name].alias(f.name) for f in stream.schema])


def marked_requests(stream: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """All requests of the stream, marked ``REQUEST``, and beside them each ``key`` when it is first seen, marked ``FIRST``.

    ``known``: a stream of the keys known at the first start, which must come with the first epoch; they are marked ``KNOWN``.
    Only keys are deduplicated, so request bodies do not pass the state."""
    use_rocksdb(stream.sparkSession)
    keys = stream.select(key) if known is None else stream.select(key).union(known.select(key))
    out = stream.withColumn(MARK, F.lit(REQUEST)).unionByName(
        keys.dropDuplicates([key]).withColumn(MARK, F.lit(FIRST)), allowMissingColumns=True)
    return out if known is None else out.unionByName(known.select(key, F.lit(KNOWN).alias(MARK)), allowMissingColumns=True)


def new_requests(batch: DataFrame, key: str) -> DataFrame:
    """Of one epoch's ``marked_requests``: all requests of the keys that no earlier epoch has had. Reads ``batch`` once."""
    own = Window.partitionBy(key)
    seen = batch.withColumn("_first", F.max(F.col(MARK) == FIRST).over(own)).withColumn("_known", F.max(F.col(MARK) == KNOWN).over(own))
    return seen.where((F.col(MARK) == REQUEST) & F.col("_first") & ~F.col("_known")).drop(MARK, "_first", "_known")


class JobLog(StatefulProcessor):
    """The ``keep`` latest jobs of a shard by (submit time, id); emits every change of status, and evictions."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", _JOB, _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = {k[0]: tuple(v) for k, v in self.jobs.iterator()}  # at most ``keep`` entries
        for part in rows:
            before = dict(log)
            for e in part.itertuples(index=False):
                old = log.get(e.job_id)
                if old is None or STAGES.index(e.status) > STAGES.index(old[0]):
                    log[e.job_id] = (e.status, _moment(e.submitted_at), _moment(e.finished_at), e.error)
            for job in sorted(log, key=lambda j: (log[j][1] is not None, log[j][1], j))[:max(len(log) - self.keep, 0)]:
                entry = log.pop(job)
                if job in before:
                    self.jobs.removeKey((job,))
                    yield self._rows(key, [(job, "evicted", *entry[1:])])
            changed = [(job, *entry) for job, entry in log.items() if before.get(job) != entry]
            for job, *entry in changed:
                self.jobs.updateValue((job,), tuple(entry))
            if changed:
                yield self._rows(key, changed)

    @staticmethod
    def _rows(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=EVENT.names)
        for c in ("submitted_at", "finished_at"):
            out[c] = pd.to_datetime(out[c])
        return out

    def close(self) -> None:
        pass


def _moment(t):
    return None if t is None or pd.isna(t) else pd.Timestamp(t).to_pydatetime()


def job_events(requests: DataFrame, results: DataFrame, shards: int = 1) -> DataFrame:
    """Request rows (job_id, submitted_at) as ``running``, result rows (also status, finished_at, error) as what they say."""
    shard = F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int").alias("shard")
    none = F.lit(None)
    asked = requests.select(shard, "job_id", F.lit("running").alias("status"), "submitted_at", none.cast("timestamp").alias("finished_at"),
                            none.cast("string").alias("error"))
    return asked.unionByName(results.select(shard, "job_id", "status", "submitted_at", "finished_at", "error"))


def job_log(events: DataFrame, keep: int = RETAIN_JOBS) -> DataFrame:
    """Status changes of a stream of ``job_events``; each shard remembers its ``keep`` latest jobs."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=JobLog(keep), outputStructType=EVENT, outputMode="Append", timeMode="None")


def job_log_stream(spark: SparkSession, in_dir: str, results_dir: str, log_dir: str, checkpoint: str, keep: int = RETAIN_JOBS,
                   shards: int = 1, available_now: bool = True):
    """Follow request files and stored results; append status changes to ``log_dir`` (one folder per epoch, so that a
    replayed epoch rewrites its own)."""
    from mutascope.sources.requests import SCAN_REQUEST_SCHEMA
    requests = spark.readStream.schema(SCAN_REQUEST_SCHEMA).json(in_dir)
    results = spark.readStream.schema("job_id string, status string, submitted_at timestamp, finished_at timestamp, error string").parquet(results_dir)

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_dir.rstrip('/')}/epoch={epoch}")

    w = job_log(job_events(requests, results, shards), keep).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_jobs(spark: SparkSession, log_dir: str) -> DataFrame:
    """The jobs now in the log, with their latest status."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("status"))
    latest = spark.read.schema(EVENT).parquet(log_dir).groupBy("job_id").agg(
        F.max(F.struct(rank.alias("r"), "status", "submitted_at", "finished_at", "error")).alias("x"))
    return latest.select("job_id", "x.status", "x.submitted_at", "x.finished_at", "x.error").where("status <> 'evicted'")
