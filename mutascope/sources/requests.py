"""Request records (JSON lines): schemas, readers and batch request handling.

A scan request carries ``job_id, submitted_at, sequence, top_n, positions``;
a score request ``batch_id, sequences: [{id, sequence}]``. Both are processed
as whole tables: every request is validated row by row and answered with a
result row (``done`` + result, or ``failed`` + error).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascope.functions import messages as MSG
from mutascope.functions.heads import CompositionHead, default_head
from mutascope.functions.residues import MAX_RESIDUES
from mutascope.operators import scan as S
from mutascope.operators.validate import validate_scan_requests, validate_sequences

SCAN_REQUEST_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
    T.StructField("sequence", T.StringType()),
    T.StructField("top_n", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
])

SCORE_REQUEST_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("sequences", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("sequence", T.StringType())]))),
])

MUTATE_BATCH = 8
SEC_PER_BATCH = 15.0
RETAIN_JOBS = 256


def read_scan_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN_REQUEST_SCHEMA).json(path)


def read_score_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_REQUEST_SCHEMA).json(path)


def plan_scan_requests(req: DataFrame) -> DataFrame:
    """Validate scan requests; add the mutant count and run-time estimate.

    Output: job_id, submitted_at, sequence, length, top_n, positions (NULL =
    every position), num_mutations (positions x 19), estimated_seconds, error.
    Of several requests with one job id the first submitted is taken, the others
    are errors, so valid requests have a job id of their own.
    """
    v = validate_scan_requests(req)
    first = Window.partitionBy("job_id").orderBy("submitted_at", "sequence", "top_n", F.to_json("positions"))
    v = v.withColumn("_n", F.row_number().over(first)).withColumn(
        "error", F.coalesce("error", F.when(F.col("_n") > 1, F.lit("job id is already in use")))).drop("_n")
    n_pos = F.when(F.col("positions").isNull(), F.col("length")).otherwise(F.size("positions"))
    n_mut = (n_pos * F.lit(19)).cast("long")
    est = F.ceil(n_mut / F.lit(MUTATE_BATCH)).cast("double") * F.lit(SEC_PER_BATCH)
    ok = F.col("error").isNull()
    return v.select("job_id", "submitted_at", "sequence", "length", "top_n", "positions",
                    F.when(ok, n_mut).alias("num_mutations"),
                    F.when(ok, est).alias("estimated_seconds"), "error")


def answer_scan_requests(planned: DataFrame, head: CompositionHead | None = None,
                         max_top_n: int = 500) -> DataFrame:
    """Run every valid request's scan in one job; one result row per request.

    Validated sequences are at most 1022 residues, so each nested document
    (top-N list + position summary) is bounded.
    """
    head = head or default_head()
    ok = F.col("error").isNull() & F.col("job_id").isNotNull()
    # a failed request has nothing to scan; a request without positions has an empty document
    rows = planned.withColumn("_sequence", F.when(ok, F.col("sequence"))).withColumn("_positions", F.when(ok, F.col("positions")))
    docs = S.request_documents(rows, "job_id", "_sequence", "_positions", "top_n",
                               ["job_id", "submitted_at", "estimated_seconds", "length", "num_mutations", "error"],
                               head, MAX_RESIDUES, max_top_n)
    result = F.struct(
        F.col("wildtype_predicted").alias("wildtype_predicted"),
        F.col("length").alias("sequence_length"),
        F.col("num_mutations").alias("num_mutations_scanned"),
        F.col("top_mutations").alias("top_mutations"),
        F.col("position_summary").alias("position_summary"))
    return docs.select("job_id", F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("status"),
                       "submitted_at", "estimated_seconds", F.when(ok, result).alias("result"), "error")


def answer_score_requests(req: DataFrame, head: CompositionHead | None = None,
                          max_batch: int | None = None) -> DataFrame:
    """Batch scoring requests: one prediction row per item, or an error row.

    An empty batch fails, and one of more than ``max_batch`` items if that guard is
    set; a bad item fails its batch (the request is rejected).
    """
    head = head or default_head()
    n_items = F.size(F.coalesce("sequences", F.array()))
    batches = req.select("batch_id", n_items.alias("n_items"), "sequences")
    items = batches.select("batch_id", "n_items", F.posexplode_outer("sequences").alias("idx", "item")) \
        .select("batch_id", "n_items", "idx", F.col("item.id").alias("id"),
                F.col("item.sequence").alias("raw"))
    v = validate_sequences(items, "raw", MAX_RESIDUES)
    batch_err = v.groupBy("batch_id").agg(
        F.min_by(F.concat(F.lit("item "), F.col("idx").cast("string"), F.lit(": "), F.col("error")),
                 F.when(F.col("error").isNotNull(), F.col("idx"))).alias("_item_err"),
        F.first("n_items").alias("n_items"))
    err = (F.when(F.col("n_items") == 0, F.lit(MSG.NO_ITEMS))
           .when(F.col("n_items") > F.lit(max_batch).cast("int"), F.concat(
               F.col("n_items").cast("string"), F.lit(MSG.MANY_ITEMS.format(max_batch))))
           .otherwise(F.col("_item_err")))
    batch_err = batch_err.select("batch_id", err.alias("batch_error"))
    ok_items = v.join(batch_err.where(F.col("batch_error").isNull()), "batch_id", "left_semi")
    stats = S.protein_stats(ok_items, "id", "sequence", head, MAX_RESIDUES, carry=["batch_id", "idx"])
    preds = stats.select("batch_id", "idx", "protein_id",
                         F.bround(F.col("wt_score").cast("double"), 6).alias("predicted"),
                         F.col("length").cast("long").alias("sequence_length"),
                         F.lit(head.version).alias("model_version"))
    failed = batch_err.where(F.col("batch_error").isNotNull())
    return preds.unionByName(failed.select(
        "batch_id", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("protein_id"),
        F.lit(None).cast("double").alias("predicted"), F.lit(None).cast("long").alias("sequence_length"),
        F.lit(None).cast("string").alias("model_version"), "batch_error"), allowMissingColumns=True)


def retain_latest(df: DataFrame, order_col: str, n: int = RETAIN_JOBS, tie: str | None = None) -> DataFrame:
    """Keep the ``n`` most recent rows (a bounded job log); a global top-k.

    ``orderBy().limit()`` is planned as a per-partition top-k and a merge of
    at most ``n`` rows per partition.
    """
    keys = [F.col(order_col).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*keys).limit(n)
