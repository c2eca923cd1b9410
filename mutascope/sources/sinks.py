"""Writers: Parquet (whole, per split, append), CSV reports, per-protein outputs, JSON."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTATION_FIELDS = ["position", "wildtype_aa", "mutant_aa",
                   "predicted_wildtype", "predicted_mutant", "delta"]


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                  mode: str = "overwrite") -> None:
    """Snappy Parquet; ``partition_by`` gives one folder per value (e.g. split)."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, id_col: str = "id", buckets: int = 64) -> None:
    """A store as a bucketed table, sorted by id in each bucket, one file a bucket.

    Joins on the id, and aggregations by it, read the buckets as they are: the vectors are never shuffled, only the other side is
    (as long as ``buckets`` times the file size suits the cluster; choose it for files of some hundred MB)."""
    (df.repartition(buckets, id_col).write.mode("overwrite").option("path", path)
       .bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table))


def format_fixed(col: str, digits: int = 6) -> F.Column:
    """Fixed-point text with ``digits`` decimals (rounded half-even first)."""
    return F.format_string(f"%.{digits}f", F.bround(F.col(col).cast("double"), digits))


def write_predictions_csv(df: DataFrame, path: str, id_col: str = "protein_id",
                          value_col: str = "predicted", length_col: str = "sequence_length") -> None:
    """Prediction report: id, value as ``%.6f`` text, sequence length; with header."""
    (df.select(F.col(id_col).alias("protein_id"),
               format_fixed(value_col).alias("predicted_a3d_avg"),
               F.col(length_col).alias("sequence_length"))
       .write.mode("overwrite").option("header", True).csv(path))


def safe_id(col: str) -> F.Column:
    """File-name-safe id: letters, digits, ``-``, ``_``, ``.`` kept, others -> ``_``."""
    return F.regexp_replace(F.col(col), r"[^\p{L}\p{N}_.-]", "_")


def write_mutations(df: DataFrame, path: str, id_col: str = "protein_id", buckets: int = 64,
                    task_rows: int = 1_000_000, piece: int = 4096) -> None:
    """Mutation tables in ``buckets`` folders (``bucket=...``), fixed field order, rows in position order in each file.

    A first count gives every bucket as many tasks as its rows need at ``task_rows`` each, and rows are dealt to them by
    protein and run of ``piece`` positions: a small bucket is one file, one very long protein is several. A reader prunes to
    the bucket of an id with ``mutation_bucket``. At most ``buckets`` rows reach the driver.
    """
    rows = df.select(mutation_bucket(id_col, buckets).alias("bucket"), safe_id(id_col).alias("safe_id"),
                     F.col(id_col).alias("protein_id"), *MUTATION_FIELDS)
    counts = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = [-(-counts.get(b, 0) // task_rows) for b in range(buckets)]
    first = [sum(tasks[:b]) for b in range(buckets)]
    at = F.col("bucket") + 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    task = of(first) + F.pmod(F.xxhash64("protein_id", F.floor(F.col("position") / piece)), F.greatest(of(tasks), F.lit(1))).cast("int")
    (rows.repartitionById(max(sum(tasks), 1), task).sortWithinPartitions("bucket", "protein_id", "position", "mutant_aa")
         .write.mode("overwrite").option("header", True).partitionBy("bucket").csv(path))


def mutation_bucket(id_col: str, buckets: int = 64) -> F.Column:
    """Folder number of a protein id."""
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def write_metrics_csv(df: DataFrame, path: str) -> None:
    # a handful of rows, moved to one file after the upstream work has run in parallel
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested documents as JSON lines."""
    df.write.mode("overwrite").json(path)
