"""Views of the driver tables used by the registered queries (Spark + SQL twins).

There is no protein data on disk, so ``proteins`` maps each document to a
deterministic residue string: its letters, upper-cased (non-standard letters
such as B, J, O, U, X, Z stay, exercising the non-standard paths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("design_name"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("full_sequence"),
        "source", "doc_id")


PROTEINS_SQL = (
    "SELECT 'd' || CAST(doc_id AS VARCHAR) AS design_name, "
    "upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS full_sequence, source, doc_id "
    "FROM documents")


def with_views(sql: str, **views: str) -> str:
    """Prefix ``sql`` with CTEs; ``proteins`` is always available."""
    ctes = {"proteins": PROTEINS_SQL}
    ctes.update(views)
    body = ",\n".join(f"{name} AS ({q})" for name, q in ctes.items())
    return f"WITH {body}\n{sql}"
