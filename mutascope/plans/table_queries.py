"""Registered queries for table preparation, summaries and the stratified split."""

from __future__ import annotations

from pyspark.sql import functions as F

from mutascope.functions import messages as MSG
from mutascope.functions.residues import MAX_RESIDUES
from mutascope.operators import prep as P
from mutascope.operators import split as SP
from mutascope.operators.validate import overlength
from mutascope.plans.views import proteins, table, with_views

CONFORMED = [("design_name", "string"), ("full_sequence", "string"), ("seq_length", "int"),
             ("source", "string"), ("target", "double"), ("num_residues", "double"),
             ("energy_total", "double")]


def _clean(c):
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


# ---------------------------------------------------------------------------
# conform_union: S3-S5, D1-D6, U1
# Two descriptor "files": documents (all columns) and benchmark (lacking some).
# The design name is a content hash, so exact copies collide and keep-first
# (by row id) removes them within each file, not across files.
# ---------------------------------------------------------------------------

def _energy():
    """A text column in which a quarter of the values are numbers."""
    return F.when(F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") * 2).cast("string"), F.lit(".5"))).otherwise(F.col("lang"))


def q_conform_union(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.substring(F.md5("text"), 1, 16).alias("design_name"),
        F.when(F.col("doc_id") % 13 != 0, F.nullif(_clean(F.col("text")), F.lit(""))).alias("full_sequence"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).cast("double").alias("target"),
        F.length(_clean(F.col("text"))).cast("double").alias("num_residues"),
        _energy().alias("energy_total"),          # text column: non-strict cast
        F.col("doc_id").alias("row_id"), "lang")
    bench = table(spark, sf, "benchmark").select(
        F.substring(F.md5("text"), 1, 16).alias("design_name"),
        F.nullif(_clean(F.col("text")), F.lit("")).alias("full_sequence"),
        F.length("text").cast("double").alias("target"),
        F.col("item_id").alias("row_id"))
    a = P.conform(docs, CONFORMED, "docs", "design_name", ["row_id"],
                  numeric_text_cols=["energy_total"], required=["target", "full_sequence"],
                  seq_col="full_sequence")
    b = P.conform(bench, CONFORMED, "bench", "design_name", ["row_id"],
                  numeric_text_cols=["energy_total"], required=["target", "full_sequence"],
                  seq_col="full_sequence")
    return P.union_sources(a, b).withColumn("seq_length", F.col("seq_length").cast("long"))


SQL_CONFORM_UNION = """
WITH a0 AS (
  SELECT substr(md5(text), 1, 16) AS design_name,
         CASE WHEN doc_id % 13 <> 0 THEN nullif(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '') END AS full_sequence,
         CASE WHEN doc_id % 11 <> 0 THEN CAST(n_chars AS DOUBLE) END AS target,
         CAST(length(upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS DOUBLE) AS num_residues,
         TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id * 2 AS VARCHAR) || '.5' ELSE lang END AS DOUBLE) AS energy_total, doc_id AS row_id
  FROM documents),
a AS (
  SELECT design_name, full_sequence, CAST(length(full_sequence) AS BIGINT) AS seq_length, 'docs' AS source,
         target, num_residues, energy_total
  FROM (SELECT *, row_number() OVER (PARTITION BY design_name ORDER BY row_id) AS rn
        FROM a0 WHERE target IS NOT NULL AND full_sequence IS NOT NULL) t WHERE rn = 1),
b0 AS (
  SELECT substr(md5(text), 1, 16) AS design_name,
         nullif(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '') AS full_sequence,
         CAST(length(text) AS DOUBLE) AS target, item_id AS row_id
  FROM benchmark),
b AS (
  SELECT design_name, full_sequence, CAST(length(full_sequence) AS BIGINT) AS seq_length, 'bench' AS source,
         target, CAST(NULL AS DOUBLE) AS num_residues, CAST(NULL AS DOUBLE) AS energy_total
  FROM (SELECT *, row_number() OVER (PARTITION BY design_name ORDER BY row_id) AS rn
        FROM b0 WHERE target IS NOT NULL AND full_sequence IS NOT NULL) t WHERE rn = 1)
SELECT * FROM a UNION ALL SELECT * FROM b"""


def q_csv_conform(spark, sf):
    """The same two descriptor files written as CSV, read back with type
    inference (the text column stays a string and goes through the
    non-strict cast), conformed and unioned: equal to ``conform_union``."""
    from mutascope.session import scratch_path
    from mutascope.sources.tables import read_descriptor_csv
    docs = table(spark, sf, "documents").select(
        F.substring(F.md5("text"), 1, 16).alias("design_name"),
        F.when(F.col("doc_id") % 13 != 0, F.nullif(_clean(F.col("text")), F.lit(""))).alias("full_sequence"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).cast("double").alias("target"),
        F.length(_clean(F.col("text"))).cast("double").alias("num_residues"),
        _energy().alias("energy_total"), F.col("doc_id").alias("row_id"))
    bench = table(spark, sf, "benchmark").select(
        F.substring(F.md5("text"), 1, 16).alias("design_name"),
        F.nullif(_clean(F.col("text")), F.lit("")).alias("full_sequence"),
        F.length("text").cast("double").alias("target"), F.col("item_id").alias("row_id"))
    base = scratch_path(spark, "descriptors")
    docs.write.option("header", True).csv(f"{base}/a")
    bench.write.option("header", True).csv(f"{base}/b")
    a = read_descriptor_csv(spark, f"{base}/a")
    b = read_descriptor_csv(spark, f"{base}/b")
    # CSV has no empty-vs-null distinction: an empty sequence reads back as NULL and its row is dropped
    ca = P.conform(a, CONFORMED, "docs", "design_name", ["row_id"], numeric_text_cols=["energy_total"],
                   required=["target", "full_sequence"], seq_col="full_sequence")
    cb = P.conform(b, CONFORMED, "bench", "design_name", ["row_id"], numeric_text_cols=["energy_total"],
                   required=["target", "full_sequence"], seq_col="full_sequence")
    return P.union_sources(ca, cb).withColumn("seq_length", F.col("seq_length").cast("long"))


# ---------------------------------------------------------------------------
# keep_first: D3 on events, first row per user by (ts, event_id)
# ---------------------------------------------------------------------------

def q_keep_first(spark, sf):
    ev = table(spark, sf, "events")
    return P.keep_first(ev, "user_id", ["ts", "event_id"])


SQL_KEEP_FIRST = """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t
WHERE rn = 1"""


# ---------------------------------------------------------------------------
# target_summary (A2, A16) on orders.o_totalprice; length_summary (A3)
# ---------------------------------------------------------------------------

def q_target_summary(spark, sf):
    o = table(spark, sf, "orders")
    d = P.describe_numeric(o, "o_totalprice", quantile="nearest")
    return P.round_cols(d, ["mean", "std", "std_pop", "min", "p25", "p50", "p75", "max"], 4)


SQL_TARGET_SUMMARY = """
WITH s AS (
  SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i,
         count(*) OVER () AS n
  FROM orders WHERE o_totalprice IS NOT NULL)
SELECT count(*) AS n, round_even(avg(v), 4) AS mean, round_even(stddev_samp(v), 4) AS std,
  round_even(stddev_pop(v), 4) AS std_pop, round_even(min(v), 4) AS min,
  round_even(max(CASE WHEN i = CAST(floor((n - 1) * CAST(0.25 AS DOUBLE) + 0.5) AS BIGINT) THEN v END), 4) AS p25,
  round_even(max(CASE WHEN i = CAST(floor((n - 1) * CAST(0.5 AS DOUBLE) + 0.5) AS BIGINT) THEN v END), 4) AS p50,
  round_even(max(CASE WHEN i = CAST(floor((n - 1) * CAST(0.75 AS DOUBLE) + 0.5) AS BIGINT) THEN v END), 4) AS p75,
  round_even(max(v), 4) AS max
FROM s"""


def q_length_summary(spark, sf):
    p = proteins(spark, sf).withColumn("seq_length", F.length("full_sequence"))
    s = P.length_summary(p, "seq_length")
    return s.select(F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"),
                    F.bround("mean", 6).alias("mean"), F.col("median").cast("double").alias("median"))


SQL_LENGTH_SUMMARY = with_views("""
SELECT CAST(min(l) AS BIGINT) AS min, CAST(max(l) AS BIGINT) AS max, round_even(avg(l), 6) AS mean,
       CAST(median(l) AS DOUBLE) AS median
FROM (SELECT length(full_sequence) AS l FROM proteins) t""")


# ---------------------------------------------------------------------------
# null_report (D7): documents left-joined to their labels
# ---------------------------------------------------------------------------

def q_null_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    r = P.null_report(joined, ["n_chars", "quality", "toxic"])
    return r.withColumn("pct_null", F.bround("pct_null", 6))


SQL_NULL_REPORT = """
WITH j AS (SELECT d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) AS total,
        sum(CASE WHEN n_chars IS NULL THEN 1 ELSE 0 END) AS n1,
        sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS n2,
        sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END) AS n3 FROM j)
SELECT * FROM (
  SELECT 'n_chars' AS "column", CAST(n1 AS BIGINT) AS n_null, round_even(n1 * 100.0 / total, 6) AS pct_null FROM c
  UNION ALL SELECT 'quality', CAST(n2 AS BIGINT), round_even(n2 * 100.0 / total, 6) FROM c
  UNION ALL SELECT 'toxic', CAST(n3 AS BIGINT), round_even(n3 * 100.0 / total, 6) FROM c) t
WHERE n_null > 0"""


# ---------------------------------------------------------------------------
# source_counts (A1)
# ---------------------------------------------------------------------------

def q_source_counts(spark, sf):
    return P.count_by(proteins(spark, sf), "source")


SQL_SOURCE_COUNTS = with_views("SELECT source, count(*) AS n FROM proteins GROUP BY source")


# ---------------------------------------------------------------------------
# Stratified split (T1-T3, U2), split summary (A4), split x source (A5) on orders
# ---------------------------------------------------------------------------

STATUS_LEVELS = ["F", "O", "P"]


def _orders_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return SP.stratified_split(o, "o_totalprice", "o_orderkey", (0.8, 0.1), seed=42)


def q_strat_split(spark, sf):
    """Split written as one Parquet folder per split, read back."""
    from mutascope.session import scratch_path
    path = scratch_path(spark, "splits")
    SP.write_splits(_orders_split(spark, sf).select("o_orderkey", "stratum", "split"), path)
    return spark.read.parquet(path).select("o_orderkey", F.col("stratum").cast("long").alias("stratum"),
                                           "split")


def q_split_summary(spark, sf):
    s = SP.split_summary(_orders_split(spark, sf), "o_totalprice")
    return P.round_cols(s, ["pct", "mean", "std"], 4)


def q_split_source(spark, sf):
    return SP.split_by_source(_orders_split(spark, sf), STATUS_LEVELS, source_col="o_orderstatus")


_SPLIT_CTE = {
    "o": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "q": """SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
                   quantile_cont(o_totalprice, 0.75) AS q3 FROM o""",
    "s": """SELECT o.*, CASE WHEN o_totalprice < q1 THEN 0 WHEN o_totalprice < q2 THEN 1
                             WHEN o_totalprice < q3 THEN 2 ELSE 3 END AS stratum,
                   md5('42|' || CAST(o_orderkey AS VARCHAR)) AS h
            FROM o, q""",
    "r": """SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, o_orderkey) AS ord,
                   count(*) OVER (PARTITION BY stratum) AS n FROM s""",
    "sp": """SELECT o_orderkey, o_totalprice, o_orderstatus, CAST(stratum AS BIGINT) AS stratum,
                    CASE WHEN ord <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                         WHEN ord <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val'
                         ELSE 'test' END AS split
             FROM r""",
}

SQL_STRAT_SPLIT = with_views("SELECT o_orderkey, stratum, split FROM sp", **_SPLIT_CTE)

SQL_SPLIT_SUMMARY = with_views("""
SELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split,
       count(*) AS rows,
       round_even(count(*) * 100.0 / (SELECT count(*) FROM sp), 4) AS pct,
       round_even(avg(o_totalprice), 4) AS mean, round_even(stddev_samp(o_totalprice), 4) AS std
FROM sp GROUP BY ROLLUP (split)""", **_SPLIT_CTE)

SQL_SPLIT_SOURCE = with_views("""
SELECT split,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
  count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM sp GROUP BY split""", **_SPLIT_CTE)


# ---------------------------------------------------------------------------
# Over-length policies (D8 skip, D9 truncate, V3 reject) and the skip report
# ---------------------------------------------------------------------------

def q_overlength_policies(spark, sf):
    """The three policies side by side: one projection per policy over one scan."""
    p = proteins(spark, sf).select("design_name", "full_sequence")
    rejected = overlength(p.withColumn("cut", F.col("full_sequence")), "full_sequence", "reject")
    cut = overlength(rejected, "cut", "truncate")
    return cut.select("design_name", F.length("full_sequence").cast("long").alias("length"),
                      F.length("cut").cast("long").alias("truncated_length"),
                      F.col("error").isNull().alias("kept"), "error")


SQL_OVERLENGTH = with_views(f"""
SELECT design_name, CAST(length(full_sequence) AS BIGINT) AS length,
  CAST(length(substr(full_sequence, 1, {MAX_RESIDUES})) AS BIGINT) AS truncated_length,
  length(full_sequence) <= {MAX_RESIDUES} AS kept,
  CASE WHEN length(full_sequence) > {MAX_RESIDUES} THEN CAST(length(full_sequence) AS VARCHAR) || '{MSG.LONG.format(MAX_RESIDUES)}' END AS error
FROM proteins""")


def q_overlength_report(spark, sf):
    p = proteins(spark, sf)
    n = F.length("full_sequence")
    return p.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(n <= MAX_RESIDUES).alias("kept"),
                 F.count_if(n > MAX_RESIDUES).alias("skipped")) \
            .withColumn("pct_skipped", F.bround(F.col("skipped") * 100.0 / F.col("total"), 6))


SQL_OVERLENGTH_REPORT = with_views(f"""
SELECT count(*) AS total,
  count(*) FILTER (WHERE length(full_sequence) <= {MAX_RESIDUES}) AS kept,
  count(*) FILTER (WHERE length(full_sequence) > {MAX_RESIDUES}) AS skipped,
  round_even(count(*) FILTER (WHERE length(full_sequence) > {MAX_RESIDUES}) * 100.0 / count(*), 6) AS pct_skipped
FROM proteins""")


QUERIES = {
    "conform_union": q_conform_union,
    "csv_conform": q_csv_conform,
    "keep_first": q_keep_first,
    "target_summary": q_target_summary,
    "length_summary": q_length_summary,
    "null_report": q_null_report,
    "source_counts": q_source_counts,
    "strat_split": q_strat_split,
    "split_summary": q_split_summary,
    "split_source": q_split_source,
    "overlength_policies": q_overlength_policies,
    "overlength_report": q_overlength_report,
}

ORACLES = {
    "conform_union": SQL_CONFORM_UNION,
    "csv_conform": SQL_CONFORM_UNION,
    "keep_first": SQL_KEEP_FIRST,
    "target_summary": SQL_TARGET_SUMMARY,
    "length_summary": SQL_LENGTH_SUMMARY,
    "null_report": SQL_NULL_REPORT,
    "source_counts": SQL_SOURCE_COUNTS,
    "strat_split": SQL_STRAT_SPLIT,
    "split_summary": SQL_SPLIT_SUMMARY,
    "split_source": SQL_SPLIT_SOURCE,
    "overlength_policies": SQL_OVERLENGTH,
    "overlength_report": SQL_OVERLENGTH_REPORT,
}

