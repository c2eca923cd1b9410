"""Registered queries for sources, sinks, scoring and request handling.

Round trips write derived tables to a fresh folder under the session's
shared checkpoint directory (never a machine-local temp folder) and read them
back with the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mutascope.functions import messages as MSG
from mutascope.functions.numeric import mean6_sql, to_micro_sql
from mutascope.functions.residues import ALPHABET, MAX_RESIDUES, NON_STANDARD_PATTERN
from mutascope.operators.score import score
from mutascope.plans.protein_queries import HEAD, MUTANTS_CTE
from mutascope.plans.views import PROTEINS_SQL, proteins, table, with_views
from mutascope.session import scratch_path
from mutascope.sources import requests as RQ
from mutascope.sources.fasta import read_fasta, write_fasta
from mutascope.sources.sinks import write_predictions_csv
from mutascope.sources.requests import read_scan_requests
from mutascope.streaming.jobs import job_log_stream, read_jobs
from mutascope.streaming.requests import read_results, scan_request_stream, score_request_stream

_CLEAN_SQL = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


# ---------------------------------------------------------------------------
# fasta_roundtrip (S1, S2 + FASTA writer) on benchmark passages
# ---------------------------------------------------------------------------

def q_fasta_roundtrip(spark, sf):
    bench = table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("protein_id"),
        F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence"))
    path = scratch_path(spark, "fasta")
    write_fasta(bench, path, "protein_id", "sequence", width=60)
    return read_fasta(spark, path, upper_case=True).select("protein_id", "sequence")


SQL_FASTA_ROUNDTRIP = f"SELECT 'b' || CAST(item_id AS VARCHAR) AS protein_id, {_CLEAN_SQL} AS sequence FROM benchmark"


def q_fasta_case(spark, sf):
    """Every document as a FASTA record with CRLF ends, a description and a comment line; case is kept."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))
    body = F.regexp_replace("seq", "(.{70})(?=.)", "$1\r\n")
    path = scratch_path(spark, "fasta-case")
    docs.select(F.concat(F.lit(">"), "id", F.lit(" some text\r\n; a comment\r\n"), body, F.lit("\r")).alias("value")).write.text(path)
    return read_fasta(spark, path).select("protein_id", "sequence")


SQL_FASTA_CASE = """SELECT 'd' || CAST(doc_id AS VARCHAR) AS protein_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS sequence FROM documents"""


# ---------------------------------------------------------------------------
# score_table (G1, G2, M7) and csv_roundtrip (prediction CSV writer)
# ---------------------------------------------------------------------------

def q_score_table(spark, sf):
    p = proteins(spark, sf)
    return score(p, "design_name", "full_sequence", head=HEAD, on_overlength="truncate")


SQL_SCORE_TABLE = with_views(f"""
SELECT protein_id, round_even(CAST(wt_f AS DOUBLE), 6) AS predicted,
       CAST(length(seq) AS BIGINT) AS sequence_length, '{HEAD.version}' AS model_version
FROM st2""", st=MUTANTS_CTE["st"], st2=MUTANTS_CTE["st2"])


def q_csv_roundtrip(spark, sf):
    preds = q_score_table(spark, sf)
    path = scratch_path(spark, "predictions")
    write_predictions_csv(preds, path)
    return spark.read.schema("protein_id string, predicted_a3d_avg string, sequence_length long") \
        .option("header", True).csv(path)


SQL_CSV_ROUNDTRIP = with_views("""
SELECT protein_id, printf('%.6f', round_even(CAST(wt_f AS DOUBLE), 6)) AS predicted_a3d_avg,
       CAST(length(seq) AS BIGINT) AS sequence_length
FROM st2""", st=MUTANTS_CTE["st"], st2=MUTANTS_CTE["st2"])


# ---------------------------------------------------------------------------
# Requests derived from documents (S9, V5-V8, F13, R1, R2, G12, T9): every window
# of at most 1022 residues of every document is a request. Most are cleaned of
# non-standard letters; some keep them, are empty, too long, or ask for too much.
# ---------------------------------------------------------------------------

def _windows(spark, sf):
    """(doc_id, k, i, piece): the k-th window of a document, i = doc_id + k."""
    pieces = F.regexp_extract_all("full_sequence", F.lit(f"(?s).{{1,{MAX_RESIDUES}}}"), F.lit(0))
    return (proteins(spark, sf).select("doc_id", F.posexplode(pieces).alias("k", "piece"))
            .withColumn("i", F.col("doc_id") + F.col("k")))


def _standard(c):
    return F.regexp_replace(c, NON_STANDARD_PATTERN, "")


_WINDOWS_SQL = f"""SELECT doc_id, k, doc_id + k AS i, substr(full_sequence, k * {MAX_RESIDUES} + 1, {MAX_RESIDUES}) AS piece
  FROM (SELECT doc_id, full_sequence, unnest(range(0, CAST(ceil(length(full_sequence) / {MAX_RESIDUES}.0) AS BIGINT))) AS k
        FROM docp) t"""


def scan_requests_from_documents(spark, sf):
    """One scan request per window, with a mix of valid and invalid fields."""
    w = _windows(spark, sf)
    i = F.col("i")
    sequence = (F.when(i % 29 == 5, F.concat("piece", "piece")).when(i % 31 == 7, F.lit(""))
                .when(i % 5 == 0, F.col("piece")).otherwise(_standard("piece")))
    top_n = (F.when(i % 17 == 0, F.lit(0)).when(i % 17 == 1, F.lit(501))
             .when(i % 7 == 2, F.lit(None)).otherwise(5 + i % 10)).cast("int")
    positions = (F.when(i % 20 == 0, F.lit(None)).when(i % 11 == 1, F.array().cast("array<int>"))
                 .when(i % 23 == 3, F.array(F.lit(2), F.lit(2000))).when(i % 23 == 4, F.array(F.lit(0), F.lit(2)))
                 .otherwise(F.array(F.lit(5), F.lit(1), F.lit(3), F.lit(3)))).cast("array<int>")
    return w.select(F.concat(F.lit("j"), F.col("doc_id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("job_id"),
                    F.timestamp_seconds(F.lit(1704067200) + i).alias("submitted_at"),
                    sequence.alias("sequence"), top_n.alias("top_n"), positions.alias("positions"))


def q_requests_batch(spark, sf):
    planned = RQ.plan_scan_requests(scan_requests_from_documents(spark, sf))
    return planned.select("job_id", F.col("length").cast("long").alias("length"),
                          F.col("top_n").cast("long").alias("top_n"),
                          F.array_join("positions", ",").alias("positions"),
                          "num_mutations", "estimated_seconds", "error")


_ALPHA_CLASS = f"[^{ALPHABET}]"


def _sequence_error_sql(seq: str) -> str:
    return f"""CASE WHEN length({seq}) = 0 THEN '{MSG.EMPTY}'
         WHEN length({seq}) > {MAX_RESIDUES} THEN CAST(length({seq}) AS VARCHAR) || '{MSG.LONG.format(MAX_RESIDUES)}'
         WHEN regexp_matches({seq}, '{_ALPHA_CLASS}') THEN '{MSG.LETTERS}'
              || array_to_string(list_sort(list_distinct(regexp_extract_all({seq}, '({_ALPHA_CLASS})', 1))), ', ') END"""


_REQUESTS_CTE = f"""docp AS ({PROTEINS_SQL}),
win AS ({_WINDOWS_SQL}),
req AS (
  SELECT 'j' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS job_id, i,
    CASE WHEN i % 29 = 5 THEN piece || piece WHEN i % 31 = 7 THEN '' WHEN i % 5 = 0 THEN piece
         ELSE regexp_replace(piece, '{_ALPHA_CLASS}', '', 'g') END AS seq,
    CAST(CASE WHEN i % 17 = 0 THEN 0 WHEN i % 17 = 1 THEN 501 WHEN i % 7 = 2 THEN 20 ELSE 5 + i % 10 END AS BIGINT) AS top_n,
    CASE WHEN i % 20 = 0 THEN NULL WHEN i % 11 = 1 THEN CAST([] AS INTEGER[]) WHEN i % 23 = 3 THEN [2, 2000]
         WHEN i % 23 = 4 THEN [0, 2] ELSE [5, 1, 3, 3] END AS raw_pos
  FROM win),
planned AS (
  SELECT job_id, seq, CAST(length(seq) AS BIGINT) AS length, top_n,
    CASE WHEN raw_pos IS NOT NULL THEN list_sort(list_distinct(raw_pos)) END AS positions,
    coalesce({_sequence_error_sql('seq')},
      CASE WHEN top_n < 1 OR top_n > 500 THEN '{MSG.TOP_N[0]}' || CAST(top_n AS VARCHAR) || '{MSG.TOP_N[1].format(500)}'
         WHEN len(list_filter(raw_pos, lambda p: p < 1)) > 0 THEN '{MSG.BELOW}'
              || array_to_string(list_filter(raw_pos, lambda p: p < 1)[1:5], ', ')
         WHEN len(list_filter(raw_pos, lambda p: p > length(seq))) > 0 THEN '{MSG.ABOVE[0]}'
              || CAST(length(seq) AS VARCHAR) || '{MSG.ABOVE[1]}'
              || array_to_string(list_sort(list_distinct(list_filter(raw_pos, lambda p: p > length(seq))))[1:10], ', ')
      END) AS error
  FROM req),
counted AS (
  SELECT *, CASE WHEN error IS NULL THEN CAST(coalesce(len(positions), length) * 19 AS BIGINT) END AS num_mutations,
    CASE WHEN error IS NULL THEN CAST(ceil(coalesce(len(positions), length) * 19 / 8.0) AS DOUBLE) * 15.0 END AS estimated_seconds
  FROM planned)"""

SQL_REQUESTS_BATCH = f"""
WITH {_REQUESTS_CTE}
SELECT job_id, length, top_n, array_to_string(positions, ',') AS positions, num_mutations, estimated_seconds, error FROM counted"""


def _flat_results(results):
    """Result rows with the nested document as canonical text, one line per request."""
    r = F.col("result")
    top = F.array_join(F.transform(r["top_mutations"], lambda t: F.format_string(
        "%s%d%s %.6f %.6f", t["wildtype_aa"], t["position"], t["mutant_aa"], t["predicted_mutant"] + 0.0, t["delta"] + 0.0)), ";")
    summary = F.array_join(F.transform(r["position_summary"], lambda s: F.format_string(
        "%s%d %.6f %s", s["wildtype_aa"], s["position"], s["avg_delta"] + 0.0, s["best_substitution"])), ";")
    return results.select("job_id", "status", "estimated_seconds", "error",
                          r["wildtype_predicted"].alias("wildtype_predicted"),
                          r["sequence_length"].cast("long").alias("sequence_length"),
                          r["num_mutations_scanned"].cast("long").alias("num_mutations"),
                          top.alias("top_mutations"), summary.alias("position_summary"))


def q_scan_result_doc(spark, sf):
    """Scan result per request (done with result, or failed with error), flattened to text."""
    planned = RQ.plan_scan_requests(scan_requests_from_documents(spark, sf))
    return _flat_results(RQ.answer_scan_requests(planned, HEAD))


_RESULT_VIEWS = {
    **MUTANTS_CTE,
    "pos": """SELECT x.* FROM (SELECT st2.* EXCLUDE (seq), CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS position,
        unnest(string_split(seq, '')) AS wildtype_aa FROM st2 WHERE length(seq) > 0) x
      JOIN planned p ON p.job_id = x.protein_id WHERE p.positions IS NULL OR list_contains(p.positions, x.position)""",
    "ps": f"""SELECT protein_id, position, wildtype_aa, {mean6_sql(f'sum({to_micro_sql("delta")})', 'count(*)')} AS mean_delta,
        min(delta) AS min_delta, (list_sort(list({{'d': delta, 'aa': mutant_aa}})))[1].aa AS best
      FROM mutants GROUP BY protein_id, position, wildtype_aa""",
    "ranked": """SELECT m.*, row_number() OVER (PARTITION BY m.protein_id ORDER BY delta, position, mutant_aa) AS rk FROM mutants m""",
    "tops": """SELECT protein_id, string_agg(printf('%s%d%s %.6f %.6f', wildtype_aa, position, mutant_aa, predicted_mutant + 0.0, delta + 0.0), ';' ORDER BY rk) AS t
      FROM ranked JOIN planned p ON p.job_id = protein_id WHERE rk <= p.top_n GROUP BY protein_id""",
    "sums": """SELECT protein_id, string_agg(printf('%s%d %.6f %s', wildtype_aa, position, mean_delta + 0.0, best), ';' ORDER BY mean_delta, min_delta, position) AS s
      FROM ps GROUP BY protein_id""",
}
SQL_SCAN_RESULT = f"""
WITH {_REQUESTS_CTE},
proteins AS (SELECT job_id AS design_name, seq AS full_sequence FROM planned WHERE error IS NULL),
{", ".join(f"{k} AS ({v})" for k, v in _RESULT_VIEWS.items())}
SELECT c.job_id, CASE WHEN c.error IS NULL THEN 'done' ELSE 'failed' END AS status, c.estimated_seconds, c.error,
  round_even(CAST(st2.wt_f AS DOUBLE), 6) AS wildtype_predicted,
  CASE WHEN c.error IS NULL THEN c.length END AS sequence_length, c.num_mutations,
  CASE WHEN c.error IS NULL THEN coalesce(tops.t, '') END AS top_mutations,
  CASE WHEN c.error IS NULL THEN coalesce(sums.s, '') END AS position_summary
FROM counted c LEFT JOIN st2 ON st2.protein_id = c.job_id
  LEFT JOIN tops ON tops.protein_id = c.job_id LEFT JOIN sums ON sums.protein_id = c.job_id"""


MAX_BATCH = 64


def score_requests_from_documents(spark, sf):
    """Batch scoring requests: the windows of 16 documents each, and an empty batch for every tenth."""
    w = _windows(spark, sf).withColumn("n", F.floor(F.col("doc_id") / 16))
    sequence = F.when(F.col("i") % 397 == 0, F.concat("piece", F.lit("X"))).otherwise(_standard("piece"))
    item = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("id"),
                    sequence.alias("sequence"))
    full = w.groupBy(F.concat(F.lit("b"), F.col("n").cast("string")).alias("batch_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "k", item.alias("item")))), lambda s: s["item"]).alias("sequences"))
    empty = w.where(F.col("n") % 10 == 0).select(F.concat(F.lit("e"), F.col("n").cast("string")).alias("batch_id")).distinct()
    return full.unionByName(empty.withColumn("sequences", F.array().cast(full.schema["sequences"].dataType)))


def q_score_requests(spark, sf):
    out = RQ.answer_score_requests(score_requests_from_documents(spark, sf), HEAD, MAX_BATCH)
    return out.withColumn("idx", F.col("idx").cast("long"))


_SCORE_VIEWS = {
    "docp": PROTEINS_SQL, "win": _WINDOWS_SQL,
    "items": f"""SELECT 'b' || CAST(n AS VARCHAR) AS batch_id, 'd' || CAST(doc_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) AS id,
        row_number() OVER (PARTITION BY n ORDER BY doc_id, k) - 1 AS idx, count(*) OVER (PARTITION BY n) AS size, seq,
        {_sequence_error_sql('seq')} AS error
      FROM (SELECT CAST(floor(doc_id / 16) AS BIGINT) AS n, doc_id, k,
              CASE WHEN i % 397 = 0 THEN piece || 'X' ELSE regexp_replace(piece, '{_ALPHA_CLASS}', '', 'g') END AS seq FROM win) t""",
    "proteins": "SELECT id AS design_name, seq AS full_sequence FROM items",
    "st": MUTANTS_CTE["st"], "st2": MUTANTS_CTE["st2"],
    "bad": f"""SELECT batch_id, CASE WHEN any_value(size) > {MAX_BATCH} THEN CAST(any_value(size) AS VARCHAR) || '{MSG.MANY_ITEMS.format(MAX_BATCH)}'
        ELSE 'item ' || CAST(min(idx) FILTER (WHERE error IS NOT NULL) AS VARCHAR) || ': ' || arg_min(error, idx) FILTER (WHERE error IS NOT NULL) END AS batch_error
      FROM items GROUP BY batch_id HAVING any_value(size) > {MAX_BATCH} OR count(error) > 0
      UNION ALL SELECT DISTINCT 'e' || CAST(CAST(floor(doc_id / 16) AS BIGINT) AS VARCHAR), '{MSG.NO_ITEMS}'
      FROM win WHERE CAST(floor(doc_id / 16) AS BIGINT) % 10 = 0""",
}
SQL_SCORE_REQUESTS = f"""
WITH {", ".join(f"{k} AS ({v})" for k, v in _SCORE_VIEWS.items())}
SELECT batch_id, idx, id AS protein_id, round_even(CAST(st2.wt_f AS DOUBLE), 6) AS predicted,
  CAST(length(items.seq) AS BIGINT) AS sequence_length, '{HEAD.version}' AS model_version, NULL AS batch_error
FROM items JOIN st2 ON st2.protein_id = items.id WHERE batch_id NOT IN (SELECT batch_id FROM bad)
UNION ALL
SELECT batch_id, NULL, NULL, NULL, NULL, NULL, batch_error FROM bad"""


def q_requests_stream(spark, sf):
    """Scan requests written as JSON files, answered by the request stream."""
    req = scan_requests_from_documents(spark, sf)
    base = scratch_path(spark, "scan-requests")
    req.write.mode("overwrite").json(f"{base}/in")
    q = scan_request_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", HEAD)
    q.awaitTermination()
    return _flat_results(read_results(spark, f"{base}/out"))


def q_score_requests_stream(spark, sf):
    """The batch scoring requests through their stream."""
    base = scratch_path(spark, "score-requests")
    score_requests_from_documents(spark, sf).write.mode("overwrite").json(f"{base}/in")
    score_request_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", HEAD, max_batch=MAX_BATCH).awaitTermination()
    return read_results(spark, f"{base}/out").drop("finished_at", "epoch", "run").withColumn("idx", F.col("idx").cast("long"))


def q_job_log(spark, sf):
    """The 256 latest scan requests with their status, kept by the stateful log from request files and result rows."""
    base = scratch_path(spark, "job-log")
    req = scan_requests_from_documents(spark, sf)
    req.write.json(f"{base}/in")
    planned = RQ.plan_scan_requests(read_scan_requests(spark, f"{base}/in"))
    planned.select("job_id", F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("status"), "submitted_at",
                   F.current_timestamp().alias("finished_at"), "error").write.parquet(f"{base}/out")
    job_log_stream(spark, f"{base}/in", f"{base}/out", f"{base}/log", f"{base}/checkpoint").awaitTermination()
    jobs = read_jobs(spark, f"{base}/log")
    return jobs.select("job_id", "status", "error", (F.unix_timestamp("submitted_at") - 1704067200).alias("submitted"))


SQL_JOB_LOG = f"""
WITH {_REQUESTS_CTE}
SELECT c.job_id, CASE WHEN c.error IS NULL THEN 'done' ELSE 'failed' END AS status, c.error, CAST(r.i AS BIGINT) AS submitted
FROM counted c JOIN req r ON r.job_id = c.job_id ORDER BY r.i DESC, c.job_id DESC LIMIT {RQ.RETAIN_JOBS}"""


def q_job_retention(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("job_id"),
                                           F.col("ts").alias("submitted_at"), "event_type")
    return RQ.retain_latest(ev, "submitted_at", RQ.RETAIN_JOBS, tie="job_id")


SQL_JOB_RETENTION = f"""
SELECT event_id AS job_id, ts AS submitted_at, event_type FROM events
ORDER BY ts DESC, event_id DESC LIMIT {RQ.RETAIN_JOBS}"""


QUERIES = {
    "fasta_roundtrip": q_fasta_roundtrip,
    "fasta_case": q_fasta_case,
    "score_table": q_score_table,
    "csv_roundtrip": q_csv_roundtrip,
    "requests_batch": q_requests_batch,
    "scan_result_doc": q_scan_result_doc,
    "score_requests": q_score_requests,
    "requests_stream": q_requests_stream,
    "score_requests_stream": q_score_requests_stream,
    "job_log": q_job_log,
    "job_retention": q_job_retention,
}

ORACLES = {
    "fasta_roundtrip": SQL_FASTA_ROUNDTRIP,
    "fasta_case": SQL_FASTA_CASE,
    "score_table": SQL_SCORE_TABLE,
    "csv_roundtrip": SQL_CSV_ROUNDTRIP,
    "requests_batch": SQL_REQUESTS_BATCH,
    "scan_result_doc": SQL_SCAN_RESULT,
    "score_requests": SQL_SCORE_REQUESTS,
    "requests_stream": SQL_SCAN_RESULT,
    "score_requests_stream": SQL_SCORE_REQUESTS,
    "job_log": SQL_JOB_LOG,
    "job_retention": SQL_JOB_RETENTION,
}

