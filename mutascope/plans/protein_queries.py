"""Registered queries over the ``proteins`` view: features, validation,
position specs and the mutation scan family, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from mutascope.functions import messages as MSG
from mutascope.functions.heads import default_head
from mutascope.functions.numeric import mean6_sql, to_micro_sql
from mutascope.functions.residues import ALPHABET, FEATURE_NAMES, MAX_RESIDUES, sequence_features
from mutascope.operators import scan as S
from mutascope.operators.validate import parse_positions, validate_sequences
from mutascope.plans.sqltext import counts_select, features_select, strip_upper_sql
from mutascope.plans.views import proteins, table, with_views

HEAD = default_head()
TOP_N = 20
TOP_POSITIONS = 15


# ---------------------------------------------------------------------------
# seq_features: F1-F10
# ---------------------------------------------------------------------------

def q_seq_features(spark, sf):
    p = proteins(spark, sf)
    return sequence_features(p, "full_sequence").select("design_name", *FEATURE_NAMES)


SQL_SEQ_FEATURES = with_views(f"""
SELECT design_name,
  {features_select('c_', 's')}
FROM (SELECT design_name, upper(full_sequence) AS s, {counts_select('upper(full_sequence)', 'c_')}
      FROM proteins) t""")


# ---------------------------------------------------------------------------
# validate_sequences: V1-V4, V9
# ---------------------------------------------------------------------------

def q_validate_sequences(spark, sf):
    docs = table(spark, sf, "documents")
    # Raw request text = the document's letters and spaces (whitespace kept).
    raw = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("design_name"),
                      F.regexp_replace("text", "[^A-Za-z ]", "").alias("raw"))
    v = validate_sequences(raw, "raw")
    return v.select("design_name", F.col("length").cast("long").alias("length"),
                    "error", "is_long")


_ALPHA_CLASS = f"[^{ALPHABET}]"
SQL_VALIDATE = f"""
WITH raw AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS design_name,
         {strip_upper_sql("regexp_replace(text, '[^A-Za-z ]', '', 'g')")} AS seq
  FROM documents)
SELECT design_name, CAST(length(seq) AS BIGINT) AS length,
  CASE WHEN length(seq) = 0 THEN '{MSG.EMPTY}'
       WHEN length(seq) > {MAX_RESIDUES} THEN CAST(length(seq) AS VARCHAR) || '{MSG.LONG.format(MAX_RESIDUES)}'
       WHEN regexp_matches(seq, '{_ALPHA_CLASS}') THEN '{MSG.LETTERS}'
            || array_to_string(list_sort(list_distinct(regexp_extract_all(seq, '({_ALPHA_CLASS})', 1))), ', ')
  END AS error,
  length(seq) > 500 AS is_long
FROM raw"""


# ---------------------------------------------------------------------------
# position_spec: F12, G4 (specs derived from doc_id)
# ---------------------------------------------------------------------------

def _spec_expr(doc_id):
    """A spec per document mixing the accepted and rejected forms."""
    i = doc_id
    a = (i % 97 + 1).cast("string")
    b = (i % 13 + 5).cast("string")
    c = ((i * 7) % 200).cast("string")
    k = i % 8
    return (F.when(k == 0, F.concat(a))
            .when(k == 1, F.concat(a, F.lit(","), b))
            .when(k == 2, F.concat(b, F.lit("-"), c))
            .when(k == 3, F.concat(a, F.lit(", ,"), b, F.lit("-"), c, F.lit(" ")))
            .when(k == 4, F.concat(c, F.lit("-"), b))
            .when(k == 5, F.concat(F.lit("0,"), a, F.lit(",99999")))
            .when(k == 6, F.concat(a, F.lit(",x")))
            .otherwise(F.concat(F.lit("1-3-"), a)))


def q_position_spec(spark, sf):
    p = proteins(spark, sf).withColumn("spec", _spec_expr(F.col("doc_id")))
    p = p.withColumn("length", F.length("full_sequence"))
    out = parse_positions(p, "spec", "length")
    return out.select("design_name", "spec",
                      F.array_join("positions", ",").alias("positions"),
                      F.size("positions").cast("long").alias("n_positions"),
                      "error")


def _spec_sql(i: str) -> str:
    a = f"CAST({i} % 97 + 1 AS VARCHAR)"
    b = f"CAST({i} % 13 + 5 AS VARCHAR)"
    c = f"CAST(({i} * 7) % 200 AS VARCHAR)"
    return f"""CASE {i} % 8
      WHEN 0 THEN {a}
      WHEN 1 THEN {a} || ',' || {b}
      WHEN 2 THEN {b} || '-' || {c}
      WHEN 3 THEN {a} || ', ,' || {b} || '-' || {c} || ' '
      WHEN 4 THEN {c} || '-' || {b}
      WHEN 5 THEN '0,' || {a} || ',99999'
      WHEN 6 THEN {a} || ',x'
      ELSE '1-3-' || {a} END"""


SQL_POSITION_SPEC = with_views(r"""
SELECT design_name, spec,
  CASE WHEN bad IS NULL THEN array_to_string(list_sort(list_distinct(flatten(
         list_transform(parsed, lambda x: CASE WHEN greatest(x.a, 1) <= least(x.b, len)
              THEN generate_series(greatest(x.a, 1), least(x.b, len)) ELSE [] END)))), ',') ELSE '' END AS positions,
  CASE WHEN bad IS NULL THEN CAST(len(list_distinct(flatten(
         list_transform(parsed, lambda x: CASE WHEN greatest(x.a, 1) <= least(x.b, len)
              THEN generate_series(greatest(x.a, 1), least(x.b, len)) ELSE [] END)))) AS BIGINT) ELSE 0 END AS n_positions,
  CASE WHEN bad IS NOT NULL THEN (CASE WHEN strpos(bad, '-') > 0 THEN '{MSG.BAD_RANGE}'
                                       ELSE '{MSG.BAD_POSITION}' END) || bad END AS error
FROM (
  SELECT *, (list_filter(list_transform(parsed, lambda x: CASE WHEN x.a IS NULL OR x.b IS NULL THEN x.t END),
                         lambda y: y IS NOT NULL))[1] AS bad
  FROM (
    SELECT design_name, spec, len,
      list_transform(toks, lambda t: {'t': t,
         'a': CASE WHEN strpos(t, '-') > 0 THEN TRY_CAST(trim(split_part(t, '-', 1)) AS INTEGER)
                   ELSE TRY_CAST(t AS INTEGER) END,
         'b': CASE WHEN strpos(t, '-') > 0 THEN TRY_CAST(trim(substr(t, strpos(t, '-') + 1)) AS INTEGER)
                   ELSE TRY_CAST(t AS INTEGER) END}) AS parsed
    FROM (
      SELECT design_name, spec, length(full_sequence) AS len,
        list_filter(list_transform(string_split(spec, ','), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')),
                    lambda t: t <> '') AS toks
      FROM (SELECT design_name, full_sequence, SPEC_EXPR AS spec FROM proteins) s0) s1) s2) s3
""".replace("SPEC_EXPR", _spec_sql("doc_id")).replace("{MSG.BAD_RANGE}", MSG.BAD_RANGE).replace("{MSG.BAD_POSITION}", MSG.BAD_POSITION))


# ---------------------------------------------------------------------------
# Mutation scan family: G3-G11, T4-T6, A13, A14, J4, J5, F14
# ---------------------------------------------------------------------------

def _scan_positions(spark, sf):
    p = proteins(spark, sf)
    return S.scan_positions(p, "design_name", "full_sequence", head=HEAD)


def _long(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def q_scan_mutant_classes(spark, sf):
    """Exact digest of the whole mutation table (19-20 rows per residue).

    The table itself has 19 x sum(length) rows; every row is counted here per
    protein and (wild-type, mutant) pair: count, min/max delta, exact sum of
    deltas in micro-units and beneficial count. The full table is
    ``scan()``; ``write_mutations`` writes it out.
    """
    p = proteins(spark, sf)
    return S.mutant_classes(p, "design_name", "full_sequence", head=HEAD)


def q_scan_workers(spark, sf):
    """The same digest from the scan that builds and scores every mutant of every protein in the Python workers."""
    p = proteins(spark, sf)
    mut = S.scan(p, "design_name", "full_sequence", head=HEAD, scorer=S.CompositionPoints(HEAD), counted=True)
    return mut.groupBy("protein_id", "wildtype_aa", "mutant_aa").agg(
        F.sum("n").alias("n"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
        F.sum(S.to_micro(F.col("delta")) * F.col("n")).alias("sum_delta_micro"),
        F.sum(F.when(F.col("delta") < 0, F.col("n")).otherwise(0)).alias("n_beneficial"))


def q_scan_top(spark, sf):
    p = proteins(spark, sf)
    top = S.top_mutations_additive(p, "design_name", "full_sequence", n=TOP_N, head=HEAD)
    return _long(top, "position", "rank")


def q_scan_positions(spark, sf):
    ps = S.position_summary(_scan_positions(spark, sf))
    return _long(ps, "position", "n_beneficial")


def q_scan_top_positions(spark, sf):
    top = S.top_positions_additive(proteins(spark, sf), "design_name", "full_sequence", TOP_POSITIONS, HEAD)
    return _long(top, "position", "n_beneficial", "rank")


def _items(spark, sf):
    """Benchmark passages as sequences; ids of the two halves repeat (equal ids, different records)."""
    return table(spark, sf, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("source"),
        F.concat(F.lit("b"), F.floor(F.col("item_id") / 2).cast("string")).alias("item"),
        F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))


def q_scan_full(spark, sf):
    """Every mutant of every passage with its sequence, scored by the generic scorer; two records share each id."""
    p = _items(spark, sf).select(S.record_id("item", "source").alias("id"), "sequence")
    scored = S.scan(p, "id", "sequence", head=HEAD, scorer=S.head_scorer(HEAD))
    built = S.single_mutants(p, "id", "sequence").select("protein_id", "position", "mutant_aa", F.md5("mutant_sequence").alias("mutant_md5"))
    out = scored.join(built, ["protein_id", "position", "mutant_aa"])
    return out.select("protein_id.source", "protein_id.item", F.col("position").cast("long").alias("position"), "wildtype_aa", "mutant_aa",
                      "predicted_wildtype", "predicted_mutant", "delta", "mutant_md5")


def q_scan_top_keyed(spark, sf):
    """Top mutations of records whose ids repeat between two sources."""
    p = _items(spark, sf).select(S.record_id("item", "source").alias("id"), "sequence")
    top = S.top_mutations_additive(p, "id", "sequence", n=TOP_N, head=HEAD)
    return _long(top.select("protein_id.source", "protein_id.item", *[c for c in top.columns if c != "protein_id"]), "position", "rank")


def q_scan_fasta(spark, sf):
    """Passages as a FASTA file, scanned at given positions and written per bucket, then read back."""
    from mutascope.operators.jobs import scan_fasta
    from mutascope.session import scratch_path
    from mutascope.sources.fasta import write_fasta
    base = scratch_path(spark, "scan-fasta")
    write_fasta(_items(spark, sf).withColumn("id", F.concat("source", F.lit("|"), "item")), f"{base}/in", "id", "sequence")
    scan_fasta(spark, f"{base}/in", f"{base}/out", positions_spec="1-3,10", head=HEAD)
    back = spark.read.option("header", True).csv(f"{base}/out", schema=(
        "safe_id string, protein_id string, position long, wildtype_aa string, mutant_aa string, predicted_wildtype double, "
        "predicted_mutant double, delta double"))
    return back.select("safe_id", "protein_id", "position", "wildtype_aa", "mutant_aa", "predicted_wildtype", "predicted_mutant", "delta")


def q_scan_aa(spark, sf):
    p = proteins(spark, sf)
    return S.residue_summary_additive(p, "design_name", "full_sequence", head=HEAD)


def q_scan_plan(spark, sf):
    p = proteins(spark, sf).withColumn("length", F.length("full_sequence").cast("long"))
    return S.scan_plan(p, "design_name", "length")


def _counts_prime(prefix: str) -> str:
    """Mutant composition counted from the definition (window-aware)."""
    parts = []
    for aa in ALPHABET:
        parts.append(
            f"{prefix}{aa} - CASE WHEN position <= win_len AND wildtype_aa = '{aa}' THEN 1 ELSE 0 END"
            f" + CASE WHEN position <= win_len AND mutant_aa = '{aa}' THEN 1 ELSE 0 END AS m_{aa}")
    return ",\n    ".join(parts)


_N_STD = "(" + " + ".join(f"c_{aa}" for aa in ALPHABET) + ")"
_N_STD_M = "(" + " + ".join(f"m_{aa}" for aa in ALPHABET) + ")"
_ALPHA_LIST = "[" + ", ".join(f"'{a}'" for a in ALPHABET) + "]"

MUTANTS_CTE = {
    "st": f"""SELECT design_name AS protein_id, full_sequence AS seq,
        length(substr(full_sequence, 1, {MAX_RESIDUES})) AS win_len,
        {counts_select(f'substr(full_sequence, 1, {MAX_RESIDUES})', 'c_')}
      FROM proteins""",
    "st2": f"""SELECT *, CAST({HEAD.score_sql(HEAD.residue_sum_sql('c_'), _N_STD, 'win_len')} AS FLOAT) AS wt_f
      FROM st""",
    "pos": """SELECT st2.* EXCLUDE (seq), CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS position,
        unnest(string_split(seq, '')) AS wildtype_aa
      FROM st2 WHERE length(seq) > 0""",
    "alpha": f"SELECT unnest({_ALPHA_LIST}) AS mutant_aa",
    "mp": f"""SELECT pos.*, alpha.mutant_aa,
    {_counts_prime('c_')}
      FROM pos JOIN alpha ON alpha.mutant_aa <> pos.wildtype_aa""",
    "mutants": f"""SELECT protein_id, CAST(position AS BIGINT) AS position, wildtype_aa, mutant_aa,
        round_even(CAST(wt_f AS DOUBLE), 6) AS predicted_wildtype,
        round_even(CAST(CAST({HEAD.score_sql(HEAD.residue_sum_sql('m_'), _N_STD_M, 'win_len')} AS FLOAT) AS DOUBLE), 6)
          AS predicted_mutant,
        round_even(CAST(CAST({HEAD.score_sql(HEAD.residue_sum_sql('m_'), _N_STD_M, 'win_len')} AS FLOAT) AS DOUBLE)
                   - CAST(wt_f AS DOUBLE), 6) AS delta
      FROM mp""",
}

SQL_SCAN_MUTANT_CLASSES = with_views(f"""
SELECT protein_id, wildtype_aa, mutant_aa, count(*) AS n, min(delta) AS min_delta, max(delta) AS max_delta,
  CAST(sum({to_micro_sql('delta')}) AS BIGINT) AS sum_delta_micro,
  count(*) FILTER (WHERE delta < 0) AS n_beneficial
FROM mutants GROUP BY protein_id, wildtype_aa, mutant_aa""", **MUTANTS_CTE)

SQL_SCAN_TOP = with_views(f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY protein_id ORDER BY delta, position, mutant_aa) AS BIGINT) AS rank
  FROM mutants) t WHERE rank <= {TOP_N}""", **MUTANTS_CTE)

_POS_SUMMARY_CTE = dict(MUTANTS_CTE)
_POS_SUMMARY_CTE["ps"] = f"""SELECT protein_id, position, wildtype_aa,
    {mean6_sql(f'sum({to_micro_sql("delta")})', 'count(*)')} AS mean_delta,
    min(delta) AS min_delta, max(delta) AS max_delta,
    CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_beneficial,
    (list_sort(list({{'d': delta, 'aa': mutant_aa}})))[1].aa AS best_substitution
  FROM mutants GROUP BY protein_id, position, wildtype_aa"""

SQL_SCAN_POSITIONS = with_views("SELECT * FROM ps", **_POS_SUMMARY_CTE)

SQL_SCAN_TOP_POSITIONS = with_views(f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY protein_id ORDER BY mean_delta, min_delta, position) AS BIGINT)
    AS rank FROM ps) t WHERE rank <= {TOP_POSITIONS}""", **_POS_SUMMARY_CTE)

SQL_SCAN_AA = with_views(f"""
SELECT protein_id, mutant_aa,
  {mean6_sql(f'sum({to_micro_sql("delta")})', 'count(*)')} AS mean_delta,
  round_even(median({to_micro_sql('delta')}), 0) / CAST(1000000 AS DOUBLE) AS median_delta,
  min(delta) AS min_delta,
  count(*) AS n_positions_tested,
  CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_beneficial
FROM mutants GROUP BY protein_id, mutant_aa""", **MUTANTS_CTE)

SQL_SCAN_PLAN = with_views("""
SELECT design_name AS protein_id, CAST(length(full_sequence) AS BIGINT) AS length,
  CAST(length(full_sequence) AS BIGINT) AS n_positions,
  CAST(length(full_sequence) * 19 AS BIGINT) AS n_mutants,
  CAST(ceil(length(full_sequence) * 19 / 8.0) AS BIGINT) AS n_batches,
  CAST(ceil(length(full_sequence) * 19 / 8.0) AS DOUBLE) * CAST(15.0 AS DOUBLE) AS estimated_seconds,
  length(full_sequence) > 500 AS is_long
FROM proteins""")


# Mutants built as strings and counted from scratch, unlike the operators.
_STRING_CTE = f"""it AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source,
    'b' || CAST(CAST(floor(item_id / 2) AS BIGINT) AS VARCHAR) AS item, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark),
wt AS (SELECT *, length(substr(seq, 1, {MAX_RESIDUES})) AS win_len, {counts_select(f'substr(seq, 1, {MAX_RESIDUES})', 'c_')} FROM it),
wts AS (SELECT source, item, seq, win_len, CAST({HEAD.score_sql(HEAD.residue_sum_sql('c_'), _N_STD, 'win_len')} AS FLOAT) AS wt_f FROM wt),
ps AS (SELECT *, unnest(range(1, length(seq) + 1)) AS position FROM wts),
al AS (SELECT unnest({_ALPHA_LIST}) AS mutant_aa),
mu AS (SELECT ps.*, substr(seq, position, 1) AS wildtype_aa, mutant_aa,
         substr(seq, 1, position - 1) || mutant_aa || substr(seq, position + 1) AS mutant
       FROM ps JOIN al ON al.mutant_aa <> substr(seq, position, 1)),
mc AS (SELECT *, {counts_select(f'substr(mutant, 1, {MAX_RESIDUES})', 'm_')} FROM mu),
ms AS (SELECT *, CAST({HEAD.score_sql(HEAD.residue_sum_sql('m_'), _N_STD_M, 'win_len')} AS FLOAT) AS mut_f FROM mc),
mutants AS (SELECT source, item, CAST(position AS BIGINT) AS position, wildtype_aa, mutant_aa,
         round_even(CAST(wt_f AS DOUBLE), 6) AS predicted_wildtype, round_even(CAST(mut_f AS DOUBLE), 6) AS predicted_mutant,
         round_even(CAST(mut_f AS DOUBLE) - CAST(wt_f AS DOUBLE), 6) AS delta, md5(mutant) AS mutant_md5 FROM ms)"""

SQL_SCAN_FULL = f"WITH {_STRING_CTE} SELECT * FROM mutants"
SQL_SCAN_TOP_KEYED = f"""WITH {_STRING_CTE}
SELECT * EXCLUDE (mutant_md5) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, item ORDER BY delta, position, mutant_aa) AS BIGINT) AS rank
  FROM mutants) t WHERE rank <= {TOP_N}"""
SQL_SCAN_FASTA = f"""WITH {_STRING_CTE}
SELECT source || '_' || item AS safe_id, source || '|' || item AS protein_id, position, wildtype_aa, mutant_aa, predicted_wildtype,
  predicted_mutant, delta FROM mutants WHERE position IN (1, 2, 3, 10)"""


QUERIES = {
    "seq_features": q_seq_features,
    "validate_sequences": q_validate_sequences,
    "position_spec": q_position_spec,
    "scan_mutant_classes": q_scan_mutant_classes,
    "scan_workers": q_scan_workers,
    "scan_top": q_scan_top,
    "scan_positions": q_scan_positions,
    "scan_top_positions": q_scan_top_positions,
    "scan_aa": q_scan_aa,
    "scan_plan": q_scan_plan,
    "scan_full": q_scan_full,
    "scan_top_keyed": q_scan_top_keyed,
    "scan_fasta": q_scan_fasta,
}

ORACLES = {
    "seq_features": SQL_SEQ_FEATURES,
    "validate_sequences": SQL_VALIDATE,
    "position_spec": SQL_POSITION_SPEC,
    "scan_mutant_classes": SQL_SCAN_MUTANT_CLASSES,
    "scan_workers": SQL_SCAN_MUTANT_CLASSES,
    "scan_top": SQL_SCAN_TOP,
    "scan_positions": SQL_SCAN_POSITIONS,
    "scan_top_positions": SQL_SCAN_TOP_POSITIONS,
    "scan_aa": SQL_SCAN_AA,
    "scan_plan": SQL_SCAN_PLAN,
    "scan_full": SQL_SCAN_FULL,
    "scan_top_keyed": SQL_SCAN_TOP_KEYED,
    "scan_fasta": SQL_SCAN_FASTA,
}

