"""Registered queries for embeddings, joins to labels and models (E1-E3, F11,
J1-J3, S6, S7, W3, A15, M1-M8, T7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mutascope.functions.residues import ALPHABET, KYTE_DOOLITTLE, MAX_RESIDUES
from mutascope.operators import embed as E
from mutascope.operators import models as MD
from mutascope.operators import split as SP
from mutascope.plans.sqltext import count_sql
from mutascope.plans.views import proteins, table, with_views
from mutascope.session import scratch_path

R = 9
KMER = E.KmerHashEncoder(k=3, dim=64)


# ---------------------------------------------------------------------------
# embed_kmers (E2 + pooling) on whole sequences; long form of non-zero dims
# ---------------------------------------------------------------------------

def q_embed_kmers(spark, sf):
    """Non-zero dimensions; a sequence without any k-mer has one row with dim -1."""
    p = proteins(spark, sf)
    emb = E.embed(p, KMER, "design_name", "full_sequence", batch_size=8, max_len=None)
    used = F.filter(F.transform("embedding", lambda v, i: F.struct(i.cast("long").alias("dim"), v.alias("value"))),
                    lambda x: x["value"] > 0)
    none = F.array(F.struct(F.lit(-1).cast("long").alias("dim"), F.lit(0.0).cast("float").alias("value")))
    return (emb.select(F.col("id").alias("design_name"), F.explode(F.when(F.size(used) > 0, used).otherwise(none)).alias("x"))
               .select("design_name", "x.dim", "x.value"))


SQL_EMBED_KMERS = with_views(f"""
SELECT design_name, CAST(b AS BIGINT) AS dim, CAST(count(*) / any_value(n) AS FLOAT) AS value
FROM (
  SELECT design_name, n,
    (instr('{ALPHABET}', ch[i]) + instr('{ALPHABET}', ch[i + 1]) * 21 + instr('{ALPHABET}', ch[i + 2]) * 441) % 64 AS b
  FROM (SELECT design_name, string_split(full_sequence, '') AS ch, length(full_sequence) - 2 AS n,
               unnest(range(1, length(full_sequence) - 1)) AS i
        FROM proteins WHERE length(full_sequence) >= 3) t) u
GROUP BY design_name, b
UNION ALL
SELECT design_name, -1, CAST(0 AS FLOAT) FROM proteins WHERE length(full_sequence) < 3""")


# ---------------------------------------------------------------------------
# mean_pool: element-wise mean of stored vectors per label (F11 over groups)
# ---------------------------------------------------------------------------

def q_mean_pool(spark, sf):
    emb = table(spark, sf, "embeddings")
    g = E.group_mean(emb, "label", "embedding")
    return g.select("label", F.col("dim").cast("long").alias("dim"), F.bround("mean", R).alias("mean"))


SQL_MEAN_POOL = f"""
SELECT label, dim, round_even(avg(CAST(v AS DOUBLE)), {R}) AS mean FROM (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS v FROM embeddings) t
GROUP BY label, dim"""


def q_masked_pool(spark, sf):
    """Masked mean pool of per-residue tokens (code, hydropathy) between markers that must not leak in."""
    p = proteins(spark, sf).select("design_name", "full_sequence")
    mark = F.array(F.array(F.lit(E.SENTINEL), F.lit(E.SENTINEL)))
    chars = F.filter(F.split("full_sequence", ""), lambda c: c != "")
    token = F.transform(chars, lambda c: F.array(F.instr(F.lit(ALPHABET), c).cast("double"), F.ascii(c).cast("double")))
    rows = p.withColumn("n", F.length("full_sequence")).withColumn("tokens", F.concat(mark, token, mark, mark))
    pooled = E.mean_pool(rows, "tokens", "n")
    return pooled.select("design_name", F.get("embedding", F.lit(0)).alias("code"), F.get("embedding", F.lit(1)).alias("letter"))


SQL_MASKED_POOL = with_views(f"""
SELECT design_name, CAST(coalesce(avg(instr('{ALPHABET}', c)), 0) AS FLOAT) AS code, CAST(coalesce(avg(ascii(c)), 0) AS FLOAT) AS letter
FROM (SELECT design_name, unnest(CASE WHEN full_sequence = '' THEN [NULL] ELSE string_split(full_sequence, '') END) AS c FROM proteins) t
GROUP BY design_name""")


def q_embed_splits(spark, sf):
    """Several splits in one store; an id in two splits is embedded in both, a second run adds nothing."""
    p = proteins(spark, sf).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")))
    both = p.unionByName(p.where(F.col("doc_id") % 5 == 0).withColumn("split", F.lit("extra")))
    store = scratch_path(spark, "embedding-splits")
    E.embed_job(p, KMER, store, "design_name", "full_sequence", split_col="split")
    for _ in range(2):
        E.embed_job(both, KMER, store, "design_name", "full_sequence", split_col="split")
    return spark.read.parquet(store).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


SQL_EMBED_SPLITS = with_views(f"""
SELECT split, count(*) AS n, count(DISTINCT design_name) AS ids FROM (
  SELECT design_name, ['train', 'val', 'test'][doc_id % 3 + 1] AS split, full_sequence FROM proteins
  UNION ALL SELECT design_name, 'extra', full_sequence FROM proteins WHERE doc_id % 5 = 0) t
WHERE length(full_sequence) <= {MAX_RESIDUES} GROUP BY split""")


# ---------------------------------------------------------------------------
# Joins: J1 (last label wins), J2 (expand), coverage, J3/S7 resume anti-join
# ---------------------------------------------------------------------------

def q_emb_label_join(spark, sf):
    """Every vector with its last label: a second batch revises a third of the labels; none is NULL."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    labels = table(spark, sf, "labels").withColumn("batch", F.lit(1))
    revised = labels.where(F.col("doc_id") % 3 == 0).withColumn("quality", 1 - F.col("quality")).withColumn("batch", F.lit(2))
    j = MD.join_labels(emb, labels.unionByName(revised), "doc_id", order="batch", how="left")
    return j.select(F.col("doc_id").alias("vec_id"), "label", "quality", "toxic")


SQL_EMB_LABEL_JOIN = """
SELECT e.vec_id, e.label, CASE WHEN l.doc_id % 3 = 0 THEN 1 - l.quality ELSE l.quality END AS quality, l.toxic
FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id"""


def q_label_coverage(spark, sf):
    """Vectors and how many lack a label (strict joins fail when > 0): one left join, one aggregate."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    known = table(spark, sf, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return emb.join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_vectors"),
                                                 F.count_if(F.col("known").isNull()).alias("n_missing"))


SQL_LABEL_COVERAGE = """
SELECT count(*) AS n_vectors, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS n_missing
FROM embeddings"""


def q_emb_meta_join(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    meta = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    j = MD.join_labels(emb, meta, "doc_id", on_duplicate="expand")
    return j.select(F.col("doc_id").alias("vec_id"), "label", "source", "n_chars")


SQL_EMB_META_JOIN = """
SELECT e.vec_id, e.label, d.source, d.n_chars FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"""


def q_store_labels(spark, sf):
    """A bucketed vector store joined strictly to its last labels: each vector's own, then the labels table's.
    The vectors stay in their buckets (S6, J1, J2)."""
    from mutascope.sources.sinks import write_bucketed
    emb = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    path = scratch_path(spark, "bucketed-store")
    name = "store_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    write_bucketed(emb.select("doc_id", "embedding"), name, path, "doc_id", 16)
    own = emb.select("doc_id", F.col("label").cast("long").alias("quality"), F.lit(0).alias("batch"))
    given = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit(1).alias("batch"))
    j = MD.join_labels(spark.table(name), own.unionByName(given), "doc_id", order="batch", strict=True)
    return j.select(F.col("doc_id").alias("vec_id"), "quality", F.size("embedding").cast("long").alias("dim"))


SQL_STORE_LABELS = """
SELECT e.vec_id, CAST(coalesce(l.quality, e.label) AS BIGINT) AS quality, CAST(len(e.embedding) AS BIGINT) AS dim
FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id"""


def q_resume_anti(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    done = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("_done")).distinct()
    return E.pending(docs, done, "doc_id")


SQL_RESUME_ANTI = """
SELECT doc_id, n_chars FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)"""


# ---------------------------------------------------------------------------
# embed_resume: the resumable job run twice on one store
# ---------------------------------------------------------------------------

def q_embed_resume(spark, sf):
    p = proteins(spark, sf)
    store = scratch_path(spark, "embedding-store")
    rows = []
    for run in (1, 2):
        rep = E.embed_job(p, KMER, store, "design_name", "full_sequence", max_len=MAX_RESIDUES)
        rows.append((run, rep["total"], rep["already_done"], rep["skipped"], rep["embedded"], rep["stored"]))
    return spark.createDataFrame(rows, "run long, total long, already_done long, skipped long, "
                                       "embedded long, stored long")


SQL_EMBED_RESUME = with_views(f"""
SELECT 1 AS run, count(*) AS total, 0 AS already_done,
  count(*) FILTER (WHERE length(full_sequence) > {MAX_RESIDUES}) AS skipped,
  count(*) FILTER (WHERE length(full_sequence) <= {MAX_RESIDUES}) AS embedded,
  count(*) FILTER (WHERE length(full_sequence) <= {MAX_RESIDUES}) AS stored
FROM proteins
UNION ALL
SELECT 2, count(*), count(*) FILTER (WHERE length(full_sequence) <= {MAX_RESIDUES}),
  count(*) FILTER (WHERE length(full_sequence) > {MAX_RESIDUES}), 0,
  count(*) FILTER (WHERE length(full_sequence) <= {MAX_RESIDUES})
FROM proteins""")


# ---------------------------------------------------------------------------
# Models on lineitem / embeddings
# ---------------------------------------------------------------------------

STD_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_standardize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *STD_COLS)
    z = MD.standardize(li, STD_COLS)
    return z.select("l_orderkey", "l_linenumber", *[F.bround(f"z_{c}", R).alias(f"z_{c}") for c in STD_COLS])


SQL_STANDARDIZE = f"""
WITH s AS (SELECT {', '.join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}" for c in STD_COLS)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(f"round_even((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, {R}) AS z_{c}" for c in STD_COLS)}
FROM lineitem, s"""


def q_ridge_1d(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("y"), F.col("l_quantity").cast("double").alias("x"))
    fit = MD.fit_ridge(li, ["x"], "y", alpha=1.0)
    return spark.createDataFrame([(round(fit["weights"][0], R), round(fit["intercept"], R))],
                                 "coef double, intercept double") \
        .select(F.bround("coef", 7).alias("coef"), F.bround("intercept", 7).alias("intercept"))


SQL_RIDGE_1D = """
WITH d AS (SELECT l_extendedprice / CAST(100000.0 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy FROM d),
c AS (SELECT (n * cxy / sx / (n + 1.0)) / sx AS coef, mx, my FROM s)
SELECT round_even(coef, 7) AS coef, round_even(my - coef * mx, 7) AS intercept FROM c"""


def _fixed_weights(d: int) -> list[float]:
    return [((j % 7) - 3) / 10 for j in range(d)]


def q_ridge_score(spark, sf):
    emb = table(spark, sf, "embeddings")
    return MD.score_linear(emb, "embedding", _fixed_weights(64), 0.5).select("vec_id", "prediction")


SQL_RIDGE_SCORE = """
SELECT vec_id, CAST(list_reduce(list_transform(generate_series(1, len(embedding)),
         lambda i: CAST(embedding[i] AS DOUBLE) * (CAST(((i - 1) % 7) - 3 AS DOUBLE) / 10.0)),
         lambda a, b: a + b, 0.0) + 0.5 AS FLOAT) AS prediction
FROM embeddings"""


def _emb_split(spark, sf):
    emb = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    return SP.stratified_split(emb, "y", "vec_id", (0.8, 0.1), seed=42)


def q_ridge_fit(spark, sf):
    """Ridge (alpha 1) on the 64-dim vectors -> label; coefficients and val metrics."""
    from mutascope.operators.metrics import regression_metrics
    data = _emb_split(spark, sf)
    train = data.where(F.col("split") == "train")
    fit = MD.fit_ridge(train, "embedding", "y", alpha=1.0)
    val = MD.score_linear(data.where(F.col("split") == "val"), "embedding", fit["weights"], fit["intercept"])
    m = regression_metrics(val, "y", "prediction").first()
    rows = [("intercept", float(fit["intercept"]))] + \
           [(f"w{j}", float(w)) for j, w in enumerate(fit["weights"])] + \
           [(f"val_{k}", float(m[k]) if m[k] is not None else None) for k in ("R2", "RMSE", "MAE", "Pearson_r", "Spearman_rho")]
    return spark.createDataFrame(rows, "term string, value double")


def q_ridge_normal(spark, sf):
    """The normal equations at the fitted weights: per feature sum (y - f)(x - m)/s - alpha w s, and sum (y - f).
    They vanish only if the weights solve the ridge problem."""
    train = _emb_split(spark, sf).where(F.col("split") == "train")
    fit = MD.fit_ridge(train, "embedding", "y", alpha=1.0)
    dot = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(w) for w in fit["weights"]]), lambda a, b: a * b),
                      F.lit(0.0), lambda acc, v: acc + v)
    rest = train.select("embedding", (F.col("y") - dot - F.lit(fit["intercept"])).alias("r"))
    w = F.element_at(F.array(*[F.lit(x) for x in fit["weights"]]), F.col("dim") + 1)
    per = (rest.select("r", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double")).groupBy("dim")
           .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.sum(F.col("r") * F.col("x")).alias("rx"), F.sum("r").alias("sr")))
    gradient = (F.col("rx") - F.col("m") * F.col("sr")) / F.col("s") - F.lit(fit["alpha"]) * w * F.col("s")
    terms = per.select(F.concat(F.lit("w"), F.col("dim").cast("string")).alias("term"), gradient.alias("g"))
    terms = terms.unionByName(rest.agg(F.sum("r").alias("g")).select(F.lit("intercept").alias("term"), "g"))
    return terms.select("term", (F.bround("g", 6) + 0.0).alias("gradient"))


SQL_RIDGE_NORMAL = """
SELECT 'w' || CAST(j AS VARCHAR) AS term, CAST(0 AS DOUBLE) AS gradient
FROM (SELECT DISTINCT unnest(range(0, len(embedding))) AS j FROM embeddings) t
UNION ALL SELECT 'intercept', CAST(0 AS DOUBLE)"""


def q_gbt_fit(spark, sf):
    """Boosted trees with 20-round patience; top-10 importances + rounds kept."""
    data = _emb_split(spark, sf)
    train = data.where(F.col("split") == "train")
    val = data.where(F.col("split") == "val")
    model, rounds, _ = MD.fit_gbt(train, "embedding", "y", "vec_id", val, patience=20, num_partitions=2)
    # persisted and loaded back
    from pyspark.ml.regression import GBTRegressionModel
    path = scratch_path(spark, "gbt-model")
    model.write().overwrite().save(path)
    model = GBTRegressionModel.load(path)
    imp = MD.feature_importances(spark, model, [f"e{j}" for j in range(64)], k=10)
    return imp.withColumn("rounds", F.lit(rounds).cast("long"))


def _toy_layers(dims=(64, 16, 8, 1), seed: int = 42) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i, (a, b) in enumerate(zip(dims[:-1], dims[1:])):
        w = (rng.standard_normal((b, a)) / np.sqrt(a)).tolist()
        bias = (rng.standard_normal(b) * 0.1).tolist()
        last = i == len(dims) - 2
        bn = None if last else [rng.uniform(0.5, 1.5, b).tolist(), (rng.standard_normal(b) * 0.1).tolist(),
                                (rng.standard_normal(b) * 0.1).tolist(), rng.uniform(0.5, 2.0, b).tolist()]
        rows.append((i, w, bias, *(bn if bn else [None] * 4)))
    return rows


def toy_mlp_weights(spark, dims=(64, 16, 8, 1), seed: int = 42):
    """A deterministic small dense network in the weight-table layout."""
    return spark.createDataFrame(_toy_layers(dims, seed), MD.MLP_WEIGHTS_SCHEMA)


def _dense_ctes(source: str, dims, seed: int = 42) -> tuple[str, str]:
    """CTEs that run the toy network in SQL over ``source`` (id, x DOUBLE[]), layer by layer, and the last
    one's name (id, y). erf is its series of positive terms, exp(-x^2) * sum 2^n x^(2n+1) / (2n+1)!!."""
    def nums(v):
        return "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in v) + "]"

    terms, c = [], 1.0
    for n in range(120):
        terms.append(c)
        c *= 2.0 / (2 * n + 3)
    ctes, prev = [f"co AS (SELECT {nums(terms)} AS c)"], source
    layers = _toy_layers(dims, seed)
    for k, w, b, g, beta, mean, var in layers:
        rows = "[" + ", ".join(nums(r) for r in w) + "]"
        ctes.append(f"w{k} AS (SELECT {rows} AS w, {nums(b)} AS b"
                    + (f", {nums(g)} AS g, {nums(beta)} AS be, {nums(mean)} AS mu, {nums(var)} AS va" if g else "") + ")")
        ctes.append(f"z{k} AS (SELECT id, j, list_dot_product(w[j], x) + b[j] AS z{', g[j] AS g, be[j] AS be, mu[j] AS mu, va[j] AS va' if g else ''} "
                    f"FROM (SELECT id, x, unnest(range(1, {len(w) + 1})) AS j FROM {prev}) t, w{k})")
        if not g:
            return ",\n".join(ctes), f"z{k}"
        ctes.append(f"n{k} AS (SELECT id, j, (z - mu) / sqrt(va + CAST({MD.BN_EPS!r} AS DOUBLE)) * g + be AS h FROM z{k})")
        ctes.append(f"e{k} AS (SELECT id, j, h, CASE WHEN abs(h) > 8 THEN sign(h) ELSE CAST({float(2 / np.sqrt(np.pi))!r} AS DOUBLE) * exp(-h * h / 2) * list_sum("
                    f"list_transform(range(0, 120), lambda n: c[n + 1] * pow(h / sqrt(CAST(2 AS DOUBLE)), 2 * n + 1))) END AS f FROM n{k}, co)")
        ctes.append(f"x{k} AS (SELECT id, list(CAST(0.5 AS DOUBLE) * h * (1 + f) ORDER BY j) AS x FROM e{k} GROUP BY id)")
        prev = f"x{k}"


def q_score_encoder_head(spark, sf):
    """Predict path of the service: model window -> encoder -> dense head, per protein."""
    from mutascope.operators.score import encoder_head_scorer, score
    enc = E.ResidueScaleEncoder()
    weights = toy_mlp_weights(spark, dims=(enc.dim, 16, 8, 1))
    p = proteins(spark, sf)
    return score(p, "design_name", "full_sequence", scorer=encoder_head_scorer(enc, weights),
                 version="residue_scale+dense_v1")


def q_mlp_score(spark, sf):
    emb = table(spark, sf, "embeddings")
    return MD.score_mlp(emb, "embedding", toy_mlp_weights(spark), "vec_id")


_MLP_CTES, _MLP_LAST = _dense_ctes("src", (64, 16, 8, 1))
SQL_MLP_SCORE = f"""
WITH src AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
{_MLP_CTES}
SELECT id AS vec_id, CAST(z AS FLOAT) AS prediction FROM {_MLP_LAST}"""

_WIN = f"substr(full_sequence, 1, {MAX_RESIDUES})"
_POOLED = ([f"CAST(CAST({count_sql('w', aa)} AS DOUBLE) / greatest(length(w), 1) AS FLOAT)" for aa in ALPHABET]
           + ["CAST((" + " + ".join(f"{count_sql('w', aa)} * CAST(CAST({KYTE_DOOLITTLE[aa]!r} AS FLOAT) AS DOUBLE)" for aa in ALPHABET)
              + ") / greatest(length(w), 1) AS FLOAT)"])
_ENC_CTES, _ENC_LAST = _dense_ctes("src", (len(ALPHABET) + 1, 16, 8, 1))
SQL_ENCODER_HEAD = with_views(f"""
SELECT p.design_name AS protein_id, round_even(CAST(CAST(z AS FLOAT) AS DOUBLE), 6) AS predicted,
  CAST(length(p.full_sequence) AS BIGINT) AS sequence_length, 'residue_scale+dense_v1' AS model_version
FROM {_ENC_LAST} JOIN proteins p ON p.design_name = id""").replace(
    "\nSELECT p.design_name", f""",
src AS (SELECT design_name AS id, CAST([{', '.join(_POOLED)}] AS DOUBLE[]) AS x FROM (SELECT design_name, {_WIN} AS w FROM proteins) t),
{_ENC_CTES}
SELECT p.design_name""", 1)


QUERIES = {
    "embed_kmers": q_embed_kmers,
    "store_labels": q_store_labels,
    "mean_pool": q_mean_pool,
    "masked_pool": q_masked_pool,
    "embed_splits": q_embed_splits,
    "emb_label_join": q_emb_label_join,
    "label_coverage": q_label_coverage,
    "emb_meta_join": q_emb_meta_join,
    "resume_anti": q_resume_anti,
    "embed_resume": q_embed_resume,
    "standardize": q_standardize,
    "ridge_1d": q_ridge_1d,
    "ridge_score": q_ridge_score,
    "ridge_fit": q_ridge_fit,
    "ridge_normal": q_ridge_normal,
    "gbt_fit": q_gbt_fit,
    "mlp_score": q_mlp_score,
    "score_encoder_head": q_score_encoder_head,
}

ORACLES = {
    "embed_kmers": SQL_EMBED_KMERS,
    "store_labels": SQL_STORE_LABELS,
    "mean_pool": SQL_MEAN_POOL,
    "masked_pool": SQL_MASKED_POOL,
    "embed_splits": SQL_EMBED_SPLITS,
    "emb_label_join": SQL_EMB_LABEL_JOIN,
    "label_coverage": SQL_LABEL_COVERAGE,
    "emb_meta_join": SQL_EMB_META_JOIN,
    "resume_anti": SQL_RESUME_ANTI,
    "embed_resume": SQL_EMBED_RESUME,
    "standardize": SQL_STANDARDIZE,
    "ridge_1d": SQL_RIDGE_1D,
    "ridge_score": SQL_RIDGE_SCORE,
    "ridge_normal": SQL_RIDGE_NORMAL,
    "mlp_score": SQL_MLP_SCORE,
    "score_encoder_head": SQL_ENCODER_HEAD,
}
