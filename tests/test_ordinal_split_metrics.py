import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mutascope.operators import metrics as M
from mutascope.operators.ordinal import exact_quantiles, rank_table, value_bucket, with_ordinal, with_rank
from mutascope.operators.split import split_summary, stratified_split
from tests import reference_model as ref


def _data(spark, n=997, seed=3):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"]), float(rnd.randint(0, 50))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_with_ordinal_equals_row_number(spark, parts):
    df = _data(spark)
    got = with_ordinal(df, ["v", "id"], ["g"], bucket=value_bucket(df, "v", parts))
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_exact_quantiles(spark):
    df = _data(spark)
    vals = np.array([r["v"] for r in df.collect()])
    q = exact_quantiles(df, "v", (0.1, 0.25, 0.5, 0.9), method="linear")
    for k, v in q.items():
        assert v == pytest.approx(np.quantile(vals, k))
    s = np.sort(vals)
    qn = exact_quantiles(df, "v", (0.25, 0.5), method="nearest")
    for k, v in qn.items():
        assert v == s[int(math.floor((len(s) - 1) * k + 0.5))]


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_average_rank(spark, hot):
    """Ranks by broadcast (frequent values) and by shuffle agree with the brute force."""
    df = _data(spark, 200)
    rows = df.collect()
    got = {r["id"]: r["rank"] for r in with_rank(df, rank_table(df, "v", ["g"]), "v", ["g"], "rank", hot).collect()}
    for g in "abc":
        sub = [r for r in rows if r["g"] == g]
        want = ref.average_ranks([r["v"] for r in sub])
        for r, w in zip(sub, want):
            assert got[r["id"]] == w


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    """400,000 distinct values, with and without exchange reuse."""
    df = spark.range(400_000).select(F.xxhash64("id").cast("double").alias("v"), F.col("id"))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        r = rank_table(df, "v").agg(F.countDistinct("rank").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
        assert (r.n, r.lo, r.hi) == (400_000, 1.0, 400_000.0)
    spark.conf.set("spark.sql.exchange.reuse", "true")


def test_a_value_holding_half_the_rows_is_one_counted_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    q = exact_quantiles(df, "v", (0.25, 0.5, 0.75))
    vals = np.sort(np.array([0.0 if i % 2 == 0 else float(i) for i in range(20_000)]))
    assert all(v == pytest.approx(np.quantile(vals, k)) for k, v in q.items())


def test_null_group_is_kept(spark):
    from mutascope.operators.metrics import regression_metrics
    rows = [(None if i % 3 == 0 else "a", float(i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    out = {r.g: r for r in regression_metrics(df, "y", "p", ["g"]).collect()}
    assert set(out) == {None, "a"} and out[None].n == 20 and out[None].Spearman_rho is not None
    assert with_ordinal(df.withColumn("id", F.monotonically_increasing_id()), ["y", "id"], ["g"]).count() == 60


def test_stratified_split_sizes_and_determinism(spark):
    df = _data(spark, 1003)
    a = stratified_split(df, "v", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = stratified_split(df.repartition(5), "v", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a.exceptAll(b).count() == 0
    vals = np.array([r["v"] for r in df.collect()])
    edges = np.quantile(vals, [0.25, 0.5, 0.75])
    counts = {}
    for r in a.collect():
        assert r["stratum"] == int(np.digitize(r["v"], edges))
        counts.setdefault(r["stratum"], {}).setdefault(r["split"], 0)
        counts[r["stratum"]][r["split"]] += 1
    for s, c in counts.items():
        n = sum(c.values())
        assert c.get("train", 0) == int(n * 0.8) and c.get("val", 0) == int(n * 0.1)
    summ = {r["split"]: r for r in split_summary(a, "v").collect()}
    assert summ["total"]["rows"] == 1003 and summ["total"]["pct"] == 100.0


def test_regression_metrics(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for g in "xy" for _ in range(40)]
    rows += [("c", 1.0, float(i)) for i in range(12)]            # constant target
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r["g"]: r for r in M.regression_metrics(df, "y", "p", ["g"]).collect()}
    for g in "xy":
        y = np.array([r[1] for r in rows if r[0] == g])
        p = np.array([r[2] for r in rows if r[0] == g])
        assert got[g]["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert got[g]["RMSE"] == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
        assert got[g]["MAE"] == pytest.approx(np.abs(y - p).mean())
        assert got[g]["Pearson_r"] == pytest.approx(ref.pearson(list(y), list(p)))
        assert got[g]["Spearman_rho"] == pytest.approx(
            ref.pearson(ref.average_ranks(list(y)), ref.average_ranks(list(p))))
    assert got["c"]["Pearson_r"] is None and got["c"]["R2"] == 0.0


def test_histogram_and_buckets(spark):
    rnd = random.Random(2)
    rows = [(rnd.random(), rnd.random(), rnd.randint(0, 1200)) for _ in range(500)]
    df = spark.createDataFrame(rows, "y double, p double, n int")
    h = {r["bin"]: r["count"] for r in M.error_histogram(df, "y", "p", bins=120).collect()}
    e = np.array([p - y for y, p, _ in rows])
    want, _ = np.histogram(e, bins=120)
    assert sum(h.values()) == 500
    assert sum(abs(h.get(i, 0) - want[i]) for i in range(120)) <= 4     # edge-rounding only
    b = {r["bucket"]: r["n"] for r in M.metrics_by_bucket(df, "y", "p", "n").collect()}
    assert b["1000+"] == sum(1 for *_, n in rows if n >= 1000)
    assert all(v >= 10 for v in b.values())


def test_constant_columns_have_no_correlation_whatever_the_partitions(spark):
    """Partial deviations of a constant need not merge to exactly zero."""
    from mutascope.operators.metrics import compare_models
    rows = [(m, float(i % 37) / 7, {"constant": 0.25, "large": 30000.5}.get(m, float(i % 5))) for i in range(3000) for m in ("constant", "large", "varied")]
    df = spark.createDataFrame(rows, "model string, y double, p double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for parts in (4, 64, 256):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            out = {r.model: r for r in compare_models(df.repartition(parts), round_to=9).collect()}
            assert out["constant"].Pearson_r is None and out["constant"].Spearman_rho is None and out["large"].Spearman_rho is None
            flipped = compare_models(df.where("model <> 'varied'").repartition(parts), y="p", p="y").collect()
            assert all(r.R2 == 0.0 for r in flipped)
            seen.add(tuple(out["varied"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


@pytest.mark.parametrize("direct", [10, 50_000])
def test_selection_in_several_passes_is_exact(spark, monkeypatch, direct):
    """Ties, long tails, integers and few rows; with a small bound the brackets are narrowed first."""
    from mutascope.operators import ordinal
    monkeypatch.setattr(ordinal, "DIRECT", direct)
    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 2, 2, 2]) for _ in range(900)], [rng.lognormvariate(0, 4) for _ in range(3000)],
             [rng.randint(-10**15, 10**15) for _ in range(2000)], [7], [1, 9], []]
    for values in lists:
        kind = "double" if any(isinstance(x, float) for x in values) else "long"
        df = spark.createDataFrame([(x,) for x in [*values, None]], f"v {kind}").repartition(5)
        got = exact_quantiles(df, "v", (0.0, 0.25, 0.5, 0.77, 1.0), more=[F.sum("v")])
        near = exact_quantiles(df, "v", (0.25, 0.5), method="nearest")
        if not values:
            assert got == {0: None, 0.0: None, 0.25: None, 0.5: None, 0.77: None, 1.0: None} or got[0.5] is None
            continue
        s = np.sort(np.array(values, float))
        for q in (0.25, 0.5, 0.77):
            assert got[q] == pytest.approx(np.quantile(s, q), rel=1e-12)
        assert near[0.25] == s[int(math.floor((len(s) - 1) * 0.25 + 0.5))]


def test_split_equals_the_order_by_hash_and_moves_no_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 97 / 7.0).alias("y"), F.lit("payload" * 5).alias("text")).repartition(3)
    out = stratified_split(df, "y", "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("+- Exchange RoundRobin")[0]
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit("42|"), F.col("id").cast("string"))), "id")
    rows = out.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("stratum")))
    want = (F.when(F.col("r") <= F.floor(F.col("n") * 0.8), "train")
            .when(F.col("r") <= F.floor(F.col("n") * 0.8) + F.floor(F.col("n") * 0.1), "val").otherwise("test"))
    assert rows.where(want != F.col("split")).count() == 0 and rows.select("stratum").distinct().count() == 4
    tiny = stratified_split(df.where("id < 3"), "y", "id").collect()
    assert len(tiny) == 3 and all(r.split == "test" for r in tiny)
    assert stratified_split(df.where("id < 0"), "y", "id", edges=[1.0, 2.0, 3.0]).collect() == []
