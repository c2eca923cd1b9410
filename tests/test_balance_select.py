"""Selection without lists per group, resume by Bloom filter, and partitions of equal cost."""

import random
import statistics

from pyspark.sql import functions as F

from mutascope.operators import embed as E
from mutascope.operators import scan as S


def test_median_of_a_real_valued_scorer(spark):
    """One group with very many distinct deltas, groups of one and two, repeats: exact medians and no list per group."""
    rng = random.Random(4)
    rows = [("hot", "A", round(rng.gauss(0, 3), 6)) for _ in range(20_001)] + [("hot", "C", float(round(rng.gauss(0, 1), 1))) for _ in range(4000)]
    rows += [("one", "A", -0.5), ("two", "A", 0.000001), ("two", "A", 0.000004), ("far", "A", -900.0), ("far", "A", 0.0), ("far", "A", 900.000003)]
    out = S.residue_summary(spark.createDataFrame(rows, "protein_id string, mutant_aa string, delta double"))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.protein_id, r.mutant_aa): r for r in out.collect()}
    assert len(got) == 5
    for key in got:
        deltas = [round(d * 1e6) for p, a, d in rows if (p, a) == key]
        r, middle = got[key], statistics.median(deltas)
        assert r.median_delta == round(middle) / 1e6, key
        assert (r.min_delta, r.n_positions_tested, r.n_beneficial) == (min(deltas) / 1e6, len(deltas), sum(d < 0 for d in deltas))
        assert abs(r.mean_delta - sum(deltas) / len(deltas) / 1e6) <= 1e-6
    assert S.residue_summary(spark.createDataFrame([], "protein_id string, mutant_aa string, delta double")).collect() == []


def test_bloom_resume_equals_the_anti_join(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part")).unionByName(
        spark.createDataFrame([(None, 0), (7, None)], "k long, part long"))
    done = spark.range(0, 5000, 2).select(F.col("id").cast("string").alias("_done"), (F.col("id") % 3).cast("string").alias("_done_split"))
    for split in (None, "part"):
        keys = ["_done"] + (["_done_split"] if split else [])
        # the filter of two runs, merged, and with ids beyond the store's
        filt = E.merge_bloom(E.bloom(done.limit(900), *keys).unionByName(E.bloom(done, *keys)))
        got = E.pending_bloom(df, done, filt, "k", split)
        want = E.pending(df, done, "k", split)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # few certain misses are taken for possible hits
    keyed = E.pending_bloom(df, done.limit(0), filt, "k", "part")
    assert keyed.count() == df.count()


def test_certain_misses_are_not_shuffled(spark, tmp_dir):
    df = spark.range(3000).select("id", F.lit("payload").alias("text"))
    path = f"{tmp_dir}/rows"
    df.write.parquet(path)
    done = spark.range(100).select(F.col("id").cast("string").alias("_done"))
    written = f"{tmp_dir}/bloom"
    E.bloom(done, "_done").write.parquet(written)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = E.pending_bloom(spark.read.parquet(path), done, E.merge_bloom(spark.read.parquet(written)), "id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 2900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    misses = plan[plan.index("Union"):plan.index("LeftAnti")]
    assert "BroadcastHashJoin" in misses and "Exchange hashpartitioning(cast(id" not in misses and "Exchange hashpartitioning(id" not in misses


def test_unfinished_run_is_resumed(spark, tmp_dir):
    """A filter without data (a run that ended before its write), and a store without a filter."""
    df = spark.createDataFrame([(f"p{i}", "ACDE" * (i + 1)) for i in range(30)], "id string, s string")
    first, second = f"{tmp_dir}/a", f"{tmp_dir}/b"
    E.bloom(df.select(F.col("id").alias("_done")), "_done").write.parquet(f"{first}/_bloom")
    assert E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), first, "id", "s")["embedded"] == 30
    E.embed(df.limit(11), E.KmerHashEncoder(k=2, dim=8), "id", "s").write.parquet(second)
    report = E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), second, "id", "s")
    assert (report["already_done"], report["embedded"], report["stored"]) == (11, 19, 30)
    assert E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), second, "id", "s")["embedded"] == 0


def test_partitions_of_equal_cost(spark):
    """A third of the rows have one length, a few are long: every task gets its share of the cost."""
    rng = random.Random(8)
    lengths = [30] * 20_000 + [rng.randint(1, 1022) for _ in range(20_000)] + [1022] * 20_000
    sizes = {}
    for n in lengths:
        sizes[n] = sizes.get(n, 0) + 1
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    parts = E.by_cost(df, "n", "id", 16, sizes).groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum((F.col("n") + 2.0) ** 2).alias("cost"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    mean = sum(r.cost for r in parts) / 16
    assert len(parts) == 16 and sum(r.rows for r in parts) == len(lengths)
    assert max(r.cost for r in parts) <= 1.3 * mean
    edges = sorted((r.low, r.high) for r in parts)
    assert all(b[0] >= a[1] for a, b in zip(edges, edges[1:]))


def test_batches_by_tokens():
    lengths = [1, 1, 2, 3, 50, 60, 1000, 1000]
    cuts = E.sub_batches(lengths, 8, 200)
    assert [i for i, _ in cuts] == [0] + [j for _, j in cuts][:-1] and cuts[-1][1] == len(lengths)
    assert all(j - i == 1 or (j - i) * (max(lengths[i:j]) + 2) <= 200 for i, j in cuts)
    assert cuts[0] == (0, 4) and E.sub_batches([], 8, 200) == [] and E.sub_batches([5] * 9, 4, None) == [(0, 4), (4, 8), (8, 9)]


def test_one_long_protein_is_several_files(spark, tmp_dir):
    """No task of the writer holds over twice the median, and every bucket is complete and in position order."""
    import glob

    from mutascope.sources.sinks import mutation_bucket, write_mutations
    sizes = {"long": 60_000, **{f"p{i}": 3000 for i in range(12)}}
    ids = spark.createDataFrame(list(sizes.items()), "protein_id string, n int")
    rows = ids.select("protein_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position")).select(
        "*", F.lit("A").alias("wildtype_aa"), F.lit("C").alias("mutant_aa"), F.lit(0.5).alias("predicted_wildtype"),
        F.lit(0.25).alias("predicted_mutant"), F.lit(-0.25).alias("delta"))
    path = f"{tmp_dir}/mutations"
    write_mutations(rows, path, buckets=4, task_rows=6000, piece=250)
    back = spark.read.option("header", True).csv(path, schema="safe_id string, protein_id string, position int")
    assert {r.protein_id: r["count"] for r in back.groupBy("protein_id").count().collect()} == sizes
    files = {f: [line.split(",") for line in open(f).read().splitlines()[1:]] for f in glob.glob(f"{path}/bucket=*/*.csv")}
    counts = sorted(len(r) for r in files.values())
    assert counts[-1] <= 2 * statistics.median(counts)
    assert sum(any(r[1] == "long" for r in rows) for rows in files.values()) >= 8
    for found in files.values():
        assert [(r[1], int(r[2])) for r in found] == sorted((r[1], int(r[2])) for r in found)
    bucket = {r.protein_id: r.b for r in ids.select("protein_id", mutation_bucket("protein_id", 4).alias("b")).collect()}
    assert all(f"/bucket={bucket[r[1]]}/" in f for f, found in files.items() for r in found)
    write_mutations(rows.limit(0), f"{tmp_dir}/none", buckets=4)


def test_labels_meet_vectors_in_their_buckets(spark, tmp_dir):
    """The vector side of the join has no exchange; a missing label stops a strict join."""
    import pytest

    from mutascope.operators.models import join_labels
    from mutascope.sources.sinks import write_bucketed
    vectors = spark.range(400).select("id", F.array_repeat(F.col("id").cast("float"), 8).alias("embedding"))
    write_bucketed(vectors, "bucketed_test_store", f"{tmp_dir}/store", "id", 8)
    labels = spark.range(400).select("id", (F.col("id") * 2).alias("y"), F.lit(1).alias("v")).unionByName(
        spark.range(100).select("id", F.lit(-1).alias("y"), F.lit(2).alias("v")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store = spark.table("bucketed_test_store")
        out = join_labels(store, labels, "id", order="v", strict=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("SortMergeJoin"):plan.index("Scan parquet")]
        assert "Exchange" not in left and "bucketed" in plan.lower()
        rows = {r.id: (r.y, len(r.embedding)) for r in out.collect()}
        assert len(rows) == 400 and rows[5] == (-1, 8) and rows[399] == (798, 8)
        with pytest.raises(ValueError, match="without a label"):
            join_labels(store, labels.where("id < 399"), "id", order="v", strict=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_test_store")
