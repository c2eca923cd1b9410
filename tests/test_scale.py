"""Work that has to stay spread over tasks as the tables grow."""

import random
import re
import weakref

import pytest
from pyspark.sql import functions as F

from mutascope.llm import bpe, neardup, pii
from mutascope.llm import text as X
from mutascope.operators import embed as E
from mutascope.operators import metrics as M
from mutascope.operators import models as MD
from mutascope.operators.ordinal import cut_points, rank_offsets, with_average_rank
from tests import reference_model as ref


def test_embed_run_without_pending_rows_reads_in_no_single_task(spark):
    """Nothing to embed: the input is not folded into one partition to find that out."""
    none = E.by_cost(spark.range(1000).select("id", F.lit(5).alias("n")).where("id < 0"), "n", "id", 16, {})
    assert "Coalesce" not in none._jdf.queryExecution().executedPlan().toString()
    assert none.count() == 0 and none.columns == ["id", "n"]


def test_embed_partitions_grow_with_the_residues(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(E, "PART_RESIDUES", 100)
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("ACDEFGHIKL").alias("s"))
    report = E.embed_job(df, E.KmerHashEncoder(k=2, dim=8), f"{tmp_dir}/store", "id", "s")
    files = spark.read.parquet(f"{tmp_dir}/store").select(F.input_file_name().alias("f")).distinct().count()
    assert report["embedded"] == 300 and files > 16  # 3,000 residues in 30 partitions, not the session's 8


def test_average_ranks_by_buckets(spark):
    """Common values, both zeros, NaN, infinity, a NULL group and a constant group; few and many cut points."""
    rng = random.Random(3)
    pool = [0.0, -0.0, 1.0, 1.0, 1.0, 2.5, float("inf"), float("nan")]
    rows = [(rng.choice(["a", None]), rng.choice(pool) if rng.random() < 0.6 else rng.random() * 4) for _ in range(900)]
    rows += [("c", 7.0)] * 50
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v double").cache()
    want = {}
    for g in ("a", None, "c"):
        ids = [i for i, r in enumerate(rows) if r[0] == g]
        values = [1e300 * 1e9 if rows[i][1] != rows[i][1] else min(rows[i][1], 1e300) for i in ids]
        want.update(zip(ids, ref.average_ranks(values)))
    for buckets in (1, 2, 64):
        cuts = cut_points(df, ["v"], buckets)[1]["v"]
        out = with_average_rank(df, rank_offsets(df, "v", ["g"], cuts), "v", ["g"], "rank", cuts)
        assert {r.id: r["rank"] for r in out.collect()} == want


def test_metrics_join_no_rows_by_value(spark):
    """Ranks come from two exchanges of the rows; the rows are joined with broadcast offsets only."""
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 4001).cast("double").alias("y"), (F.col("id") % 50).cast("double").alias("p"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = M.regression_metrics(df, "y", "p", ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = df.where("g = 1").collect()
    rho = ref.pearson(ref.average_ranks([r.y for r in rows]), ref.average_ranks([r.p for r in rows]))
    assert out.where("g = 1").first().Spearman_rho == pytest.approx(rho)


def test_training_partitions_grow_with_the_rows(spark, monkeypatch):
    """Two partitions at any size would hold all training rows."""
    made = []
    real = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *cols: made.append(n) or real(self, n, *cols))
    df = spark.range(100).select("id", F.array((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    MD.fit_gbt(df, "x", "y", "id", num_partitions=2, maxIter=1, maxDepth=1)
    monkeypatch.setattr(MD, "ROWS_PER_PART", 20)
    MD.fit_gbt(df, "x", "y", "id", num_partitions=2, maxIter=1, maxDepth=1)
    assert made == [2, 5]


def test_wider_neighbours_move_no_signatures(spark, monkeypatch):
    """Many regions: the second forest round joins short rows with the region keys, and finds the same pairs (pipeline)."""
    rng = random.Random(5)
    heads = [[rng.randrange(1 << 31) for _ in range(72)] for _ in range(4)]
    rows = [(i, 50, [v if rng.random() < 0.9 else rng.randrange(1 << 31) for v in heads[i % 4]]) for i in range(80)]
    classes = spark.createDataFrame(rows, "rep long, n long, signature array<int>").cache()
    sizes = neardup.region_sizes(classes).cache()
    few = {tuple(r) for r in neardup.candidates(classes, turn=2, sizes=sizes).collect()}
    monkeypatch.setattr(neardup, "HEAVY_BROADCAST", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = neardup.candidates(classes, turn=2, sizes=sizes)
        lines = many._jdf.queryExecution().executedPlan().toString().splitlines()
        assert {tuple(r) for r in many.collect()} == few and few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [lines[i + 1] for i, x in enumerate(lines[:-1]) if "Exchange hashpartitioning" in x]
    assert moved and not any(re.search(r"[\[ ]signature#\d+[,\]]", x) for x in moved)


@pytest.fixture()
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_dropping_copies_moves_no_texts_of_others(spark, monkeypatch, no_auto_broadcast):
    """The last join of near_dedup shuffled every row with its text once the dropped ids passed the session's threshold."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20] + [None, "", "one word"])]
    rows += [(3, texts[3]), (4, "another text under a known id"), (None, texts[0]), (None, None), (82, "one word"), (90, "one word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, t) for i, t in rows if not (60 <= (i or 0) < 80 or i == 90)), key=str)
    few = neardup.keep_one(docs)
    assert not [x for x in planned(few) if "SortMergeJoin" in x or "Exchange hashpartitioning" in x]
    assert sorted(map(tuple, few.collect()), key=str) == want
    monkeypatch.setattr(neardup, "IDS_BROADCAST", 0)
    monkeypatch.setattr(neardup, "HEAVY_BROADCAST", 0)
    many = neardup.keep_one(docs)
    lines = planned(many)
    wide = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(doc_id" in x and any("Scan ExistingRDD" in y for y in lines[i:i + 9])]
    assert wide and all(any("BroadcastHashJoin" in y for y in lines[i:i + 5]) for i in wide)  # the bitmap is asked first
    assert sorted(map(tuple, many.collect()), key=str) == want


def test_lookup_by_bitmap_equals_a_join(spark, no_auto_broadcast):
    """Few and many keys, null and nested keys, full and empty bitmaps; more than one piece of a bitmap."""
    key = F.when(F.col("id") % 11 != 0, F.struct((F.col("id") % 5000).alias("x"), F.lit("s").alias("y")))
    df = spark.range(12000).select("id", key.alias("k")).cache()
    table = spark.range(0, 5000, 2).select(F.struct(F.col("id").alias("x"), F.lit("s").alias("y")).alias("k"), (F.col("id") + 1).alias("v")).cache()
    for keys in (table, table.limit(1), table.limit(0)):
        want = sorted(map(tuple, df.join(keys, "k", "left").select("id", "k", "v").collect()))
        there = {r[0] for r in want if r[2] is not None}
        for rows in (1 << 20, -1 if keys.count() else 0):
            assert sorted(map(tuple, X.looked_up(df, keys, ["k"], rows).collect())) == want
            assert {r.id for r in X.found(df, keys.select("k"), ["k"], rows).collect()} == there
            assert {r.id for r in X.found(df, keys.select("k"), ["k"], rows, present=False).collect()} == {r[0] for r in want} - there


@pytest.mark.parametrize("size", [30, 6000])
def test_workers_get_small_batches(spark, size):
    """24 MB of texts, short or long, reach a Python worker in batches of about ``X.BATCH`` bytes, and none is lost (pipeline)."""
    n = 24_000_000 // size if size > 1000 else 25_000
    docs = spark.range(n, numPartitions=1).select("id", F.repeat(F.lit("a"), size).alias("text"))
    held = X.map_rows(docs, ["id"], "held long", lambda: lambda part: [[part.column("text").buffers()[2].size] * part.num_rows])
    got = held.agg(F.count("held"), F.countDistinct("id"), F.max("held")).first()
    assert got[0] == got[1] == n and got[2] <= X.BATCH + size


def test_batch_size_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(X.BATCH_CONF, "1234567b")
    docs = session.range(9).select("id", F.lit("b").alias("text"))
    assert X.map_rows(docs, ["id"], "n long", lambda: lambda part: [[1] * part.num_rows]).count() == 9
    assert session.conf.get(X.BATCH_CONF) == "1234567b"


def test_worker_keeps_the_tools_of_its_present_task_only():
    """A vocabulary of an earlier stage is let go when the worker starts a stage that does not use it (pipeline)."""
    def task():
        coder = bpe.coder(bpe.vocabulary_file())
        return lambda part: coder

    first = X.prepared(task)(None)
    assert X.prepared(task)(None) is first  # the next task of its stage finds it
    left = weakref.ref(first)
    del first
    work = X.prepared(lambda: lambda part: [])
    assert left() is None and work(None) == []
    X.prepared(lambda: [X.tool("t", k, object, 2) for k in "abc"])
    assert X.prepared(lambda: X.tool("t", "c", lambda: "new", 2)) != "new" and X.prepared(lambda: X.tool("t", "a", lambda: "new", 2)) == "new"


def test_span_classifier_starts_no_other_workers(spark, monkeypatch):
    """Its few training rows reach Spark as an Arrow table, not through a Python RDD, whose workers would stay beside those of mapInArrow (pipeline)."""
    docs = spark.createDataFrame([("write to a.b@example.com or call +1 202 555 0143, 10.0.0.7, ph 202 555 0143",), (None,)], "text string")
    found = pii.with_candidates(docs).drop("text").cache()
    found.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    weights = pii.train(found)
    assert len(weights) == len(pii.KINDS) + len(pii.FEATURES) + 2 * len(pii.VOTES) + 1 and any(weights)
