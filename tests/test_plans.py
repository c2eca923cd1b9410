"""Physical-plan shape checks: the plans we want at scale, not just right rows."""

from pyspark.sql import functions as F

from mutascope.operators import prep as P
from mutascope.operators import scan as S
from mutascope.operators.ordinal import with_ordinal


def _plan(df) -> str:
    """The executed (final adaptive) plan, without the initial-plan section."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _proteins(spark, tmp_dir):
    rows = [(i, "MKVLAGWT" * (i + 1), "en", "s") for i in range(40)]
    path = f"{tmp_dir}/docs.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path)


def test_top_n_uses_group_limit(spark, tmp_dir):
    docs = _proteins(spark, tmp_dir)
    top = S.top_mutations(S.scan(docs, "doc_id", "text"), 5)
    top.collect()
    assert "WindowGroupLimit" in _plan(top)


def test_scan_reads_only_needed_columns_and_shuffles_once(spark, tmp_dir):
    docs = _proteins(spark, tmp_dir)
    ps = S.position_summary(S.scan_positions(docs, "doc_id", "text"))
    ps.collect()
    plan = _plan(ps)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("Exchange") == 1          # the (protein, chunk) shuffle only


def test_ordinal_has_no_single_partition_exchange(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3).withColumn("v", F.col("id") % 17)
    out = with_ordinal(df, ["v", "id"], ["g"])
    out.collect()
    assert "SinglePartition" not in _plan(out) and "rangepartitioning" not in _plan(out)


def test_keep_first_aggregates_before_the_shuffle(spark):
    df = spark.range(10000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = P.keep_first(df, "k", ["o"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "partial_min_by" in plan
