"""The correctness gate in miniature: oracle SQL runs in DuckDB, and a few
cheap queries match Spark exactly on the smallest driver tables."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_oracles import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_oracle_sql_runs(duck):
    from __spark_entry__ import oracle_sql, queries
    sqls = oracle_sql()
    assert set(sqls) <= set(queries())
    for name, sql in sqls.items():
        duck.execute(f"SELECT count(*) FROM ({sql}) t").fetchone()


@pytest.mark.parametrize("name", ["seq_features", "validate_sequences", "position_spec", "scan_top",
                                  "keep_first", "strat_split", "metrics_by_source", "score_table"])
def test_spark_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    from check_oracles import frame_rows
    s_cols, s_rows = frame_rows(queries()[name](spark, SF).toPandas())
    d_cols, d_rows = frame_rows(duck.execute(oracle_sql()[name]).fetchdf())
    assert s_cols == d_cols and s_rows == d_rows
