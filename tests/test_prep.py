import numpy as np
import pytest

from mutascope.operators import prep as P

SCHEMA = [("design_name", "string"), ("full_sequence", "string"), ("seq_length", "int"),
          ("source", "string"), ("aggrescan3d_avg_value", "double"), ("evoef2_total", "double"),
          ("charge", "double")]


def _descriptors(spark):
    rows = [("d1", "MKV", 0.5, "1.5", 9.0, 0), ("d2", "AC", None, "2.0", 1.0, 1),     # null target
            ("d3", None, 0.7, "3.0", 1.0, 2),                                          # null sequence
            ("d1", "MKVV", 0.9, "4.0", 1.0, 3),                                        # repeated id
            ("d4", "WW", 0.1, "NaNsentinel", 1.0, 4),                                  # sentinel text
            ("d5", "A", 0.3, "5", 2.0, 5)]
    return spark.createDataFrame(rows, "design_name string, full_sequence string, aggrescan3d_avg_value double, "
                                       "evoef2_total string, extra double, row_id int")


def test_conform_steps(spark):
    df = _descriptors(spark)
    out = P.conform(df, SCHEMA, "af2", "design_name", ["row_id"], numeric_text_cols=["evoef2_total"],
                    required=["aggrescan3d_avg_value", "full_sequence"], seq_col="full_sequence")
    rows = {r["design_name"]: r for r in out.collect()}
    assert out.columns == [n for n, _ in SCHEMA]
    assert set(rows) == {"d1", "d4", "d5"}
    assert rows["d1"]["full_sequence"] == "MKV" and rows["d1"]["seq_length"] == 3   # first kept
    assert rows["d4"]["evoef2_total"] is None and rows["d5"]["evoef2_total"] == 5.0
    assert rows["d1"]["charge"] is None and rows["d1"]["source"] == "af2"


def test_safe_cast_only_touches_strings(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    out = P.safe_cast(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "double"} and out.first()["b"] is None


def test_null_report_and_counts(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (None, None, "y"), (3.0, 2.0, "x")], "a double, b double, s string")
    rep = {r["column"]: (r["n_null"], r["pct_null"]) for r in P.null_report(df, ["a", "b"]).collect()}
    assert rep == {"a": (1, pytest.approx(100 / 3)), "b": (2, pytest.approx(200 / 3))}
    assert [(r["s"], r["n"]) for r in P.count_by(df, "s").collect()] == [("x", 2), ("y", 1)]


def test_describe_numeric_nearest(spark):
    vals = [None if v is None else float(v) for v in [5, 1, 9, 3, 7, 2, 8, None]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = P.describe_numeric(df, "v").first()
    s = sorted(v for v in vals if v is not None)
    n = len(s)
    assert r["n"] == n and r["min"] == 1.0 and r["max"] == 9.0
    assert r["std"] == pytest.approx(np.std(s, ddof=1)) and r["std_pop"] == pytest.approx(np.std(s))
    for q, col in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]:
        assert r[col] == s[int(np.floor((n - 1) * q + 0.5))]


def test_keep_first_hot_key(spark):
    rows = [(1 if i % 3 else 2, i, f"v{i}") for i in range(3000)]     # one key holds 2/3 of rows
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(7)
    got = {r["k"]: r["v"] for r in P.keep_first(df, "k", ["o"]).collect()}
    assert got == {1: "v1", 2: "v0"}
