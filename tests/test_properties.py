"""Property tests (hypothesis) against the plain-Python statements."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mutascope.functions.residues import FEATURE_NAMES, sequence_features
from mutascope.operators.validate import parse_positions
from tests import reference_model as ref

tokens = st.one_of(st.integers(-3, 40).map(str),
                   st.tuples(st.integers(-3, 40), st.integers(-3, 40)).map(lambda t: f"{t[0]}-{t[1]}"),
                   st.sampled_from(["", " ", "x", "1-", "-", " 7 "]))
specs = st.lists(tokens, min_size=0, max_size=6).map(",".join)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(specs, min_size=1, max_size=8), st.integers(0, 35))
def test_parse_positions_property(spark, batch, n):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i int, spec string") \
        .selectExpr("i", "spec", f"{n} AS n")
    got = {r["i"]: (r["positions"], r["error"]) for r in parse_positions(df, "spec", "n").collect()}
    for i, s in enumerate(batch):
        want, bad = ref.parse_positions(s, n)
        assert got[i][0] == want and (got[i][1] is None) == (bad is None), s


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ACDEFGHIKLMNPQRSTVWYBXZacdk ", max_size=60), min_size=1, max_size=10))
def test_features_property(spark, seqs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    got = {r["i"]: [r[c] for c in FEATURE_NAMES] for r in sequence_features(df, "s").collect()}
    for i, s in enumerate(seqs):
        for g, w in zip(got[i], ref.features(s)):
            assert g == pytest.approx(w, rel=1e-6, abs=1e-6)
