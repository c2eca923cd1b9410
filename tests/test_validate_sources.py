import os

import pytest
from pyspark.sql import functions as F

from mutascope.operators.validate import parse_positions, validate_sequences
from mutascope.sources.fasta import read_fasta, write_fasta
from tests import reference_model as ref

SPECS = ["10", "10,15", "20-30", "10,15,20-30", " ,5", "0,999", "30-20", "-5", "a", "1-3-5", "5 - 7", ""]


def test_parse_positions(spark):
    df = spark.createDataFrame([(s, 25) for s in SPECS], "spec string, n int")
    got = {r["spec"]: (r["positions"], r["error"]) for r in parse_positions(df, "spec", "n").collect()}
    for s in SPECS:
        want, bad = ref.parse_positions(s, 25)
        pos, err = got[s]
        assert pos == want, s
        assert (err is None) == (bad is None), s


def test_validate_sequences(spark):
    rows = [("a", "  mkv \n"), ("b", ""), ("c", "A" * 1023), ("d", "MKBXZ"), ("e", "MK V")]
    v = {r["id"]: r for r in validate_sequences(spark.createDataFrame(rows, "id string, s string"), "s").collect()}
    assert v["a"]["error"] is None and v["a"]["sequence"] == "MKV"
    assert v["b"]["error"] == "no residues given"
    assert v["c"]["error"] == "1023 residues; at most 1022 are accepted"
    assert v["d"]["error"] == "unknown letters: B, X, Z"
    assert v["e"]["error"] == "unknown letters:  "


FASTA = (";comment\npreamble\n>p1 some description\nMKV\nla  \n\n;inner\nGG\n>p2\r\nAC\r\nDE\r\n"
         ">headeronly\n> spaced id\nWW")


@pytest.mark.parametrize("upper", [False, True])
def test_read_fasta_matches_line_parser(spark, tmp_dir, upper):
    path = os.path.join(tmp_dir, "x.fasta")
    with open(path, "w", newline="") as fh:
        fh.write(FASTA)
    got = [(r["protein_id"], r["sequence"]) for r in
           read_fasta(spark, path, upper_case=upper).orderBy("record").collect()]
    assert got == ref.parse_fasta_text(FASTA, upper=upper)


def test_fasta_round_trip(spark, tmp_dir):
    rows = [("x1", "A" * 130), ("x2", ""), ("x3", "MKV")]
    df = spark.createDataFrame(rows, "id string, seq string")
    write_fasta(df, os.path.join(tmp_dir, "out"), "id", "seq", width=60)
    back = sorted((r["protein_id"], r["sequence"]) for r in read_fasta(spark, os.path.join(tmp_dir, "out")).collect())
    assert back == sorted(rows)


def test_empty_header_is_an_error_row(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad.fasta")
    with open(path, "w") as fh:
        fh.write(">\nQQ\n>ok\nAA\n")
    rows = read_fasta(spark, path).orderBy("record").collect()
    assert rows[0]["protein_id"] is None and rows[0]["error"]
    assert (rows[1]["protein_id"], rows[1]["sequence"], rows[1]["error"]) == ("ok", "AA", None)


def test_validate_scan_requests(spark):
    from mutascope.operators.validate import validate_scan_requests
    rows = [("ok", "mkvl", None, [3, 1, 3]), ("top0", "MKVL", 0, None), ("top501", "MKVL", 501, None),
            ("neg", "MKVL", 5, [0, -2, 1]), ("far", "MKVL", 5, [9, 2, 7, 9]), ("long", "A" * 1023, 5, None)]
    df = spark.createDataFrame(rows, "id string, sequence string, top_n int, positions array<int>")
    v = {r["id"]: r for r in validate_scan_requests(df).collect()}
    assert v["ok"]["error"] is None and v["ok"]["top_n"] == 20 and v["ok"]["positions"] == [1, 3]
    assert v["ok"]["sequence"] == "MKVL"
    assert v["top0"]["error"] == "top_n 0 is not in 1..500"
    assert "501 is not in" in v["top501"]["error"]
    assert v["neg"]["error"] == "positions start at 1, not 0, -2"
    assert v["far"]["error"] == "beyond the last residue (4): 7, 9"
    assert v["long"]["error"].startswith("1023 residues")


def test_csv_values_after_the_sample_are_widened(spark, tmp_path):
    """Whole numbers in the sample, then a decimal and a text: no value becomes NULL."""
    from mutascope.sources.tables import read_descriptor_csv
    lines = ["id,a,b,c"] + [f"r{i},{i},{i},{i}" for i in range(50)] + ["late,0.5,n/a,7", "none,,,"]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    df = read_descriptor_csv(spark, str(tmp_path / "long.csv"))
    assert dict(df.dtypes) == {"id": "string", "a": "double", "b": "string", "c": "int"}
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 52 and (rows["late"].a, rows["late"].b, rows["late"].c) == (0.5, "n/a", 7)
    assert rows["r3"].b == "3" and rows["none"].a is None
    (tmp_path / "fits.csv").write_text("\n".join(lines[:50]) + "\n")
    assert dict(read_descriptor_csv(spark, str(tmp_path / "fits.csv")).dtypes)["b"] == "int"


def test_least_type_of_every_column(spark, tmp_path):
    """Widening along the lattice, over several files, whatever the order of the values."""
    from mutascope.sources.tables import read_descriptor_csv
    columns = {"i": ("1", "-2", "+3", ""), "l": ("1", "3000000000", "2", "4"), "d": ("1", "2.5", "1e-3", ".5"), "n": ("1", "NaN", "2.0", ""),
               "big": ("1", "99999999999999999999", "2", "3"), "day": ("2024-01-31", "", "2024-02-29", "1999-12-01"),
               "at": ("2024-01-31", "2024-01-31 10:20:30", "2024-01-31T10:20:30.5", ""), "b": ("true", "FALSE", "", "True"),
               "mix": ("1", "true", "", "2"), "bad": ("2024-02-30", "2024-01-01", "", ""), "none": ("", "", "", ""), "t": ("1", "x", "2", "3"),
               "sp": ("1 ", "2", "3", "4")}
    for part, picks in enumerate(((0, 1), (2, 3))):
        lines = [",".join(columns)] + [",".join(v[k] for v in columns.values()) for k in picks]
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    df = read_descriptor_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"i": "int", "l": "bigint", "d": "double", "n": "double", "big": "double", "day": "date", "at": "timestamp",
                               "b": "boolean", "mix": "string", "bad": "string", "none": "string", "t": "string", "sp": "string"}
    for name, values in columns.items():
        assert df.where(F.col(name).isNotNull()).count() == sum(v != "" for v in values), name
