"""Residue alphabet, physico-chemical scales and counting expressions.

Everything here builds ``Column`` expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the published definitions for identical results)
# ---------------------------------------------------------------------------
# The 20 standard amino acids, one-letter codes, alphabetical.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# Kyte & Doolittle (1982) hydropathy index, listed in ALPHABET order:
# A 1.8, C 2.5, D -3.5, E -3.5, F 2.8, G -0.4, H -3.2, I 4.5, K -3.9, L 3.8,
# M 1.9, N -3.5, P -1.6, Q -3.5, R -4.5, S -0.8, T -0.7, V 4.2, W -0.9, Y -1.3
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8,
    "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5,
    "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
# Residue classes.
CHARGED = "DEKR"
AROMATIC = "FWY"
TINY = "AGS"
SMALL = "ACDGNPSTV"
# Longest sequence the embedding model accepts (1024 tokens minus 2 specials).
MAX_RESIDUES = 1022
# Sequences longer than this need an explicit go-ahead before a scan.
LONG_SEQUENCE = 500
# Feature layout: 20 composition fractions, then the 7 summary features.
FEATURE_NAMES = [f"comp_{aa}" for aa in ALPHABET] + [
    "seq_length",
    "mean_kd_hydrophobicity",
    "frac_charged",
    "frac_aromatic",
    "frac_tiny",
    "frac_small",
    "frac_disordered_prone",
]
# ---------------------------------------------------------------------------

# Hydropathy in tenths, so sums over counts stay exact integers.
KD_TENTHS = {aa: int(round(v * 10)) for aa, v in KYTE_DOOLITTLE.items()}
NON_STANDARD_PATTERN = f"[^{ALPHABET}]"


def strip_upper(col: Column | str) -> Column:
    """Strip surrounding (Unicode) whitespace and upper-case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def residue_count(col: Column | str, aa: str) -> Column:
    """Occurrences of one residue letter: length minus length without it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.length(c) - F.length(F.replace(c, F.lit(aa), F.lit("")))


def count_columns(seq_col: str, prefix: str = "_n_") -> list[Column]:
    """20 integer count columns, named ``{prefix}{aa}``."""
    return [residue_count(seq_col, aa).alias(f"{prefix}{aa}") for aa in ALPHABET]


def _sum(cols: list[Column]) -> Column:
    return reduce(add, cols)


def class_count(prefix: str, members: str) -> Column:
    return _sum([F.col(f"{prefix}{aa}") for aa in members])


def sequence_features(df, seq_col: str, keep_counts: bool = False,
                      as_float: bool = True):
    """Add the 27 hand-made features of ``seq_col`` (upper-cased first).

    Fractions use the number of standard residues as denominator (1 if none);
    ``seq_length`` counts every character. Values are cast to float to match
    the single-precision feature matrix of the model inputs.
    """
    up = "_seq_upper"
    pre = "_n_"
    staged = df.withColumn(up, F.upper(F.col(seq_col))).select(
        "*", *count_columns(up, pre))
    n_std = class_count(pre, ALPHABET)
    staged = staged.withColumn("_n_std", n_std).withColumn(
        "_denom", F.greatest(F.col("_n_std"), F.lit(1)).cast("double"))
    denom = F.col("_denom")
    cast = (lambda c: c.cast("float")) if as_float else (lambda c: c)

    feats = [cast(F.col(f"{pre}{aa}").cast("double") / denom).alias(f"comp_{aa}")
             for aa in ALPHABET]
    feats.append(cast(F.length(up).cast("double")).alias("seq_length"))
    kd_tenths = _sum([F.col(f"{pre}{aa}") * F.lit(KD_TENTHS[aa]) for aa in ALPHABET])
    feats.append(cast(kd_tenths.cast("double") / (denom * F.lit(10.0))).alias("mean_kd_hydrophobicity"))
    feats.append(cast(class_count(pre, CHARGED).cast("double") / denom).alias("frac_charged"))
    feats.append(cast(class_count(pre, AROMATIC).cast("double") / denom).alias("frac_aromatic"))
    tiny = cast(class_count(pre, TINY).cast("double") / denom)
    feats.append(tiny.alias("frac_tiny"))
    feats.append(cast(class_count(pre, SMALL).cast("double") / denom).alias("frac_small"))
    feats.append(tiny.alias("frac_disordered_prone"))

    helper = [up, "_n_std", "_denom"] + [f"{pre}{aa}" for aa in ALPHABET]
    out = staged.select("*", *feats)
    if not keep_counts:
        out = out.drop(*helper)
    return out


def feature_vector(df, name: str = "features"):
    """Assemble the 27 feature columns, in fixed order, into one array column."""
    return df.withColumn(name, F.array(*[F.col(c) for c in FEATURE_NAMES]))


def non_standard_residues(col: Column | str) -> Column:
    """Sorted distinct characters outside the standard alphabet."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(c, F.lit(f"({NON_STANDARD_PATTERN})"), F.lit(1))))
