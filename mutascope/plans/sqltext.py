"""SQL text fragments for the DuckDB oracle queries.

They spell out the same definitions as the Spark operators, written
independently from the row definitions (e.g. mutant compositions are counted
from scratch, not updated), so agreement is a real check.
"""

from __future__ import annotations

from mutascope.functions.residues import (
    ALPHABET, AROMATIC, CHARGED, KD_TENTHS, SMALL, TINY,
)


def count_sql(seq: str, aa: str) -> str:
    return f"(length({seq}) - length(replace({seq}, '{aa}', '')))"


def counts_select(seq: str, prefix: str = "c_") -> str:
    return ", ".join(f"{count_sql(seq, aa)} AS {prefix}{aa}" for aa in ALPHABET)


def class_sum(prefix: str, members: str) -> str:
    return "(" + " + ".join(f"{prefix}{aa}" for aa in members) + ")"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def f32(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def features_select(prefix: str, seq: str) -> str:
    """27 feature expressions over count columns ``{prefix}{aa}``."""
    denom = f"greatest({class_sum(prefix, ALPHABET)}, 1)"
    out = [f"{f32(d(prefix + aa) + ' / ' + d(denom))} AS comp_{aa}" for aa in ALPHABET]
    out.append(f"{f32(d(f'length({seq})'))} AS seq_length")
    kd = "(" + " + ".join(f"{prefix}{aa} * {KD_TENTHS[aa]}" for aa in ALPHABET) + ")"
    out.append(f"{f32(d(kd) + ' / (' + d(denom) + ' * CAST(10.0 AS DOUBLE))')} AS mean_kd_hydrophobicity")
    for name, members in [("frac_charged", CHARGED), ("frac_aromatic", AROMATIC),
                          ("frac_tiny", TINY), ("frac_small", SMALL),
                          ("frac_disordered_prone", TINY)]:
        out.append(f"{f32(d(class_sum(prefix, members)) + ' / ' + d(denom))} AS {name}")
    return ",\n  ".join(out)


def strip_upper_sql(x: str) -> str:
    return f"upper(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
