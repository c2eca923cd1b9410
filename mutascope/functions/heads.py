"""Linear heads over the 27 sequence features, folded to per-residue weights.

Every one of the 27 features is either the sequence length or a linear
function of the residue composition (counts / standard-residue total), so any
linear head over them collapses to

    score = S / (scale * denom) + length_weight * length + intercept
    S     = sum over residues of k[aa] * count[aa]

with ``k`` the per-residue weight multiplied by ``scale``. This closed form is
what makes the additive mutation scan O(1) per mutant. With integral ``k`` all
sums are exact, so any engine evaluating the same expression gets the same bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from mutascope.functions.residues import (
    ALPHABET, AROMATIC, CHARGED, KD_TENTHS, KYTE_DOOLITTLE, SMALL, TINY, FEATURE_NAMES,
)


@dataclass(frozen=True)
class CompositionHead:
    """A linear head in per-residue form (see module docstring)."""

    k: dict = field(default_factory=dict)   # residue -> weight * scale
    scale: float = 1.0
    length_weight: float = 0.0
    intercept: float = 0.0
    version: str = "composition_head"

    @staticmethod
    def from_feature_weights(weights: dict, intercept: float = 0.0,
                             version: str = "linear_features") -> "CompositionHead":
        """Fold weights keyed by feature name (``FEATURE_NAMES``) into residue form."""
        unknown = set(weights) - set(FEATURE_NAMES)
        if unknown:
            raise ValueError(f"unknown feature names: {sorted(unknown)}")
        w = {n: float(weights.get(n, 0.0)) for n in FEATURE_NAMES}
        k = {}
        for aa in ALPHABET:
            v = w[f"comp_{aa}"] + w["mean_kd_hydrophobicity"] * KYTE_DOOLITTLE[aa]
            v += w["frac_charged"] * (aa in CHARGED)
            v += w["frac_aromatic"] * (aa in AROMATIC)
            v += (w["frac_tiny"] + w["frac_disordered_prone"]) * (aa in TINY)
            v += w["frac_small"] * (aa in SMALL)
            k[aa] = v
        return CompositionHead(k=k, scale=1.0, length_weight=w["seq_length"],
                               intercept=float(intercept), version=version)

    # -- Spark expressions ------------------------------------------------
    def residue_sum(self, count_prefix: str) -> Column:
        """S = sum k[aa] * count[aa] over ``{count_prefix}{aa}`` columns."""
        integral = all(float(v).is_integer() for v in self.k.values())
        terms = []
        for aa in ALPHABET:
            kv = int(self.k[aa]) if integral else float(self.k[aa])
            terms.append(F.col(f"{count_prefix}{aa}").cast("long") * F.lit(kv))
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def score(self, s: Column, n_standard: Column, length: Column) -> Column:
        """Double-precision score from (S, standard count, length)."""
        denom = F.greatest(n_standard, F.lit(1)).cast("double")
        return ((s.cast("double") / (F.lit(float(self.scale)) * denom))
                + F.lit(float(self.length_weight)) * length.cast("double")
                + F.lit(float(self.intercept)))

    # -- SQL text (used by oracle queries) ---------------------------------
    def residue_sum_sql(self, count_prefix: str) -> str:
        integral = all(float(v).is_integer() for v in self.k.values())
        parts = []
        for aa in ALPHABET:
            kv = int(self.k[aa]) if integral else repr(float(self.k[aa]))
            parts.append(f"CAST({count_prefix}{aa} AS BIGINT) * {kv}")
        return "(" + " + ".join(parts) + ")"

    def score_sql(self, s: str, n_standard: str, length: str) -> str:
        return (f"((CAST({s} AS DOUBLE) / (CAST({float(self.scale)!r} AS DOUBLE) * "
                f"CAST(greatest({n_standard}, 1) AS DOUBLE))) + "
                f"CAST({float(self.length_weight)!r} AS DOUBLE) * CAST({length} AS DOUBLE) + "
                f"CAST({float(self.intercept)!r} AS DOUBLE))")


def default_head() -> CompositionHead:
    """Stand-in head used by the registered queries (no trained weights exist).

    0.1 per unit of mean hydropathy, +0.5 per aromatic fraction, -0.3 per
    charged fraction, 1e-4 per residue of length; weights kept in thousandths
    so every residue sum is an exact integer.
    """
    k = {}
    for aa in ALPHABET:
        k[aa] = 10 * KD_TENTHS[aa] + 500 * (aa in AROMATIC) - 300 * (aa in CHARGED)
    return CompositionHead(k=k, scale=1000.0, length_weight=1e-4, intercept=0.0,
                           version="composition_head_v1")
