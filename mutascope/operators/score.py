"""Scoring tables of sequences: over-length policy, featurise/embed, head, version tag."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascope.functions.heads import CompositionHead, default_head
from mutascope.functions.residues import MAX_RESIDUES
from mutascope.operators.scan import protein_stats
from mutascope.operators.validate import overlength


def score(df: DataFrame, id_col: str = "protein_id", seq_col: str = "sequence",
          head: CompositionHead | None = None, scorer: Callable | None = None,
          on_overlength: str = "truncate", max_len: int = MAX_RESIDUES,
          version: str | None = None) -> DataFrame:
    """Predicted value per sequence, keeping ids.

    ``truncate`` scores the first ``max_len`` residues but reports the full
    length; ``skip`` drops longer rows; ``reject`` keeps them with an error and
    no score. The prediction is single precision, then rounded to 6 dp.
    ``scorer(df, seq_col) -> df + score`` replaces the composition head
    (e.g. an encoder + dense head in ``mapInPandas``).
    """
    head = head or default_head()
    version = version or head.version
    base = df.select(F.col(id_col).alias("protein_id"), F.col(seq_col).alias("sequence"))
    err = None
    if on_overlength == "skip":
        base = overlength(base, "sequence", "skip", max_len)
    elif on_overlength == "reject":
        base = overlength(base, "sequence", "reject", max_len)
        err = F.col("error")
    elif on_overlength != "truncate":
        raise ValueError(f"unknown over-length policy: {on_overlength}")
    if scorer is None:
        carry = ["error"] if err is not None else []
        s = protein_stats(base, "protein_id", "sequence", head, max_len, carry=carry)
        value = F.col("wt_score")
    else:
        s = scorer(base.withColumn("_window", F.substring("sequence", 1, max_len)), "_window") \
            .withColumn("length", F.length("sequence"))
        value = F.col("score").cast("float")
    pred = F.bround(value.cast("double"), 6)
    if err is not None:
        pred = F.when(err.isNull(), pred)
    return s.select("protein_id", pred.alias("predicted"),
                    F.col("length").cast("long").alias("sequence_length"),
                    F.lit(version).alias("model_version"),
                    *(["error"] if err is not None else []))


def encoder_head_scorer(encoder, weights: DataFrame, batch_size: int = 8):
    """Scorer ``(df, seq_col) -> df + score`` = encoder, then a dense head.

    One ``mapInPandas``: each Arrow batch is encoded in sub-batches of
    ``batch_size`` (the encoder is built once per Python worker) and passed
    through the network (batch-norm folded, exact GELU). The weight table is
    small and collected once. Usable for table scoring and as the generic
    scorer of ``scan_positions`` (every mutant window is scored).
    """
    from mutascope.operators.models import fold_layers, mlp_forward
    layers = fold_layers([r.asDict(recursive=True) for r in weights.collect()])

    def scorer(df: DataFrame, seq_col: str) -> DataFrame:
        def run(batches):
            import numpy as np
            for pdf in batches:
                seqs = pdf[seq_col].fillna("").tolist()
                vecs = [encoder.encode(seqs[i:i + batch_size]) for i in range(0, len(seqs), batch_size)]
                x = np.concatenate(vecs) if vecs else np.zeros((0, 1))
                pdf = pdf.copy()
                pdf["score"] = mlp_forward(x, layers) if len(pdf) else np.zeros(0, dtype=np.float32)
                yield pdf

        from pyspark.sql import types as T
        schema = T.StructType(list(df.schema.fields) + [T.StructField("score", T.FloatType())])
        return df.mapInPandas(run, schema)

    return scorer


def encoder_head_points(encoder, weights: DataFrame, batch_size: int = 8):
    """The same model as a scorer of code-point matrices, for scans whose mutants are built in the workers
    (``encoder``: an encoder, or a factory that is called once per Python worker)."""
    from mutascope.operators.models import fold_layers
    return EncoderPoints(encoder, fold_layers([r.asDict(recursive=True) for r in weights.collect()]), batch_size)


@dataclass(frozen=True)
class EncoderPoints:
    encoder: object
    layers: list
    batch_size: int = 8

    def score_points(self, points: np.ndarray) -> np.ndarray:
        from mutascope.operators.embed import worker_encoder
        from mutascope.operators.models import mlp_forward
        model = worker_encoder(self.encoder)
        seqs = [row.tobytes().decode("utf-32-le", "surrogatepass") for row in np.ascontiguousarray(points)]
        vecs = [model.encode(seqs[i:i + self.batch_size]) for i in range(0, len(seqs), self.batch_size)]
        return mlp_forward(np.concatenate(vecs), self.layers) if vecs else np.zeros(0, np.float32)
