"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutascope.functions.heads import CompositionHead, default_head
from mutascope.functions.residues import LONG_SEQUENCE, MAX_RESIDUES, strip_upper
from mutascope.operators import scan as S
from mutascope.operators.validate import parse_positions
from mutascope.sources.fasta import read_fasta
from mutascope.sources.sinks import write_mutations


def scan_fasta(spark: SparkSession, path: str, out_dir: str | None = None,
               positions_spec: str | None = None, top_n: int = 20, top_positions: int = 15,
               confirm_long: bool = True, head: CompositionHead | None = None,
               max_len: int = MAX_RESIDUES) -> dict[str, DataFrame]:
    """Scan every protein of FASTA file(s) in one job; one output folder each.

    Sequences are upper-cased and stripped. A position spec applies to every
    protein: an empty spec scans all positions, a spec with no valid position
    skips the protein. Proteins longer than 500 residues are skipped unless
    ``confirm_long``. Returns the mutation table, top mutations, position and
    residue summaries and the list of skipped proteins.
    """
    head = head or default_head()
    recs = read_fasta(spark, path, upper_case=True).where(F.col("error").isNull()) \
        .withColumn("sequence", strip_upper("sequence")).withColumn("length", F.length("sequence"))
    if positions_spec:
        recs = parse_positions(recs.withColumn("_spec", F.lit(positions_spec)), "_spec", "length")
        no_pos = F.size("positions") == 0
    else:
        recs = recs.withColumn("positions", F.lit(None).cast("array<int>"))
        no_pos = F.lit(False)
    too_long = F.lit(False) if confirm_long else (F.col("length") > LONG_SEQUENCE)
    skipped = recs.where(no_pos | too_long).select(
        "protein_id", F.when(no_pos, F.lit("no valid positions")).otherwise(F.lit("long sequence"))
        .alias("reason"))
    todo = recs.where(~(no_pos | too_long)).select("protein_id", "sequence", "positions")
    sp = S.scan_positions(todo, "protein_id", "sequence", positions_col="positions", head=head,
                          max_len=max_len)
    mut = S.mutations(sp)
    if out_dir:
        write_mutations(mut, out_dir)
    ps = S.position_summary(sp)
    return {"mutations": mut, "top": S.top_mutations(mut, top_n),
            "positions": S.top_positions(ps, top_positions), "residues": S.residue_summary(mut),
            "skipped": skipped}
