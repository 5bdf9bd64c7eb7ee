"""Whole-table comparison of several engines with a database search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.functions import peptide as P
from psmweave.operators.compare import match_type_by_hyperscore
from psmweave.operators.filters import collapse_mass_penalty
from psmweave.operators.joins import KEY, accepted, semi_by_ids

COLUMNS = [
    "spectrum_id", "proforma", "sequence", "match_type", "run", "source", "score", "hyperscore",
    "hyperscore_diff", "qvalue", "is_decoy", "rescoring_features", "precursor_mz",
    "retention_time", "protein_list",
]


def merge_results(
    truth: DataFrame,
    engines: Sequence[DataFrame],
    only_identified: bool = True,
    penalised: Sequence[str] = ("Casanovo4.2.0", "ContraNovo"),
) -> DataFrame:
    """Ground truth and engine PSMs in one table with match types.

    Inputs carry ``peptide, source, hyperscore`` next to the key; missing columns of the
    result become null.  Identified spectra have an accepted target with q < 0.01.
    """

    def normalised(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "proforma": P.equate_deamidation("peptide"),
                "sequence": F.translate(P.letters("peptide"), "I", "L"),
            }
        )

    if only_identified:
        truth = truth.filter(accepted(F.col("qvalue"), F.col("is_decoy"), inclusive=False))
        engines = [semi_by_ids(e, truth) for e in engines]
    truth = normalised(truth)
    merged = truth
    for engine in engines:
        merged = merged.unionByName(normalised(engine), allowMissingColumns=True)
    merged = collapse_mass_penalty(merged, penalised, "score") if "engine" in merged.columns else (
        collapse_mass_penalty(merged.withColumn("engine", F.col("source")), penalised).drop("engine")
    )
    reference = truth.select(
        *KEY, F.col("sequence").alias("gt_sequence"), F.col("hyperscore").alias("gt_hyperscore")
    )
    out = match_type_by_hyperscore(merged, reference)
    missing = [c for c in COLUMNS if c not in out.columns]
    return out.withColumns({c: F.lit(None) for c in missing}).select(*COLUMNS)
