"""Multi-step tables of a benchmark run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_tables(
    base: Sequence[tuple[str, DataFrame]], refined: Sequence[tuple[str, DataFrame]] = ()
) -> DataFrame:
    """All engine x scoring x refinement tables as one long table.

    ``base`` tables are labelled ``base`` in column ``refinement``, ``refined`` tables by
    their ``refiner``.  Every curve is then one grouped computation.
    """
    columns = ["run", "spectrum_id", "engine", "score", "correct"]
    parts = [
        df.select(*columns, F.lit(name).alias("scoring"), F.lit("base").alias("refinement"))
        for name, df in base
    ] + [
        df.select(*columns, F.lit(name).alias("scoring"), F.col("refiner").alias("refinement"))
        for name, df in refined
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
