"""Row filters and derived columns on PSM and spectrum tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.functions import peptide as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_mass_penalty(psms: DataFrame, engines: Sequence[str], score: str = "score"):
    """Undo the -1 some engines add for a wrong precursor mass."""
    penalised = F.col("engine").isin(list(engines)) & (F.col(score) < 0)
    return psms.withColumn(score, F.when(penalised, F.col(score) + 1).otherwise(F.col(score)))


def best_of_two(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Forward or reverse candidate: higher probability, then smaller mass error.

    A full tie goes to the reverse candidate.  ``fields`` are the column stems with
    ``_forward`` and ``_reverse`` variants.
    """
    pf, pr = F.col("probability_forward"), F.col("probability_reverse")
    tie = (pf == pr) & (F.abs("mass_forward") < F.abs("mass_reverse"))
    forward = (pf > pr) | tie
    picked = {f: F.when(forward, F.col(f"{f}_forward")).otherwise(F.col(f"{f}_reverse")) for f in fields}
    picked["direction"] = F.when(forward, "forward").otherwise("reverse")
    return rows.withColumns(picked)


def decoy_status(protein_list: Column | str, markers: Sequence[str] = ("DECOY", "rev")) -> Column:
    """True when any protein id contains a marker; null without a list."""
    return F.exists(
        _col(protein_list), lambda p: reduce(lambda a, b: a | b, [p.contains(m) for m in markers])
    )


def psm_type(
    is_decoy: Column | str, qvalue: Column | str, cutoff: float = 0.01, inclusive: bool = False
) -> Column:
    """decoy / target_accepted / target_rejected; null without decoy information."""
    ok = _col(qvalue) <= cutoff if inclusive else _col(qvalue) < cutoff
    return (
        F.when(_col(is_decoy).isNull(), F.lit(None))
        .when(_col(is_decoy), "decoy")
        .when(ok, "target_accepted")
        .otherwise("target_rejected")
    )


def reformat_spectra(
    spectra: DataFrame,
    min_peaks: int = 15,
    max_charge: int = 8,
    ids: DataFrame | None = None,
    on: Sequence[str] = ("run", "spectrum_id"),
) -> DataFrame:
    """Mark each spectrum as kept or with the first reason to drop it.

    ``df.filter("reason = 'kept'")`` is the cleaned table, a count by reason the report.
    """
    if ids is not None:
        listed = ids.select(*on).distinct().withColumn("_listed", F.lit(True))
        spectra = spectra.join(listed, list(on), "left")
        missing = F.col("_listed").isNull()
    else:
        missing = F.lit(False)
    out = spectra.withColumn(
        "reason",
        F.when(missing, "not_listed")
        .when(F.size("mz") < min_peaks, "few_peaks")
        .when(F.col("charge").isNull() | (F.col("charge") == 0), "no_charge")
        .when(F.col("charge") > max_charge, "high_charge")
        .otherwise("kept"),
    )
    return out.drop("_listed")


def rebuild_title(title: Column | str, ordinal: Column | str) -> Column:
    """Titles that carry no scan are rebuilt from the spectrum's position."""
    known = F.regexp_extract(_col(title), r"controllerType=\d+ controllerNumber=\d+ scan=\d+", 0)
    return F.when(F.coalesce(known, F.lit("")) != "", known).otherwise(
        F.concat(F.lit("controllerType=0 controllerNumber=1 scan="), _col(ordinal).cast("string"))
    )


def filter_charge(spectra: DataFrame, max_charge: int) -> DataFrame:
    """Charge at most ``max_charge``; spectra without charge are dropped."""
    return spectra.filter(F.col("charge") <= max_charge)


def spectrum_qc(
    spectra: DataFrame,
    min_mz: float = 50.0,
    max_mz: float = 2500.0,
    precursor_tolerance: float = 2.0,
    min_intensity: float = 0.01,
    n_peaks: int = 200,
) -> DataFrame:
    """Clean peak lists: range, precursor, relative intensity, top n, square root, L2 norm.

    Peaks stay in m/z order; an emptied spectrum becomes the single peak (0, 1).
    """
    z = F.arrays_zip(F.col("mz").alias("mz"), F.col("intensity").alias("intensity"))
    clean = spectra.withColumn("_p", z).withColumn(
        "_p",
        F.filter(
            "_p",
            lambda p: (p["mz"] >= min_mz)
            & (p["mz"] <= max_mz)
            & (F.abs(p["mz"] - F.col("precursor_mz")) > precursor_tolerance),
        ),
    )
    clean = clean.withColumn(
        "_top", F.array_max(F.transform("_p", lambda p: p["intensity"]))
    ).withColumn(
        "_p", F.filter("_p", lambda p: p["intensity"] >= F.lit(min_intensity) * F.col("_top"))
    )
    by_intensity = F.array_sort(
        F.transform("_p", lambda p: F.struct((-p["intensity"]).alias("neg"), p["mz"].alias("mz")))
    )
    strongest = F.slice(by_intensity, 1, n_peaks)
    clean = clean.withColumn(
        "_p",
        F.array_sort(
            F.transform(strongest, lambda p: F.struct(p["mz"].alias("mz"), F.sqrt(-p["neg"]).alias("s")))
        ),
    )
    norm = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda a, p: a + p["s"] * p["s"]))
    empty = F.size("_p") == 0
    return (
        clean.withColumn("_n", norm)
        .withColumn(
            "mz",
            F.when(empty, F.array(F.lit(0.0))).otherwise(F.transform("_p", lambda p: p["mz"])),
        )
        .withColumn(
            "intensity",
            F.when(empty, F.array(F.lit(1.0))).otherwise(
                F.transform("_p", lambda p: p["s"] / F.col("_n"))
            ),
        )
        .drop("_p", "_top", "_n")
    )


def min_length(psms: DataFrame, length: int = 4, peptide: str = "peptide") -> DataFrame:
    """Peptides with at least ``length`` residues."""
    return psms.filter(F.length(P.letters(peptide)) >= length)


def modifications_per_run(psms: DataFrame, peptide: str = "peptide") -> DataFrame:
    """PSMs per run and modification."""
    return (
        psms.select("run", F.explode(P.modifications(peptide)).alias("modification"))
        .groupBy("run", "modification")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def noise_cutoff(peaks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Noise levels per spectrum: 5x and 10x the smallest peak, log-median plus deviation (P20)."""
    log = F.log2("intensity")
    return peaks.groupBy(*key).agg(
        (F.min("intensity") * 5).alias("lod_5"),
        (F.min("intensity") * 10).alias("lod_10"),
        F.pow(F.lit(2.0), F.median(log) + F.stddev_pop(log)).alias("std_cutoff"),
    )


def feature(features: Column | str, name: str) -> Column:
    """One value of a feature map; null when absent."""
    return F.element_at(_col(features), name)
