"""Joins between PSM, spectrum, ground-truth, refinement, score and feature tables.

All joins are equi-joins on (run, spectrum_id, ...); no side is forced into a
broadcast, Spark chooses by size and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.functions import peptide as P
from psmweave.operators.running import rank_rows

KEY = ["run", "spectrum_id"]
ENGINE_KEY = [*KEY, "engine"]
PSM_KEY = [*ENGINE_KEY, "rank"]


# -- results with spectra ----------------------------------------------------


def join_by_key(
    results: DataFrame, spectra: DataFrame, on: Sequence[str], require_all: bool = False
) -> DataFrame:
    """Inner join of results with spectra on title, scan or ordinal.

    With ``require_all`` a result without its spectrum is an error.
    """
    if require_all:
        lost = results.join(spectra, list(on), "left_anti").limit(1).count()
        if lost:
            raise ValueError(f"results without a spectrum (joined on {list(on)})")
    return results.join(spectra, list(on), "inner")


def join_loss(results: DataFrame, spectra: DataFrame, on: Sequence[str]) -> DataFrame:
    """How many results found no spectrum and how many spectra had no result."""
    side_a = results.select(*on).withColumn("_s", F.lit(1))
    side_b = spectra.select(*on).withColumn("_s", F.lit(2))
    per_key = (
        side_a.unionByName(side_b)
        .groupBy(*on)
        .agg(
            F.sum(F.when(F.col("_s") == 1, 1).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("_s") == 2, 1).otherwise(0)).alias("b"),
        )
    )
    return per_key.agg(
        F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("results_lost"),
        F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)).alias("spectra_without_result"),
    )


def zip_positional(
    results: DataFrame, spectra: DataFrame, ordinal: str = "ordinal", file: str = "run"
) -> DataFrame:
    """Row i of a result file belongs to spectrum i of the file; counts must agree."""
    counts = (
        results.groupBy(file)
        .count()
        .join(spectra.groupBy(file).agg(F.count(F.lit(1)).alias("n")), file, "full")
        .filter(~F.col("count").eqNullSafe(F.col("n")))
        .limit(1)
        .count()
    )
    if counts:
        raise ValueError("results and spectra differ in length")
    return results.join(spectra, [file, ordinal], "inner")


# -- ground truth ------------------------------------------------------------


def accepted(qvalue: Column, is_decoy: Column, cutoff: float = 0.01, inclusive: bool = True):
    return ~is_decoy & ((qvalue <= cutoff) if inclusive else (qvalue < cutoff))


def attach_ground_truth(
    psms: DataFrame,
    truth: DataFrame,
    filter_by_gt: bool = True,
    filter_decoys: bool = True,
    equate_il: bool = True,
    cutoff: float = 0.01,
) -> DataFrame:
    """Candidates with the ground-truth peptide of their spectrum.

    ``filter_by_gt=False`` keeps candidates of spectra without ground truth;
    ``filter_decoys=False`` keeps rejected ground truth, marked in ``gt_status``.
    """
    ok = accepted(F.col("qvalue"), F.col("is_decoy"), cutoff)
    if filter_decoys:
        truth = truth.filter(ok)
    else:
        truth = truth.withColumn("gt_status", F.when(ok, "accepted").otherwise("rejected"))
    out = psms.join(truth, KEY, "inner" if filter_by_gt else "left")
    a, b = F.col("peptide"), F.col("gt_peptide")
    if equate_il:
        a, b = P.equate_leu_ile(a), P.equate_leu_ile(b)
    return out.withColumn("correct", a == b)


def evaluate_exact(psms: DataFrame, truth: DataFrame) -> DataFrame:
    """``correct_prediction``: equal to the ground truth; null without ground truth."""
    side = truth.select(*KEY, F.col("gt_peptide").alias("_gt"))
    return (
        psms.join(side, KEY, "left")
        .withColumn("correct_prediction", F.col("peptide") == F.col("_gt"))
        .drop("_gt")
    )


# -- refinements and extra scores ---------------------------------------------


def attach_refinement(psms: DataFrame, refinements: DataFrame) -> DataFrame:
    """Refined PSMs next to their base PSM.

    A spectrum with one base PSM of the engine needs no rank; with several the
    rank decides.  ``status`` is matched, no_base or ambiguous.  An unchanged
    refinement keeps only its score; ``proposed_peptide`` is what the refiner wrote.
    """
    sizes = psms.groupBy(*ENGINE_KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_only")
    )
    base = psms.select(
        *PSM_KEY, "peptide", "score", F.lit(True).alias("_hit")
    )
    out = (
        refinements.join(sizes, ENGINE_KEY, "left")
        .withColumn("rank", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("rank")))
        .join(base, PSM_KEY, "left")
        .select(
            *PSM_KEY,
            "refiner",
            "peptide",
            "score",
            "refined_peptide",
            "refined_score",
            F.when(F.col("_n").isNull(), "no_base")
            .when(F.col("_hit"), "matched")
            .otherwise("ambiguous")
            .alias("status"),
        )
    )
    same = P.equate_leu_ile("peptide") == P.equate_leu_ile("refined_peptide")
    return out.withColumns(
        {
            "unchanged": same,
            "proposed_peptide": F.col("refined_peptide"),
            "refined_peptide": F.when(~same, F.col("refined_peptide")),
        }
    )


def attach_scores_with_status(
    scores: DataFrame, psms: DataFrame, spectra: DataFrame, known_engines: Sequence[str]
) -> DataFrame:
    """Outcome per external score: registered, or what could not be found."""
    spec = spectra.select(*KEY).distinct().withColumn("_spec", F.lit(True))
    base = psms.select(*PSM_KEY).distinct().withColumn("_hit", F.lit(True))
    return (
        scores.join(spec, KEY, "left")
        .join(base, PSM_KEY, "left")
        .withColumn(
            "status",
            F.when(F.col("_spec").isNull(), "spectrum not found")
            .when(~F.col("engine").isin(list(known_engines)), "source psm not found")
            .when(F.col("_hit"), "registered")
            .otherwise("rank not found"),
        )
        .drop("_spec", "_hit")
    )


def attach_features(psms: DataFrame, features: DataFrame, on: Sequence[str] = tuple(PSM_KEY)):
    """PSMs with their feature columns."""
    return psms.join(features, list(on), "inner")


def append_scores(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Several score tables appended as columns over one explicit key."""
    for other in others:
        base = base.join(other, list(on), "inner")
    return base


# -- selecting spectra ---------------------------------------------------------


def common_spectra(psms: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Spectra every listed engine predicted."""
    engines = list(dict.fromkeys(engines))
    some = psms.filter(F.col("engine").isin(engines))
    if len(engines) == 1:
        return some.select(*KEY).distinct()
    return (
        some.select(*KEY, "engine")
        .distinct()
        .groupBy(*KEY)
        .count()
        .filter(F.col("count") == len(engines))
        .select(*KEY)
    )


def unique_spectra(psms: DataFrame, engine: str) -> DataFrame:
    """Spectra only ``engine`` predicted.

    The reference returns the last spectrum looked at instead; the intended
    result is built here.
    """
    return (
        psms.groupBy(*KEY)
        .agg(F.min("engine").alias("lo"), F.max("engine").alias("hi"))
        .filter((F.col("lo") == engine) & (F.col("hi") == engine))
        .select(*KEY)
    )


def severity(error_type: Column | str = "error_type") -> Column:
    col = F.col(error_type) if isinstance(error_type, str) else error_type
    return F.element_at(
        F.create_map(*[F.lit(x) for i, t in enumerate(K.ERROR_TYPES) for x in (t, i)]), col
    )


def correct_spectra(
    evaluated: DataFrame, engines: Sequence[str], correctness: str = "match", exclusive: bool = False
) -> DataFrame:
    """Spectra where a listed engine reaches at least ``correctness``."""
    level = K.ERROR_TYPES.index(correctness)
    good = severity() <= level
    listed = good & F.col("engine").isin(list(engines))
    out = evaluated.groupBy(*KEY).agg(
        F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(listed, 1)).alias("n_listed")
    )
    out = out.filter("n_listed > 0")
    if exclusive:
        out = out.filter("n_good <= 1")
    return out.select(*KEY)


def modified_spectra(
    truth: DataFrame, modification: str, exclude: Sequence[str] = (), peptide: str = "gt_peptide"
) -> DataFrame:
    """Spectra whose ground truth carries ``modification`` ('' = none) and none of ``exclude``."""
    mods = P.modifications(peptide)
    keep = F.size(mods) == 0 if modification == "" else F.array_contains(mods, modification)
    if exclude:
        keep = keep & ~F.arrays_overlap(mods, F.array(*[F.lit(m) for m in exclude]))
    return truth.filter(keep).select(*KEY)


def exclude_out_of_scope(psms: DataFrame, scope: DataFrame, engine: str) -> DataFrame:
    """Drop ``engine``'s predictions for the spectra in ``scope``."""
    gone = scope.select(*KEY).distinct().withColumn("engine", F.lit(engine))
    return psms.join(gone, ENGINE_KEY, "left_anti")


def semi_by_ids(psms: DataFrame, ids: DataFrame, on: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Keep PSMs whose spectrum is listed."""
    return psms.join(ids.select(*on), list(on), "left_semi")


def species_of_proteins(psms: DataFrame, proteins: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct organisms behind each protein list (J18), sorted, with their number."""
    pairs = psms.select(*key, F.explode("protein_list").alias("protein_id"))
    return (
        pairs.join(proteins.select("protein_id", "organism"), "protein_id")
        .select(*key, "organism")
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("organism")).alias("species"))
        .withColumn("species_n", F.size("species"))
    )


def anti_candidates(candidates: DataFrame, psms: DataFrame, on: Sequence[str]) -> DataFrame:
    """Candidates no engine proposed."""
    return candidates.join(psms.select(*on), list(on), "left_anti")


def identified_scans(
    spectra: DataFrame, psms: DataFrame, title: str = "spectrum_id", keep: str = "inner"
) -> DataFrame:
    """Spectra joined with rank-1 PSMs on the scan number inside the id.

    ``keep='left_semi'`` only filters the spectra.
    """
    scan = F.regexp_extract(F.col(title), r"scan=(\d+)", 1).try_cast("long")
    best = psms.filter("rank = 1").withColumn("scan_number", scan).drop(title)
    return spectra.join(best, ["run", "scan_number"], keep)


def score_requests(
    psms: DataFrame, spectra: DataFrame, source: str, target: str, on: Sequence[str] = tuple(KEY)
) -> DataFrame:
    """(ordinal, peptide in the scoring engine's notation) for spectra that have a PSM."""
    ordinals = spectra.select(*on, "ordinal")
    return (
        psms.join(ordinals, list(on), "inner")
        .withColumn("sequence", P.to_engine_format("peptide", source, target))
        .select(*on, "ordinal", "sequence")
    )


def attach_returned_scores(requests: DataFrame, returned: DataFrame, on: Sequence[str]) -> DataFrame:
    """Scores back on their request; a missing score is null."""
    return requests.join(returned, list(on), "left")


def infer_rank(results: DataFrame, ordinal: str = "ordinal", group: Sequence[str] = tuple(KEY)):
    """Rank by file order inside a spectrum."""
    return rank_rows(results, group, [(ordinal, True)], "first")
