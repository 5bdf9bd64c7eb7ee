"""Predictions against ground truth (C) and residue-level metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.functions import aligned as A
from psmweave.functions import edits as E
from psmweave.functions import peptide as P
from psmweave.operators.fragments import ambiguous_ranges
from psmweave.operators.joins import KEY


def with_distinct(rows: DataFrame, first: str, second: str, **made: Column) -> DataFrame:
    """Add columns that depend on two columns only, made once for each distinct pair of values.

    Rows where either is null get null.
    """
    pairs = _distinct_pairs(rows, first, second).withColumnsRenamed({"_first": first, "_second": second})
    done = pairs.select(
        F.col(first).alias("_first"), F.col(second).alias("_second"),
        *[c.alias(f"_made_{name}") for name, c in made.items()],
    )
    return _joined_back(rows, first, second, done, list(made))


def _distinct_pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    pairs = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    return pairs.select(F.col(first).alias("_first"), F.col(second).alias("_second")).distinct()


def _joined_back(rows: DataFrame, first: str, second: str, done: DataFrame, names: Sequence[str]) -> DataFrame:
    same = (rows[first] == done["_first"]) & (rows[second] == done["_second"])
    renamed = {name: F.col(f"_made_{name}") for name in names}
    return rows.join(done, same, "left").withColumns(renamed).drop("_first", "_second", *[f"_made_{n}" for n in names])


def aligned(
    pairs: DataFrame, first: str = "gt_peptide", second: str = "peptide", mode: str = "best",
    name: str = "aligned", cum_tol: float = 50.0, ind_tol: float = 20.0,
) -> DataFrame:
    """Add the residue alignment of two peptide columns."""
    match = A.aa_match(F.col(first), F.col(second), cum_tol, ind_tol, mode)
    return with_distinct(pairs, first, second, **{name: match})


def isobaric_pairs(rows: DataFrame, key: Sequence[str], name: str = "aligned") -> DataFrame:
    """One row per isobaric residue pair with whether it was resolved."""
    return rows.select(*key, F.inline(F.col(name)["isobaric"]))


def _supported(match: Column, evidence: Column, peptide: Column) -> Column:
    """Every site with evidence lies on a matched residue."""
    has_mod = F.element_at(P.tokens(peptide), 1).endswith("-")
    sites = F.when(has_mod, F.slice(match, F.lit(2), F.greatest(F.size(match) - 2, F.lit(0)))).otherwise(
        F.slice(match, F.lit(1), F.greatest(F.size(match) - 1, F.lit(0)))
    )
    return F.forall(F.zip_with(sites, evidence, lambda m, e: ~F.coalesce(e, F.lit(False)) | F.coalesce(m, F.lit(False))), lambda x: x)


def error_type(
    pairs: DataFrame,
    evidence: str | None = None,
    gt_evidence: str | None = None,
) -> DataFrame:
    """Class of each prediction against its ground truth, with score difference.

    match: same peptide; isobaric_aa: every residue agrees by mass; isobaric_peak: precursor
    within 0.5 Da and all sites with evidence agree; otherwise by score.  Tag lists of
    different length fall back to the scores.
    """
    rows = pairs if "aligned" in pairs.columns else aligned(pairs)
    diff = F.round(F.col("score") - F.col("gt_score"), 3)
    by_score = (
        F.when(diff.isNull(), "Different").when(diff < 0, "Lower score").otherwise("Higher score")
    )
    same_precursor = (
        F.abs(P.peptide_mass("gt_peptide") - P.peptide_mass("peptide")) < 0.5
    )
    if evidence and gt_evidence:
        e, g = F.col(evidence), F.col(gt_evidence)
        peak = (
            e.isNotNull()
            & g.isNotNull()
            & same_precursor
            & _supported(F.col("aligned")["match_1"], g, F.col("gt_peptide"))
            & _supported(F.col("aligned")["match_2"], e, F.col("peptide"))
            & (F.size(ambiguous_ranges(e)) == F.size(ambiguous_ranges(g)))
        )
        peak = F.coalesce(peak, F.lit(False))
    else:
        peak = F.lit(False)
    return rows.withColumn("score_diff", diff).withColumn(
        "error_type",
        F.when(F.col("peptide") == F.col("gt_peptide"), "match")
        .when(F.col("aligned")["pep_match"], "isobaric_aa")
        .when(peak, "isobaric_peak")
        .otherwise(by_score),
    )


def match_type_by_hyperscore(psms: DataFrame, truth: DataFrame) -> DataFrame:
    """Match / Isobaric / Better / Worse / Unpredicted and hyperscore difference (C4).

    ``truth`` has ``gt_sequence, gt_hyperscore`` per spectrum.
    """
    rows = psms.join(truth.select(*KEY, "gt_sequence", "gt_hyperscore"), KEY, "left")
    h, g = F.col("hyperscore"), F.col("gt_hyperscore")
    return rows.withColumns(
        {
            "match_type": F.when(F.col("gt_sequence").isNull(), "Unpredicted")
            .when(F.col("sequence") == F.col("gt_sequence"), "Match")
            .when(h == g, "Isobaric")
            .when(h > g, "Better")
            .when(h < g, "Worse")
            .otherwise("Unpredicted"),
            "hyperscore_diff": h - g,
        }
    ).drop("gt_sequence", "gt_hyperscore")


def edit_distances(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Levenshtein and Damerau-Levenshtein distances, normalised, and transpositions.

    Columns are letter strings.
    """
    longest = F.greatest(F.length(source), F.length(target))
    rows = with_distinct(
        pairs, source, target, levenshtein=F.levenshtein(source, target),
        damerau=E.damerau_levenshtein(F.col(source), F.col(target)),
    )
    return rows.withColumns(
        {
            "l_norm": F.when(longest > 0, F.col("levenshtein") / longest),
            "dl_norm": F.when(longest > 0, F.col("damerau") / longest),
            "transpositions": F.col("levenshtein") - F.col("damerau"),
        }
    )


def sequence_comparison(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Add edit sites in both directions, merged and unmerged."""
    done = E.with_comparison(_distinct_pairs(pairs, source, target), "_first", "_second", "_made_comparison")
    return _joined_back(pairs, source, target, done, ["comparison"])


def site_rows(compared: DataFrame, key: Sequence[str], sites: str = "forward") -> DataFrame:
    """One row per edit site: (key, site_no, source, target, indices, mass_difference, ...)."""
    return _site_per_row(compared, key, F.col("comparison")[sites])


def _site_per_row(compared: DataFrame, key: Sequence[str], sites: Column) -> DataFrame:
    """One row per element. An inner explode would infer a filter on the number of sites and compare all
    pairs for it below the join, so rows without sites go afterwards."""
    rows = compared.select(*key, F.posexplode_outer(sites).alias("site_no", "s"))
    return rows.filter(F.col("s").isNotNull()).select(*key, "site_no", "s.*")


def _annotated(sites: Column, evidence: Column, n_residues: Column, n_term_mods: Column) -> Column:
    # What holds for the whole row is worked out once for it: inside ``add`` it would be for every residue of every site.
    whole = F.struct(ambiguous_ranges(evidence).alias("ranges"), (n_residues - 1 + n_term_mods).alias("last"))

    def add(site: Column, row: Column) -> Column:
        ranges = row["ranges"]
        # A range counts its end residue as well.
        unsure = F.transform(
            site["indices"], lambda i: F.exists(ranges, lambda r: (i >= r["start"]) & (i <= r["end"]))
        )
        last = F.element_at(site["indices"], -1)
        return F.struct(
            site["source"].alias("source"),
            site["target"].alias("target"),
            site["indices"].alias("indices"),
            site["mass_difference"].alias("mass_difference"),
            F.when(F.forall(unsure, lambda u: ~u), "complete")
            .when(F.forall(unsure, lambda u: u), "absent")
            .otherwise("partly")
            .alias("annotation"),
            F.element_at(site["indices"], 1).alias("n_term"),
            (row["last"] - last + F.when(site["ends_deleted"], 1).otherwise(0)).alias("c_term"),
        )

    found = F.filter(sites, lambda s: F.size(s["indices"]) > 0)
    return F.transform(F.array(whole), lambda row: F.transform(found, lambda s: add(s, row)))[0]


def site_evidence(
    compared: DataFrame, key: Sequence[str], merged: bool = False,
    source_evidence: str = "source_evidence", target_evidence: str = "target_evidence",
    source_peptide: str = "source_peptide", target_peptide: str = "target_peptide",
) -> DataFrame:
    """Edit sites with fragment support, distance from both ends and ambiguity.

    A site is ambiguous when both peptides support it fully or not at all.
    """
    names = ("forward_merged", "backward_merged") if merged else ("forward", "backward")

    def side(name: str, evidence: str, peptide: str) -> Column:
        mods = F.when(F.element_at(P.tokens(peptide), 1).endswith("-"), 1).otherwise(0)
        return _annotated(
            F.col("comparison")[name], F.col(evidence), F.length(P.letters(peptide)), mods
        )

    pairs = F.zip_with(
        side(names[0], target_evidence, target_peptide),
        side(names[1], source_evidence, source_peptide),
        lambda f, b: F.struct(
            f["source"].alias("source"),
            f["target"].alias("target"),
            f["mass_difference"].alias("mass_difference"),
            f["annotation"].alias("annotation"),
            b["annotation"].alias("source_annotation"),
            f["n_term"].alias("n_term"),
            f["c_term"].alias("c_term"),
            ((f["annotation"] != "partly") & (f["annotation"] == b["annotation"])).alias("ambiguous"),
        ),
    )
    return _site_per_row(compared, key, pairs)


def refinement_outcome(matched: DataFrame) -> DataFrame:
    """Outcome class of every refinement (C11).

    Correct predictions that stayed unchanged carry no information and are dropped.
    """
    base_ok = F.col("error_type") == "match"
    same = F.col("unchanged")
    return matched.filter(~(base_ok & same)).withColumn(
        "outcome",
        F.when(base_ok, "correct-perturbed")
        .when(same, "wrong-unperturbed")
        .when(F.col("refined_error_type") == "match", "corrected-by-refinement")
        .otherwise("wrong-wrong"),
    )


def error_category(sites: DataFrame, key: Sequence[str], tolerance: float = 0.001) -> DataFrame:
    """Category of errors with exactly one site: reordering, isobaric alternative, other."""
    single = sites.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("source").alias("source"),
        F.first("target").alias("target"),
        F.first("mass_difference").alias("mass_difference"),
    )
    spell = lambda c: F.array_sort(F.split(F.col(c), ""))
    return single.filter("n = 1").drop("n").withColumn(
        "category",
        F.when(spell("source") == spell("target"), "reordering")
        .when(F.round(F.abs("mass_difference"), 4) < tolerance, "isobaric_alternative")
        .otherwise("other"),
    )


# -- residue-level metrics ---------------------------------------------------------


def aa_pep_precision_recall(
    rows: DataFrame, group: Sequence[str] = (), epsilon: float = 1e-8
) -> DataFrame:
    """Residue precision and recall, peptide precision (A5); first peptide is the truth."""
    hits = F.size(F.filter(F.col("aligned")["aa_match"], lambda x: x))
    return rows.groupBy(*group).agg(
        (F.sum(hits) / (F.sum(F.size(F.col("aligned")["match_2"])) + epsilon)).alias("aa_precision"),
        (F.sum(hits) / (F.sum(F.size(F.col("aligned")["match_1"])) + epsilon)).alias("aa_recall"),
        (F.count(F.when(F.col("aligned")["pep_match"], 1)) / (F.count(F.lit(1)) + epsilon)).alias("pep_precision"),
    )


def aa_precision_recall_at(
    residues: DataFrame, totals: DataFrame, threshold: float, group: Sequence[str] = ("engine",)
) -> DataFrame:
    """Residue precision and recall above a score.

    ``residues``: one row per residue with ``score, correct``; ``totals``: ``n_total`` per group.
    """
    above = F.col("score") > threshold
    agg = residues.groupBy(*group).agg(
        F.count(F.when(above & F.col("correct"), 1)).alias("c"), F.count(F.when(above, 1)).alias("n")
    )
    return agg.join(totals.select(*group, "n_total"), list(group)).select(
        *group,
        F.when(F.col("n") > 0, F.col("c") / F.col("n")).alias("aa_precision"),
        F.when(F.col("n_total") > 0, F.col("c") / F.col("n_total")).alias("aa_recall"),
    )


def peptide_pr_at_threshold(
    rows: DataFrame, threshold: float | None = None, group: Sequence[str] = ("engine",),
    target: str = "gt_peptide", prediction: str = "peptide", score: str = "score",
) -> DataFrame:
    """Residue and peptide precision and recall with a confidence filter.

    An empty prediction counts as a target only; without predictions precision is 1.
    """
    n_t = F.size(P.tokens(target))
    n_p = F.size(P.tokens(prediction))
    used = (n_p > 0) if threshold is None else (n_p > 0) & (F.col(score) >= threshold)
    rows = with_distinct(rows, target, prediction, _hits=A.novor_match(F.col(target), F.col(prediction)))
    hit_pep = used & (n_t == n_p) & (F.col("_hits") == n_t)
    agg = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("targets"),
        F.sum(n_t).alias("t_aa"),
        F.sum(F.when(used, n_p).otherwise(0)).alias("p_aa"),
        F.sum(F.when(used, F.col("_hits")).otherwise(0)).alias("m_aa"),
        F.count(F.when(used, 1)).alias("p_pep"),
        F.count(F.when(hit_pep, 1)).alias("m_pep"),
    )
    none = F.col("p_pep") == 0
    return agg.select(
        *group,
        F.when(none, 1.0).otherwise(F.col("m_aa") / F.col("p_aa")).alias("aa_precision"),
        (F.col("m_aa") / F.col("t_aa")).alias("aa_recall"),
        (F.col("m_pep") / F.col("targets")).alias("pep_recall"),
        F.when(none, 1.0).otherwise(F.col("m_pep") / F.col("p_pep")).alias("pep_precision"),
    )


def aa_error_rate(
    rows: DataFrame, group: Sequence[str] = ("engine",), target: str = "gt_peptide",
    prediction: str = "peptide",
) -> DataFrame:
    """Edit operations over target residues."""
    t, p = P.to_letter_string(target), P.to_letter_string(prediction)
    return rows.groupBy(*group).agg(
        (F.sum(F.levenshtein(t, F.coalesce(p, F.lit("")))) / F.sum(F.length(t))).alias("aa_error_rate")
    )
