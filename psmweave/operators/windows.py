"""Ranks, selections and neighbours inside spectra.

Selections of the best rows are aggregates (``min`` of a struct joined back), so
one spectrum with very many candidates is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.operators.joins import KEY
from psmweave.operators.running import attach_group_values, rank_rows


def rank_in_spectrum(psms: DataFrame, score: str = "score", key: Sequence[str] = tuple(KEY), **kw):
    """Dense rank by descending score."""
    return rank_rows(psms, list(key), [(score, False)], "dense", **kw)


def top_k(
    psms: DataFrame, k: int, key: Sequence[str], order: Sequence[tuple[str, bool]]
) -> DataFrame:
    """The best ``k`` rows per key.

    ``row_number() <= k`` lets Spark prune to k rows per key before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(
        *[F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    )
    return psms.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def rerank(
    psms: DataFrame, score: str, engines: Sequence[str], name: str, ties: Sequence[str], **kw
) -> DataFrame:
    """New 0-based order of the chosen engines' PSMs by another score."""
    some = psms.filter(F.col("engine").isin(list(engines)))
    order = [(score, False)] + [(t, True) for t in ties]
    return rank_rows(some, list(KEY), order, "first", name, **kw).withColumn(name, F.col(name) - 1)


def rank_of_truth(
    candidates: DataFrame,
    scores: Sequence[str],
    match_types: Sequence[str] = ("match",),
    key: Sequence[str] = tuple(KEY),
) -> DataFrame:
    """Rank of the ground truth for each score.

    Ground truth (``is_gt``) and equivalent candidates collapse to their column-wise
    maximum; ties go to it.  -1 when a spectrum has no such row.
    """
    key = list(key)
    hit = F.coalesce(F.col("is_gt"), F.lit(False)) | F.col("error_type").isin(list(match_types))
    rows = attach_group_values(
        candidates,
        key,
        {
            "_hits": F.count(F.when(hit, 1)),
            **{f"_best_{s}": F.max(F.when(hit, F.col(s))) for s in scores},
        },
    )
    above = [
        F.count(F.when(~hit & (F.col(s) > F.col(f"_best_{s}")), 1)).alias(f"_above_{s}")
        for s in scores
    ]
    out = (
        rows.groupBy(*key)
        .agg(F.max("_hits").alias("_hits"), *[F.max(f"_best_{s}").alias(f"_best_{s}") for s in scores], *above)
    )
    return out.select(
        *key,
        *[
            F.when((F.col("_hits") > 0) & F.col(f"_best_{s}").isNotNull(), F.col(f"_above_{s}") + 1)
            .otherwise(F.lit(-1))
            .alias(f"rank_{s}")
            for s in scores
        ],
    )


def second_rank_gap(
    psms: DataFrame, key: Sequence[str], score: str = "score", cap: float = 20.0
) -> DataFrame:
    """Best minus second-best score, capped; null with a single candidate."""
    first = F.max(F.when(F.col("rank") == 1, F.col(score)))
    second = F.max(F.when(F.col("rank") == 2, F.col(score)))
    return psms.groupBy(*key).agg((first - second).alias("gap")).withColumn(
        "gap", F.when(F.col("gap") > cap, F.lit(cap)).otherwise(F.col("gap"))
    )


def share_in_group(counts: DataFrame, group: Sequence[str], value: str = "n") -> DataFrame:
    """Value divided by its group's total (W9); ``counts`` is already aggregated."""
    rows = attach_group_values(counts, list(group), {"_t": F.sum(value)})
    return rows.withColumn(
        "share", F.when(F.col("_t") != 0, F.col(value) / F.col("_t"))
    ).drop("_t")


def gaps_islands(sites: DataFrame, key: Sequence[str], site: str = "site", seen: str = "seen"):
    """Maximal runs of unobserved sites as (start, end).

    Position minus rank is constant inside a run.
    """
    missing = rank_rows(sites.filter(~F.col(seen)), list(key), [(site, True)], "first", "_rn")
    return (
        missing.withColumn("_run", F.col(site) - F.col("_rn"))
        .groupBy(*key, "_run")
        .agg(F.min(site).alias("start"), F.max(site).alias("end"))
        .drop("_run")
    )


def optimal_set(
    evaluated: DataFrame,
    score: str = "score",
    key: Sequence[str] = tuple(KEY),
    order: Sequence[str] = tuple(K.SELECTION_ORDER),
) -> DataFrame:
    """Per spectrum the first non-empty class; inside it the top-scoring peptide's PSMs.

    All matches are kept.  Score ties go to the smaller (engine, peptide).
    """
    key = list(key)
    index = F.element_at(
        F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)]), F.col("error_type")
    )
    rows = evaluated.withColumn("_class", index).filter("_class IS NOT NULL")
    first = F.min(F.struct("_class", (-F.col(score)).alias("neg"), "engine", "peptide"))
    same = (F.col("_class") == 0) | (F.col("peptide") == F.col("_b.peptide"))
    return (
        attach_group_values(rows, key, {"_b": first})
        .filter((F.col("_class") == F.col("_b._class")) & same)
        .drop("_class", "_b")
    )


def tool_selection_counts(selected: DataFrame, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """How often each tool is in the optimal set, by class."""
    return (
        selected.select(*key, "engine", "error_type")
        .distinct()
        .groupBy("engine", "error_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def paired_only(rows: DataFrame, key: Sequence[str] = tuple(KEY), size: int = 2) -> DataFrame:
    """Rows of spectra that have exactly ``size`` rows."""
    counted = attach_group_values(rows, list(key), {"_n": F.count(F.lit(1))})
    return counted.filter(F.col("_n") == size).drop("_n")


def mask_duplicates(
    fragments: DataFrame,
    key: Sequence[str],
    mz: str,
    preference: Column,
    ties: Sequence[str] = ("ion_index",),
) -> DataFrame:
    """Of fragments with equal m/z keep the preferred one.

    The kept row per (key, m/z) comes from ``min`` over the preference, before any sort.
    """
    rest = [c for c in fragments.columns if c not in (*key, mz)]
    picked = fragments.groupBy(*key, mz).agg(
        F.min(F.struct(preference.alias("_by"), *[F.col(t).alias(f"_t_{t}") for t in ties], *rest)).alias("_p")
    )
    return picked.select(*key, mz, *[F.col(f"_p.{c}").alias(c) for c in rest]).select(
        *fragments.columns
    )


def best_annotation(
    annotations: DataFrame, key: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """One annotation per peak: backbone before neutral loss, then smallest |delta|.

    The reference compares the absolute with the signed error; here both are absolute.
    ``order`` replaces the default preference.
    """
    if order is None:
        order = [F.col("neutral_loss") != "", F.abs("delta"), F.col("ion_type"), F.col("ion_index")]
    rest = [c for c in annotations.columns if c not in key]
    prefs = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    picked = annotations.groupBy(*key).agg(F.min(F.struct(*prefs, *rest)).alias("_p"))
    return picked.select(*key, *[F.col(f"_p.{c}").alias(c) for c in rest])


def sample_per_group(
    rows: DataFrame, key: Sequence[str], n: int, identity: Sequence[str], seed: int = 0
) -> DataFrame:
    """Up to ``n`` rows per group in the order of a seeded MD5 (T4); repeatable on any cluster and engine."""
    h = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])))
    order = [("_h", True)] + [(c, True) for c in identity]
    return top_k(h, n, key, order).drop("_h")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
