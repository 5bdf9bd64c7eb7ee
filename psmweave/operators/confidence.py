"""Score models and target-decoy confidence (M)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave.operators.joins import KEY
from psmweave.operators.mixtures import Mixture, fit_mixtures
from psmweave.operators.running import running
from psmweave.operators.training import Trainer, begin, fit_all, in_blocks, scales, select_anew
from psmweave.runtime import checkpoint

# -- Gaussian mixtures ---------------------------------------------------------------


@dataclass
class TwoGaussians:
    """Parameters of a two-component mixture, the lower mean first."""

    mean: tuple[float, float]
    std: tuple[float, float]
    weight: tuple[float, float]


def _two(m: Mixture) -> TwoGaussians:
    return TwoGaussians(m.means, tuple(math.sqrt(v) for v in m.variances), m.weights)


_PARAMETERS = [f"{name}_{side}" for name in ("mean", "std", "weight") for side in ("low", "high")]


def mark_clusters(df: DataFrame, params: dict[str, TwoGaussians], score: str = "score", group: str = "engine") -> DataFrame:
    """Mark rows with 1 where the component that the group's highest score belongs to is likelier, else 0.

    The parameters of the row's group, one row per group, are added as columns. Rows of a group without
    parameters, and rows without a score (null or no number), get no mark.
    """
    rows = [(g, *p.mean, *p.std, *p.weight) for g, p in params.items()]
    kinds = ", ".join(["_g string", *(f"{c} double" for c in _PARAMETERS)])
    table = df.sparkSession.createDataFrame(rows, kinds)

    def likelihood(x: Column, side: str) -> Column:
        away = (x - F.col(f"mean_{side}")) / F.col(f"std_{side}")
        return F.log(f"weight_{side}") - F.log(f"std_{side}") - away * away / 2

    def upper(x: Column) -> Column:
        return likelihood(x, "high") > likelihood(x, "low")

    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    top = df.groupBy(F.col(group).cast("string").alias("_of")).agg(F.max(value).alias("_top"))
    known = table.join(top, F.col("_g") == F.col("_of"), "left").withColumn("_side", upper(F.col("_top"))).drop("_of", "_top")
    marked = df.join(F.broadcast(known), F.col(group).cast("string") == F.col("_g"), "left")  # one row per group
    cluster = (upper(value) == F.col("_side")).cast("int")
    return marked.select(*[df[c] for c in df.columns], cluster.alias("gmm_cluster"), *_PARAMETERS)


def gmm_by_engine(df: DataFrame, score: str = "score", group: str = "engine") -> DataFrame:
    """Mark rows with the higher (1) or lower (0) of two score components of their engine (M1).

    The mixtures of all engines are fitted in the same passes, until they converge.
    """
    fitted = fit_mixtures(df, group, score)
    return mark_clusters(df, {g: _two(m) for (g, _), m in fitted.items()}, score, group)


def gmm_clusters(df: DataFrame, score: str = "score") -> tuple[DataFrame, TwoGaussians]:
    """:func:`gmm_by_engine` of all rows together, and the parameters."""
    params = fit_two(df, score)
    marked = mark_clusters(df.withColumn("_all", F.lit("")), {"": params}, score, "_all")
    return marked.select(*[marked[c] for c in df.columns], "gmm_cluster"), params


def fit_two(df: DataFrame, score: str = "score") -> TwoGaussians:
    """The mixture of two components of all rows."""
    return _two(fit_mixtures(df, None, score)[("", 2)])


def gmm_summary(marked: DataFrame, score: str = "score") -> DataFrame:
    """Sizes, cutoff and parameters per engine (M1).

    The cutoff lies halfway between the lowest accepted and the highest rejected score.
    """
    one = F.col("gmm_cluster") == 1
    return marked.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(F.when(one, 1)).alias("n_accepted"),
        F.count(F.when(~one, 1)).alias("n_filtered"),
        ((F.min(F.when(one, F.col(score))) + F.max(F.when(~one, F.col(score)))) / 2).alias("cutoff"),
        *[F.first(c).alias(c) for c in _PARAMETERS],
    )


def filter_gmm(marked: DataFrame, keep: int = 1) -> DataFrame:
    return marked.filter(F.col("gmm_cluster") == keep)


def gmm_bic(df: DataFrame, score: str = "score", max_components: int = 10) -> DataFrame:
    """BIC for 1..max_components components, the best one marked (M2); all are fitted in the same passes."""
    fitted = fit_mixtures(df, None, score, range(1, max_components + 1))
    rows = [(k, m.bic, m.passes) for (_, k), m in sorted(fitted.items())]
    best = min(rows, key=lambda r: (r[1], r[0]))[0] if rows else None
    return df.sparkSession.createDataFrame(
        [(k, bic, passes, k == best) for k, bic, passes in rows], "components int, bic double, passes int, best boolean"
    )


def gmm_fdr_threshold(params: TwoGaussians, fdr: float = 0.01) -> float | None:
    """Score where the low component's right tail is ``fdr`` of the high component's left part (M3).

    Bisection over six numbers; None when the bracket holds no root.
    """

    def cdf(x: float, i: int) -> float:
        return 0.5 * math.erfc(-(x - params.mean[i]) / (params.std[i] * math.sqrt(2)))

    def f(t: float) -> float:
        return params.weight[0] * (1 - cdf(t, 0)) - fdr * params.weight[1] * cdf(t, 1)

    lo, hi = params.mean[0] - 3, params.mean[1] + 3
    if f(lo) * f(hi) > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(lo) * f(mid) <= 0:
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


# -- target-decoy confidence ------------------------------------------------------------


def q_values(
    df: DataFrame,
    score: str = "score",
    decoy: str = "is_decoy",
    group: Sequence[str] = (),
    strategy: str = "auto",
) -> DataFrame:
    """Target-decoy q-value of every row (M6).

    fdr = (decoys + 1) / targets at or above the score; the q-value is the smallest fdr
    at or below it, at most 1.  Equal scores share one value.  A row without a score counts
    nowhere and has no q-value.
    """
    group = list(group)
    levels = df.filter(F.col(score).isNotNull()).groupBy(*group, score).agg(
        F.count(F.when(~F.col(decoy), 1)).alias("_t"), F.count(F.when(F.col(decoy), 1)).alias("_d")
    )
    acc = running(
        levels, group, [(score, False)], {"_ct": ("sum", "_t"), "_cd": ("sum", "_d")}, True, strategy
    )
    acc = acc.withColumn(
        "_fdr",
        F.when(F.col("_ct") > 0, (F.col("_cd") + 1) / F.col("_ct")).otherwise(F.lit(1.0)),
    )
    q = running(acc, group, [(score, True)], {"_q": ("min", "_fdr")}, True, strategy)
    q = q.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*group, score]], F.least(F.col("_q"), F.lit(1.0)).alias("qvalue")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group] + [F.col(score) == F.col(f"_of_{score}")]
    rows = df.drop("qvalue")
    return rows.join(q, reduce(Column.__and__, same), "left").select(*rows.columns, "qvalue")


def peptide_q_values(
    df: DataFrame, peptide: str = "peptide", score: str = "score", decoy: str = "is_decoy", **kw
) -> DataFrame:
    """q-values over the best PSM of each peptide (M6)."""
    best = df.groupBy(peptide, decoy).agg(F.max(score).alias(score))
    return q_values(best, score, decoy, **kw)


# -- semi-supervised rescoring --------------------------------------------------------------


@dataclass
class FoldModels:
    """One linear model per fold on the features' own scale, and the weights on their common scale."""

    features: list[str]
    coefficients: list[list[float]]
    intercepts: list[float]
    weights: list[list[float]]

    def score(self, fold: int) -> Column:
        terms = [F.lit(c) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients[fold])]
        return reduce(Column.__add__, terms, F.lit(self.intercepts[fold]))

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table with one row per fold and feature, and one per intercept."""
        rows = [
            (fold, f, c, w)
            for fold, (cs, ws) in enumerate(zip(self.coefficients, self.weights))
            for f, c, w in zip(self.features, cs, ws)
        ]
        rows += [(fold, None, b, None) for fold, b in enumerate(self.intercepts)]
        table = spark.createDataFrame(rows, "fold int, feature string, coefficient double, weight double")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, features: Sequence[str]) -> FoldModels:
        rows = spark.read.parquet(path).collect()  # folds x (features + 1) rows
        known = {(r.fold, r.feature): r for r in rows}
        folds = range(1 + max(r.fold for r in rows))
        return FoldModels(
            list(features),
            [[known[fold, f].coefficient for f in features] for fold in folds],
            [known[fold, None].coefficient for fold in folds],
            [[known[fold, f].weight for f in features] for fold in folds],
        )


def with_fold(df: DataFrame, key: Sequence[str] = tuple(KEY), folds: int = 3, seed: int = 8):
    """Fold by a hash of the spectrum, so all its PSMs stay together."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)))


def train_sets(
    df: DataFrame,
    subsets: dict[str, Sequence[str]],
    decoy: str = "is_decoy",
    key: Sequence[str] = tuple(KEY),
    folds: int = 3,
    train_fdr: float = 0.01,
    rounds: int = 3,
    iterations: int = 20,
    seed: int = 8,
) -> dict[str, FoldModels]:
    """Linear models that separate confident targets from decoys, for every feature set and fold at once (M4, M7).

    Each model trains on the other folds, on rows that have all its features. It starts from the single
    feature (either direction) that accepts most targets at ``train_fdr`` and selects its confident targets
    anew in every round. A pass over the rows returns the sums that one step of all models needs.
    """
    every = sorted({f for features in subsets.values() for f in features})
    rows = df.select(*key, F.col(decoy).alias("is_decoy"), *[F.col(f).cast("double").alias(f) for f in every])
    base = checkpoint(with_fold(rows, key, folds, seed).select("fold", "is_decoy", *every).filter("is_decoy IS NOT NULL"))
    scale = scales(base, subsets, folds)
    trainers = {
        (name, fold): Trainer(fold, tuple(every.index(f) for f in features), *scale[name, fold])
        for name, features in subsets.items()
        for fold in range(folds)
    }
    blocks = checkpoint(in_blocks(base))
    begin(blocks, trainers, train_fdr)
    for done in range(rounds):
        if done:
            select_anew(blocks, trainers, train_fdr)
        fit_all(blocks, trainers, iterations)
    return {
        name: FoldModels(list(features), *map(list, zip(*(trainers[name, fold].on_raw_scale() for fold in range(folds)))))
        for name, features in subsets.items()
    }


def rescoring_train(df: DataFrame, features: Sequence[str], decoy: str = "is_decoy", key: Sequence[str] = tuple(KEY), **options):
    """:func:`train_sets` for one set of features (M4)."""
    return train_sets(df, {"all": list(features)}, decoy, key, **options)["all"]


def rescoring_apply(df: DataFrame, models: FoldModels, name: str = "score_rescored") -> DataFrame:
    """Mean score of the fold models (M5); the same models score every engine."""
    total = reduce(Column.__add__, [models.score(fold) for fold in range(len(models.intercepts))])
    return df.withColumn(name, total / len(models.intercepts))


def coefficient_summary(models: FoldModels, spark) -> DataFrame:
    """Mean weight per feature over the folds, on the features' common scale (M8)."""
    rows = [(fold, f, w) for fold, ws in enumerate(models.weights) for f, w in zip(models.features, ws)]
    table = spark.createDataFrame(rows, "fold int, feature string, coefficient double")
    return table.groupBy("feature").agg(
        F.avg("coefficient").alias("mean_coefficient"), F.stddev_samp("coefficient").alias("sd")
    )


def accepted_by_models(
    df: DataFrame, models: dict[str, FoldModels], decoy: str = "is_decoy", cutoff: float = 0.01
) -> DataFrame:
    """Accepted and rejected targets, and decoys, per set of models (M7).

    Rows count where they have all features of the set. All sets are scored in one pass.
    """
    sets = [
        F.struct(
            F.lit(name).alias("features"),
            (reduce(Column.__add__, [m.score(fold) for fold in range(len(m.intercepts))]) / len(m.intercepts)).alias("score"),
        )
        for name, m in models.items()
    ]
    scores = df.select(F.col(decoy).alias("is_decoy"), F.inline(F.array(*sets))).filter("score IS NOT NULL AND NOT isnan(score)")
    levels = scores.groupBy("features", "score").agg(
        F.count(F.when(~F.col("is_decoy"), 1)).alias("_t"), F.count(F.when(F.col("is_decoy"), 1)).alias("_d")
    )
    acc = running(levels, ["features"], [("score", False)], {"_ct": ("sum", "_t"), "_cd": ("sum", "_d")}, True, "split")
    below = (F.col("_ct") > 0) & ((F.col("_cd") + 1) / F.greatest("_ct", F.lit(1)) < cutoff)
    total = acc.groupBy("features").agg(
        F.sum("_d").alias("decoy"), F.sum("_t").alias("targets"),
        F.coalesce(F.max(F.when(below, F.col("_ct"))), F.lit(0)).cast("long").alias("target_accepted"),
    )
    counts = F.create_map(
        F.lit("decoy"), F.col("decoy"), F.lit("target_accepted"), F.col("target_accepted"),
        F.lit("target_rejected"), F.col("targets") - F.col("target_accepted"),
    )
    return total.select("features", F.explode(counts).alias("psm_type", "n")).filter("n > 0")


def feature_subset_ablation(
    df: DataFrame,
    subsets: dict[str, Sequence[str]],
    decoy: str = "is_decoy",
    key: Sequence[str] = tuple(KEY),
    cutoff: float = 0.01,
    **options,
) -> DataFrame:
    """Accepted and rejected targets after training on each feature set (M7); all models train together."""
    return accepted_by_models(df, train_sets(df, subsets, decoy, key, **options), decoy, cutoff)
