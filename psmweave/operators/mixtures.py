"""Gaussian mixtures of scores, for all groups and numbers of components at once (M1-M3).

The rows are collapsed to their distinct scores per group, with counts. Every pass over them runs one
expectation step of all mixtures that haven't converged and returns six sums per component; the
maximisation is arithmetic on those. Passes end when no mean log-likelihood moves by ``TOL`` any more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.runtime import checkpoint

MAX_PASSES = 1000
TOL = 1e-3

#: Added to every variance, so that a component on a single score keeps a width.
LEAST_VARIANCE = 1e-6
_LEAST_COUNT = 10 * 2.220446049250313e-16


@dataclass(frozen=True)
class Mixture:
    """Weights, means and variances in the order of the means, and the log-likelihood of the rows."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    variances: tuple[float, ...]
    n: int
    log_likelihood: float = -math.inf
    passes: int = 0

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + (3 * len(self.means) - 1) * math.log(self.n)


def start(k: int, n: int, mean: float, variance: float) -> Mixture:
    """Components at the quantiles of the normal distribution with the group's mean and variance."""
    places = [NormalDist().inv_cdf((j + 0.5) / k) for j in range(k)]
    means = tuple(mean + z * math.sqrt(variance) for z in places)
    return Mixture((1 / k,) * k, means, (variance / k + LEAST_VARIANCE,) * k, n)


def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    """One row per score, one column per component, weights included."""
    weights, means, variances = (np.array(v) for v in (m.weights, m.means, m.variances))
    with np.errstate(divide="ignore"):
        logs = np.log(weights)
    return logs - 0.5 * (np.log(2 * math.pi * variances) + (x[:, None] - means) ** 2 / variances)


def expectation(x: np.ndarray, w: np.ndarray, m: Mixture) -> np.ndarray:
    """Per component: count, sum and sum of squares (from its mean); in the last row the log-likelihood."""
    logs = log_densities(x, m)
    top = logs.max(axis=1)
    whole = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
    share = np.exp(logs - whole[:, None]) * w[:, None]
    apart = x[:, None] - np.array(m.means)
    sums = np.stack([share.sum(axis=0), (share * apart).sum(axis=0), (share * apart**2).sum(axis=0)])
    return np.concatenate([sums, np.full((1, len(m.means)), float((w * whole).sum()))])


def maximised(m: Mixture, sums: np.ndarray) -> Mixture:
    count = sums[0] + _LEAST_COUNT
    moved = sums[1] / count
    variances = np.maximum(sums[2] / count - moved**2, 0) + LEAST_VARIANCE
    means = np.array(m.means) + moved
    weights = count / count.sum()
    return Mixture(*(tuple(v.tolist()) for v in (weights, means, variances)), m.n, float(sums[3, 0]), m.passes + 1)


def _steps(models: dict[tuple[str, int], Mixture]):
    """Sums of all scores of a task: one row per mixture and component."""
    groups = sorted({g for g, _ in models})
    kinds = pa.schema([("g", pa.string()), ("k", pa.int32()), ("part", pa.int32()), ("row", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: np.zeros((4, key[1])) for key in models}
        for batch in batches:
            of, x, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for g in groups:
                here = of == g
                if here.any():
                    for key in total:
                        if key[0] == g:
                            total[key] += expectation(x[here], w[here], models[key])
        rows = [(*key, j, i, float(v)) for key, t in total.items() for i, line in enumerate(t) for j, v in enumerate(line)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return run


def fit_mixtures(
    df: DataFrame, group: str | None = "engine", score: str = "score", components: Sequence[int] = (2,),
    max_passes: int = MAX_PASSES, tol: float = TOL,
) -> dict[tuple[str, int], Mixture]:
    """A converged mixture per group and number of components; one key, ``''``, without a group.

    Rows without a score or group, and scores that are no numbers, count nowhere. There are as many
    results as groups, so a group should be something like an engine.
    """
    of = F.lit("") if group is None else F.col(group).cast("string")
    rows = df.select(of.alias("g"), F.col(score).cast("double").alias("x")).filter("g IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    levels = checkpoint(rows.groupBy("g", "x").agg(F.count(F.lit(1)).cast("double").alias("w")))
    whole = levels.groupBy("g").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mean")).collect()
    mean = F.create_map(*[F.lit(v) for r in whole for v in (r.g, r["mean"])]) if whole else F.lit(0.0)
    away = (F.col("x") - F.element_at(mean, F.col("g"))) if whole else F.col("x")
    spread = dict(levels.groupBy("g").agg(F.sum(F.col("w") * away * away) / F.sum("w")).collect())
    open_ = {(r.g, k): start(k, int(r.n), r["mean"], spread[r.g]) for r in whole for k in components}
    done: dict[tuple[str, int], Mixture] = {}
    while open_:
        sums = levels.mapInArrow(_steps(open_), "g string, k int, part int, row int, value double")
        total = {key: np.zeros((4, key[1])) for key in open_}
        for r in sums.groupBy("g", "k", "part", "row").agg(F.sum("value").alias("value")).collect():  # four per component
            total[(r.g, r.k)][r.row, r.part] = r.value
        for key, m in list(open_.items()):
            new = maximised(m, total[key])
            if abs(new.log_likelihood - m.log_likelihood) < tol * m.n or new.passes >= max_passes:
                done[key] = _sorted(Mixture(m.weights, m.means, m.variances, m.n, new.log_likelihood, new.passes))
                del open_[key]
            else:
                open_[key] = new
    return done


def _sorted(m: Mixture) -> Mixture:
    order = sorted(range(len(m.means)), key=lambda j: (m.means[j], m.variances[j]))
    return Mixture(*(tuple(v[j] for j in order) for v in (m.weights, m.means, m.variances)), m.n, m.log_likelihood, m.passes)
