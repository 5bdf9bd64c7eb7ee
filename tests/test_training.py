"""Training over blocks of rows, and cuts from counts per bin."""

import numpy as np
import pytest

from psmweave.operators import training as T


def _cut(score, decoy, fdr):
    """By sorting all rows."""
    n, cut = 0, None
    for s in np.unique(score):
        t, d = int((~decoy & (score >= s)).sum()), int((decoy & (score >= s)).sum())
        if t and (d + 1) / t <= fdr and cut is None:
            n, cut = t, s
    return n, cut


@pytest.mark.parametrize("kind", ["smooth", "levels", "signs", "none"])
def test_cut_equals_sorting_and_shuffles_counts_only(spark, kind):
    r = np.random.default_rng(5)
    decoy = r.random(6000) < 0.3
    score = r.normal(np.where(decoy, -1.0, 1.0), 1.0)
    if kind == "levels":
        score = np.round(score, 1)
    if kind == "signs":
        score = score * 1e-3
    if kind == "none":
        decoy[np.argsort(score)[-200:]] = True
    rows = [(k % 3, bool(d), float(s)) for k, (d, s) in enumerate(zip(decoy, score))] + [(0, False, None), (1, True, float("nan"))]
    blocks = T.in_blocks(spark.createDataFrame(rows, "fold int, is_decoy boolean, a double").repartition(5)).localCheckpoint()
    assert all(len(b.x) == 8 * len(b.decoy) for b in blocks.collect())
    found = T.accepted_from(blocks, lambda fold, d, x: iter([(0, x[0], d), (1, x[0] * -1, d)] if fold else [(0, x[0], d)]), 0.05)
    assert found.get(0, (0, None)) == _cut(score, decoy, 0.05)
    some = np.arange(6000) % 3 > 0
    assert found.get(1, (0, None)) == _cut(-score[some], decoy[some], 0.05)
    assert T._levels(blocks, lambda fold, d, x: iter([(0, x[0], d)]), None).count() <= len(np.unique(T._bins(score)))


def test_steps_over_blocks_equal_whole_rows():
    r = np.random.default_rng(6)
    x = r.normal(size=(2, 500))
    x[1, :7] = np.nan
    decoy = r.random(500) < 0.5
    t = T.Trainer(0, (0, 1), np.array([0.5, -0.5]), np.array([2.0, 3.0]), np.array([1.0, 0.5, 0.1]), 0.2, np.array([0.3, 0.2, 0.0]))
    assert T.training_rows(t, 0, decoy, x) is None
    sums = T.step_sums(t, *T.training_rows(t, 1, decoy, x))
    keep = ~np.isnan(x).any(axis=0)
    z = np.column_stack([((x.T - t.mean) / t.scale)[keep], np.ones(keep.sum())])
    use = decoy[keep] | (z @ t.chooser >= t.cut)
    z, y = z[use], np.where(decoy[keep][use], -1.0, 1.0)
    gap = 1 - y * (z @ t.weights)
    a = gap > 0
    want = np.concatenate([(z[a].T @ z[a]).ravel(), z[a].T @ y[a], [(gap[a] ** 2).sum(), len(y)]])
    assert np.allclose(sums, want)
