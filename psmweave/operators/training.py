"""Joint training of linear models with a squared hinge loss (M4, M7).

All models of a pass see the same rows. A model's next weights solve a small linear system whose sums run
over the rows that its present weights leave inside the margin (a finite Newton step); it has converged
when they no longer change its loss. Sums are added up per task, so a pass returns a few numbers per model.

Passes read blocks: the rows of one fold, some thousands at a time, with flags and features as bytes. A block
goes through Python as one row, and a model works on its columns as they lie there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psmweave.operators.running import running

REGULARISATION = 0.01
TOL = 1e-6
#: Least rows of a block (but for a task's last ones); bytes of one batch of blocks on its way to Python.
BLOCK = 16_384
_BATCH_BYTES = 8 << 20

Which = tuple[str, int]
Scores = tuple[int, np.ndarray, np.ndarray]


@dataclass
class Trainer:
    """One model while it is trained: fold, places of its features, their scale, how it selects, its weights."""

    fold: int
    places: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    chooser: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cut: float = np.inf
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    settled: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        """Scaled features and a constant, one feature after the other."""
        z = np.ones((len(self.places) + 1, x.shape[1]))
        for k, place in enumerate(self.places):
            np.subtract(x[place], self.mean[k], out=z[k])
            z[k] /= self.scale[k]
        return z

    def select_by(self, cut: float | None) -> None:
        """From now on targets from ``cut`` on, by the present weights, are the confident ones."""
        self.chooser, self.cut = self.weights, np.inf if cut is None else cut

    def on_raw_scale(self) -> tuple[list[float], float, list[float]]:
        raw = self.weights[:-1] / self.scale
        return raw.tolist(), float(self.weights[-1] - raw @ self.mean), self.weights[:-1].tolist()


def weighed(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of design columns, summed in one order so that a row's score never depends on its block."""
    total = z[0] * weights[0]
    for column, w in zip(z[1:], weights[1:]):
        total += column * w
    return total


def training_rows(t: Trainer, fold: int, decoy: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Design columns and decoy flags of a block's rows that have all features of a model, unless it leaves them out."""
    if fold == t.fold:
        return None
    gaps = np.isnan(x[list(t.places)].sum(axis=0))
    if gaps.any():
        gaps = np.isnan(x[list(t.places)]).any(axis=0)
        decoy, x = decoy[~gaps], x[:, ~gaps]
    return t.design(x), decoy


def step_sums(t: Trainer, z: np.ndarray, decoy: np.ndarray) -> np.ndarray:
    """What a step needs of some rows, flat: sums of products, of products with labels, loss, number of rows.

    A model trains on decoys and on the targets that its chooser accepts.
    """
    use = decoy | (weighed(z, t.chooser) >= t.cut)
    y = np.where(decoy, -1.0, 1.0)
    gap = 1 - y * weighed(z, t.weights)
    a = np.flatnonzero(use & (gap > 0))
    inside, y, gap = z[:, a], y[a], gap[a]
    return np.concatenate([(inside @ inside.T).ravel(), inside @ y, [float(gap @ gap), float(np.count_nonzero(use))]])


def advance(t: Trainer, sums: np.ndarray) -> None:
    """Take the Newton step, or half of the last one where it made the loss larger."""
    d = len(t.places) + 1
    n = max(sums[-1], 1.0)
    penalty = np.full(d, REGULARISATION)
    penalty[-1] = 1e-9  # the constant isn't held back
    loss = sums[-2] / n + float(penalty @ t.weights**2)
    if loss > t.loss * (1 + 1e-12) and np.abs(t.step).max() > 1e-9:
        t.step = t.step / 2
        t.weights = t.weights - t.step
        return
    if abs(t.loss - loss) <= TOL * max(loss, 1e-12):
        t.settled = True
        return
    t.loss = loss
    target = np.linalg.solve(sums[: d * d].reshape(d, d) / n + np.diag(penalty), sums[d * d : d * d + d] / n)
    t.step = target - t.weights
    t.weights = target


_SUMS = pa.schema([("set", pa.string()), ("fold", pa.int32()), ("place", pa.int32()), ("value", pa.float64())])
_SUMS_DDL = "set string, fold int, place int, value double"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with NaN for nulls, decoy flags and folds of ``fold, is_decoy, features...``."""
    fold, decoy = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
    x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
    return x, decoy.astype(bool), fold


_BLOCKS = pa.schema([("fold", pa.int32()), ("decoy", pa.binary()), ("x", pa.binary())])


def in_blocks(base: DataFrame) -> DataFrame:
    """``fold, is_decoy, features...`` as blocks of one fold each (see the module)."""

    def block(fold: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        decoy, x = (np.concatenate(p, axis=-1) for p in zip(*parts))
        columns = [pa.array([v], f.type) for v, f in zip((fold, decoy.tobytes(), x.tobytes()), _BLOCKS)]
        return pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            x, decoy, fold = _columns(batch)
            for f in np.unique(fold).tolist():
                here = fold == f
                held.setdefault(f, []).append((decoy[here], x[:, here]))
                if sum(len(part[0]) for part in held[f]) >= BLOCK:
                    yield block(f, held.pop(f))
        for f, parts in held.items():
            yield block(f, parts)

    return base.mapInArrow(run, "fold int, decoy binary, x binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Fold, decoy flags and features (one after the other) of every block."""
    for batch in batches:
        for fold, decoy, x in zip(*(c for c in batch.columns)):
            flags = np.frombuffer(decoy.as_buffer(), bool)
            yield fold.as_py(), flags, np.frombuffer(x.as_buffer(), np.float64).reshape(-1, len(flags))


def _map_blocks(blocks: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``run`` over blocks in batches of bounded bytes; a session with a lower bound of its own keeps it."""
    conf, name = blocks.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if now.rstrip("b").lstrip("-").isdigit() and not 0 < int(now.rstrip("b")) <= _BATCH_BYTES:
        conf.set(name, f"{_BATCH_BYTES}b")
    return blocks.mapInArrow(run, ddl)


def fit_all(blocks: DataFrame, trainers: dict[Which, Trainer], iterations: int) -> None:
    """Newton steps of all models until each has settled or ``iterations`` passes are over."""
    for t in trainers.values():
        t.weights, t.step, t.loss, t.settled = np.zeros(len(t.places) + 1), np.zeros(1), np.inf, False
    for _ in range(iterations):
        open_ = {which: t for which, t in trainers.items() if not t.settled}
        if not open_:
            break

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {which: 0.0 for which in open_}
            for fold, decoy, x in _blocks(batches):
                for which, t in open_.items():
                    rows = training_rows(t, fold, decoy, x)
                    if rows is not None:
                        total[which] = total[which] + step_sums(t, *rows)
            rows = [(*which, k, float(v)) for which, s in total.items() if np.ndim(s) for k, v in enumerate(s)]
            columns = zip(*rows) if rows else [()] * len(_SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)

        sums = _map_blocks(blocks, run, _SUMS_DDL).groupBy("set", "fold", "place").agg(F.sum("value").alias("value"))
        found: dict[Which, np.ndarray] = {w: np.zeros((len(t.places) + 1) * (len(t.places) + 2) + 2) for w, t in open_.items()}
        for r in sums.collect():  # (features + 1) x (features + 2) + 2 numbers per model
            found[r["set"], r.fold][r.place] = r.value
        for which, t in open_.items():
            advance(t, found[which])


def scales(base: DataFrame, subsets: dict[str, Sequence[str]], folds: int) -> dict[Which, tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of every set's features over the rows that train its models, from sums per fold."""
    aggs = []
    for name, features in subsets.items():
        whole = F.lit(True)
        for f in features:
            whole = whole & F.col(f).isNotNull() & ~F.isnan(f)
        aggs.append(F.count(F.when(whole, 1)).alias(f"{name}|n"))
        for k, f in enumerate(features):
            aggs.append(F.avg(F.when(whole, F.col(f))).alias(f"{name}|{k}|m"))
            aggs.append(F.var_pop(F.when(whole, F.col(f))).alias(f"{name}|{k}|v"))
    rows = {r.fold: r for r in base.groupBy("fold").agg(*aggs).collect()}  # one row per fold
    out = {}
    for name, features in subsets.items():
        for fold in range(folds):
            parts = [r for f, r in rows.items() if f != fold and r[f"{name}|n"]]
            n = np.array([r[f"{name}|n"] for r in parts], float)
            m = np.array([[r[f"{name}|{k}|m"] for k in range(len(features))] for r in parts]).reshape(len(parts), -1)
            v = np.array([[r[f"{name}|{k}|v"] for k in range(len(features))] for r in parts]).reshape(len(parts), -1)
            total = max(n.sum(), 1.0)
            mean = (n @ m) / total if len(parts) else np.zeros(len(features))
            var = (n @ (v + (m - mean) ** 2)) / total if len(parts) else np.ones(len(features))
            out[name, fold] = mean, np.where(var > 0, np.sqrt(np.maximum(var, 0)), 1.0)
    return out


# -- cuts at a false discovery rate ---------------------------------------------------------


def _bins(scores: np.ndarray) -> np.ndarray:
    """Numbers in the order of the scores, about a thousand for each power of two."""
    bits = (scores + 0.0).view(np.int64)  # one zero
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 42


def _counted(keys: np.ndarray, t: np.ndarray, d: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums and least value per key."""
    found, at = np.unique(keys, return_inverse=True)
    least = np.full(len(found), np.inf)
    np.minimum.at(least, at, low)
    return found, np.bincount(at, t, len(found)), np.bincount(at, d, len(found)), least


_LEVELS = pa.schema([("no", pa.int32()), ("bin", pa.int64()), ("score", pa.float64()), ("t", pa.int64()), ("d", pa.int64())])
_LEVELS_DDL = "no int, bin long, score double, t long, d long"


def _levels(blocks: DataFrame, scores: Callable[..., Iterator[Scores]], only: dict[int, np.ndarray] | None) -> DataFrame:
    """``no, bin, score, t, d``: targets and decoys per bin with its least score, or per score of the bins in ``only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, ...]] = {}
        for block in _blocks(batches):
            for no, score, decoy in scores(*block):
                keep = ~np.isnan(score)
                if only is not None:
                    keep &= np.isin(_bins(score), only.get(no, np.zeros(0, np.int64)))
                score, flags = score[keep] + 0.0, decoy[keep].astype(float)
                new = _counted(_bins(score) if only is None else score, 1 - flags, flags, score)
                if only is None:
                    held = total.get(no)
                    total[no] = new if held is None else _counted(*(np.concatenate(p) for p in zip(held, new)))
                elif len(score):
                    yield table(no, new)
        for no, counts in total.items():
            yield table(no, counts)

    def table(no: int, counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, t, d, low = counts
        values = np.full(len(low), no, np.int32), _bins(low), low, t.astype(np.int64), d.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], schema=_LEVELS)

    parts = _map_blocks(blocks, run, _LEVELS_DDL)
    by = ["no", "bin"] if only is None else ["no", "bin", "score"]
    least = [F.min("score").alias("score")] if only is None else []
    return parts.groupBy(*by).agg(*least, F.sum("t").alias("t"), F.sum("d").alias("d"))


def accepted_from(blocks: DataFrame, scores: Callable[..., Iterator[Scores]], fdr: float) -> dict[int, tuple[int, float]]:
    """How many targets are accepted at ``fdr``, and the lowest score from which they are, by number of the scoring.

    ``scores`` gives a block's scores and decoy flags under such numbers; scorings that accept nothing are left out.
    A target's q-value is at most ``fdr`` if a score not above its own has that rate, so the lowest such score is
    the cut. Counts per bin give the rate at each bin's least score. Only bins below the lowest of those that fit can
    hold a lower cut, and only if all their targets without their decoys would fit: of these the single scores
    are counted, by a second pass. So no row gets a q-value, and hardly any row is shuffled.
    """
    down = Window.partitionBy("no").orderBy(F.desc("bin"))  # bins, not rows
    bins = _levels(blocks, scores, None).withColumns({"ct": F.sum("t").over(down), "cd": F.sum("d").over(down)})
    rate = (F.col("cd") + 1) / F.greatest("ct", F.lit(1))
    fits = (F.col("ct") > 0) & (rate <= fdr)
    sure = F.min(F.when(fits, F.col("bin"))).over(Window.partitionBy("no"))
    may = (F.col("ct") > 0) & ((F.col("cd") - F.col("d") + 1) / F.greatest("ct", F.lit(1)) <= fdr)
    rows = bins.withColumn("sure", sure).filter((F.col("bin") == F.col("sure")) | (may & (F.col("bin") < F.coalesce("sure", F.lit(1 << 62)))))
    found: dict[int, tuple[int, float]] = {}
    above: list[tuple[int, int, int, int]] = []
    for r in rows.collect():  # a bin per scoring, and the few that may hold a lower cut
        if r.bin == r.sure:
            found[r.no] = r.ct, r.score
        else:
            above.append((r.no, r.bin, r.ct - r.t, r.cd - r.d))
    if above:
        only = {no: np.array([b for n, b, _, _ in above if n == no], np.int64) for no in {a[0] for a in above}}
        levels = running(_levels(blocks, scores, only), ["no", "bin"], [("score", False)], {"ct": ("sum", "t"), "cd": ("sum", "d")}, True, "split")
        before = blocks.sparkSession.createDataFrame(above, "no int, bin long, above_t long, above_d long")
        levels = levels.join(before, ["no", "bin"]).withColumns({"ct": F.col("ct") + F.col("above_t"), "cd": F.col("cd") + F.col("above_d")})
        for r in levels.filter(fits).groupBy("no").agg(F.min("score").alias("cut"), F.max("ct").alias("n")).collect():
            found[r.no] = r.n, r.cut
    return found


def select_anew(blocks: DataFrame, trainers: dict[Which, Trainer], fdr: float) -> None:
    """Every model chooses by its present weights the targets that they accept among its training rows."""
    models = list(trainers.values())

    def scores(fold: int, decoy: np.ndarray, x: np.ndarray) -> Iterator[Scores]:
        for no, t in enumerate(models):
            rows = training_rows(t, fold, decoy, x)
            if rows is not None:
                yield no, weighed(rows[0], t.weights), rows[1]

    found = accepted_from(blocks, scores, fdr)
    for no, t in enumerate(models):
        t.select_by(found[no][1] if no in found else None)


def begin(blocks: DataFrame, trainers: dict[Which, Trainer], fdr: float) -> None:
    """Let every model choose by the one feature and direction that accepts most targets among its training rows.

    A feature's cut is the same for all sets that hold it, so each is looked for once per fold.
    """
    ways = sorted({(t.fold, p, s) for t in trainers.values() for p in t.places for s in (1, -1)})

    def scores(fold: int, decoy: np.ndarray, x: np.ndarray) -> Iterator[Scores]:
        for no, (held_out, place, sign) in enumerate(ways):
            if fold != held_out:
                yield no, x[place] * sign, decoy

    cuts = accepted_from(blocks, scores, fdr)
    found = {way: cuts[no] for no, way in enumerate(ways) if no in cuts}  # two per feature and fold
    for t in trainers.values():
        options = [(found.get((t.fold, p, s), (0, None)), -k, s) for k, p in enumerate(t.places) for s in (1, -1)]
        (n, cut), k, sign = max(options, key=lambda o: (o[0][0], o[1], o[2]))
        t.chooser = np.zeros(len(t.places) + 1)
        # A feature's own value from its scaled one: sign * (scale * z + mean).
        t.chooser[-k], t.chooser[-1] = sign * t.scale[-k], sign * t.mean[-k]
        t.cut = np.inf if cut is None else cut - 1e-9 * max(1.0, abs(cut))
