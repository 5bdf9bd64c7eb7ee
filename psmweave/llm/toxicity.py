"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are its distinct lower-cased words, without punctuation around them, and their
beginnings of four to seven letters, hashed to ``DIMENSIONS`` weights. Of a labelled text that
mentions an identity term a counterfactual is made: every term is swapped for the next of its group.
Training minimises logistic loss + ``l2`` * |w|^2 + ``fairness`` * mean (w . (x - x'))^2, so that the
swap must not change the score and neutral mentions of a group cost nothing. Only features that are more
frequent in toxic texts get a weight, and none below zero: nothing else that a long text says makes up
for an insult.

The classifier is fitted on at most ``MAX_ROWS`` labelled texts, those with the smallest hash of their
id (a documented bound; one task holds their features). Everything else covers all rows. Labels,
language, source and ids are no features.

Defined results: null and empty texts get the score of a text without features; rows without a label
or with a null label don't train; repeated rows train as often as they stand there and get a row each;
without rows of both classes the score is the smoothed rate of the labels seen (1/2 with none); an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 20
MAX_ROWS = 20_000
MIN_TEXTS = 3
FAIRNESS = 10.0
L2 = 1e-5
STEPS = 150
REMEMBERED = 500_000

#: Identity terms in groups whose members stand for each other.
IDENTITY_GROUPS = (
    "men women",
    "man woman",
    "male female",
    "christian muslim jewish hindu buddhist sikh atheist",
    "christians muslims jews hindus buddhists sikhs atheists",
    "black white asian latino hispanic african european arab indigenous",
    "gay lesbian bisexual straight heterosexual homosexual transgender queer",
    "american mexican chinese indian french german spanish italian polish turkish russian",
    "old young elderly",
    "deaf blind disabled",
    "immigrant immigrants refugee refugees migrant migrants",
    "männer frauen",
    "mann frau",
    "hommes femmes",
    "homme femme",
    "hombres mujeres",
    "hombre mujer",
)

SWAP = {
    term: terms[(i + 1) % len(terms)]
    for terms in (group.split() for group in IDENTITY_GROUPS)
    for i, term in enumerate(terms)
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "\"'()[]{}<>.,;:!?*#|$%&~=_-"


def words(text: str) -> set[str]:
    return {w for x in _WORD.findall(text.lower()) if (w := x.strip(_MARKS))}


def features(word: str) -> list[int]:
    """Weights that a distinct word of a text adds up."""
    names = [f"w {word}", *(f"p {word[:n]}" for n in range(4, min(len(word), 8)))]
    return [crc32(n.encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names]


def swapped(found: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in found}


def vector(found: set[str]) -> list[int]:
    return [i for w in found for i in features(w)]


_EXAMPLE = "label int, x array<int>, other array<int>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    for batch in batches:
        found = [words(t or "") for t in batch.column(1).to_pylist()]
        x = [vector(w) for w in found]
        other = [vector(o) if (o := swapped(w)) != w else [] for w in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int32()), pa.array(x, ints), pa.array(other, ints)], names=["label", "x", "other"]
        )


def fit(
    labels: np.ndarray,
    x: list[np.ndarray],
    other: list[np.ndarray],
    fairness: float = FAIRNESS,
    l2: float = L2,
    steps: int = STEPS,
    min_texts: int = MIN_TEXTS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights and the intercept; ``other[i]`` is empty where no term occurs."""
    n, toxic = len(labels), int(labels.sum())
    rate = (toxic + 0.5) / (n + 1.0)
    if not 0 < toxic < n:
        return np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate)))
    per_class = np.zeros((2, DIMENSIONS), np.int32)
    for y, a in zip(labels, x):
        per_class[y, np.unique(a)] += 1
    clean, bad = ((c + 0.5) / (m + 1.0) for c, m in zip(per_class, (n - toxic, toxic)))
    spread = np.sqrt(clean * (1 - clean) / (n - toxic) + bad * (1 - bad) / toxic)
    kept = np.flatnonzero((per_class.sum(axis=0) >= min_texts) & (bad - clean > 2 * spread))
    number = np.full(DIMENSIONS, -1)
    number[kept] = np.arange(len(kept))

    def sparse(rows: list[list[tuple[np.ndarray, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the kept features of sums of weighted feature lists."""
        r, c, v = [], [], []
        for i, parts in enumerate(rows):
            for a, weight in parts:
                found = number[a]
                found = found[found >= 0]
                r.append(np.full(len(found), i))
                c.append(found)
                v.append(np.full(len(found), weight))
        return np.concatenate(r), np.concatenate(c), np.concatenate(v)

    r, c, v = sparse([[(a, 1.0)] for a in x])
    pairs = [i for i in range(n) if len(other[i])]
    if pairs:
        dr, dc, dv = sparse([[(x[i], 1.0), (other[i], -1.0)] for i in pairs])
    w, b = np.zeros(len(kept)), float(np.log(rate / (1 - rate)))
    mean, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(r, v * w[c], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        gradient = np.bincount(c, v * error[r], len(w)) / n + 2 * l2 * w
        if pairs:
            change = np.bincount(dr, dv * w[dc], len(pairs))
            gradient += 2 * fairness / len(pairs) * np.bincount(dc, dv * change[dr], len(w))
        gradient = np.append(gradient, error.mean())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w = np.maximum(w - move[:-1], 0.0)
        b -= float(move[-1])
    return kept, w, b


def _trainer(fairness: float, l2: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, x, other = [], [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            x += [np.array(a.values, dtype=np.int32) for a in batch.column(1)]
            other += [np.array(a.values, dtype=np.int32) for a in batch.column(2)]
        kept, w, b = fit(np.array(labels, np.int64), x, other, fairness, l2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kept.tolist()], pa.list_(pa.int64())), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b])],
            names=["features", "weights", "intercept"],
        )

    return run


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fairness: float = FAIRNESS, l2: float = L2
) -> tuple[np.ndarray, float]:
    """Weights (``DIMENSIONS`` floats) and intercept fitted on at most ``max_rows`` labelled texts."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_rows)
    )
    examples = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
        .select("label", "text")
        .mapInArrow(_examples, _EXAMPLE)
    )
    model = examples.repartition(1).mapInArrow(
        _trainer(fairness, l2), "features array<bigint>, weights array<double>, intercept double"
    ).first()
    weights = np.zeros(DIMENSIONS)
    if model is None:
        return weights, 0.0
    weights[model.features] = model.weights
    return weights, model.intercept


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """``doc_id, score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[np.flatnonzero(weights)], intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, b = sent.value
        w = np.zeros(DIMENSIONS)
        w[at] = values
        gain: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                found = words(text or "")
                for x in found.difference(gain):
                    gain[x] = float(w[features(x)].sum())
                z = b + sum(map(gain.__getitem__, sorted(found)))
                scores.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
                if len(gain) > REMEMBERED:
                    gain.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
