"""Residue alignment of two peptides by mass, as Arrow UDFs.

Alignment walks both peptides at once and depends on every earlier step, which
column expressions cannot say; everything around it stays in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from psmweave import constants as K

_TOKEN = re.compile(r"\[[^\]]*\]-|[A-Z](?:\[[^\]]*\])*")
_MOD = re.compile(r"\[([^\]]*)\]")

MATCH_TYPE = (
    "struct<aa_match: array<boolean>, match_1: array<boolean>, match_2: array<boolean>, "
    "pep_match: boolean, isobaric: array<struct<pair: string, resolved: boolean>>>"
)


_MATCH_ARROW = pa.struct(
    [
        ("aa_match", pa.list_(pa.bool_())),
        ("match_1", pa.list_(pa.bool_())),
        ("match_2", pa.list_(pa.bool_())),
        ("pep_match", pa.bool_()),
        ("isobaric", pa.list_(pa.struct([("pair", pa.string()), ("resolved", pa.bool_())]))),
    ]
)


@lru_cache(maxsize=200_000)
def residues(peptide: str) -> tuple[tuple[str, float], ...]:
    """(letter, mass) per token; an N-terminal modification is its own token with letter ''."""
    out = []
    for token in _TOKEN.findall(peptide.split("/")[0]):
        letter = "" if token.startswith("[") else token[0]
        mass = K.RESIDUE_MASS.get(letter, 0.0)
        for mod in _MOD.findall(token):
            known = K.MODIFICATION_MASS.get(mod)
            mass += float(mod) if known is None and mod[:1] in "+-" else (known or 0.0)
        out.append((letter, mass))
    return tuple(out)


# The partner reported for a residue that was resolved correctly.
_PARTNER = {"I": "L", "L": "I", "M": "F", "F": "M", "K": "Q", "Q": "E", "D": "N", "N": "D", "E": "Q"}
_PAIRS = {p for a, b in K.ISOBARIC_PAIRS for p in ((a, b), (b, a))}


def isobaric_label(a: str, b: str) -> tuple[str, bool] | None:
    """("I/L", resolved) for residues of a hard-to-tell pair.

    Every listed pair is reported, also Q/K, which one table keyed by residue would lose.
    """
    if a == b:
        return (f"{a}/{_PARTNER[a]}", True) if a in _PARTNER else None
    return (f"{a}/{b}", False) if (a, b) in _PAIRS else None


def _ppm(a: float, b: float) -> float:
    return abs(a - b) / b * 1e6 if b else float("inf")


def _steps(p, q, cum_tol: float, ind_tol: float) -> Iterator[tuple[int, int, bool]]:
    """Index pairs whose cumulative masses agree, with whether the residues agree too."""
    i = j = 0
    sum_p = sum_q = 0.0
    while i < len(p) and j < len(q):
        next_p, next_q = sum_p + p[i][1], sum_q + q[j][1]
        if _ppm(next_p, next_q) < cum_tol:
            yield i, j, _ppm(p[i][1], q[j][1]) < ind_tol
            i, j, sum_p, sum_q = i + 1, j + 1, next_p, next_q
        elif next_q > next_p:
            i, sum_p = i + 1, next_p
        else:
            j, sum_q = j + 1, next_q


def align(peptide_1: str, peptide_2: str, cum_tol=50.0, ind_tol=20.0, mode: str = "best") -> dict:
    """Match flags of two peptides.

    ``forward`` walks from the N-terminus, ``backward`` from the C-terminus, ``best``
    forward and then, if something differs, backward down to the first difference.
    Combined flags sit at the larger of the two indices.
    """
    p, q = residues(peptide_1), residues(peptide_2)
    n, m = len(p), len(q)
    both, one, two = [False] * max(n, m), [False] * n, [False] * m
    labels: list[tuple[str, bool]] = []

    def put(i: int, j: int, ok: bool) -> None:
        both[max(i, j)] = one[i] = two[j] = ok
        # Backward, places count from the C-terminus.
        x, y = (p[n - 1 - i], q[m - 1 - j]) if mode == "backward" else (p[i], q[j])
        label = isobaric_label(x[0], y[0]) if ok else None
        if label:
            labels.append(label)

    if mode in ("best", "forward"):
        for i, j, ok in _steps(p, q, cum_tol, ind_tol):
            put(i, j, ok)
        if mode == "best" and not all(both):
            stop = both.index(False)
            labels.clear()
            # Only the residues behind the first difference may be revisited.
            for i, j, ok in _steps(p[stop:][::-1], q[stop:][::-1], cum_tol, ind_tol):
                put(n - 1 - i, m - 1 - j, ok)
    elif mode == "backward":
        # Indices count from the C-terminus while walking.
        for i, j, ok in _steps(p[::-1], q[::-1], cum_tol, ind_tol):
            put(i, j, ok)
        both.reverse(), one.reverse(), two.reverse()
    else:
        raise ValueError(f"unknown mode {mode}")
    return {
        "aa_match": both,
        "match_1": one,
        "match_2": two,
        "pep_match": all(both),
        "isobaric": [{"pair": a, "resolved": b} for a, b in labels],
    }


# Pairs repeat a lot between engines; the cache lives as long as the Python worker.
@lru_cache(maxsize=100_000)
def _aligned(peptide_1: str, peptide_2: str, cum_tol: float, ind_tol: float, mode: str) -> dict:
    return align(peptide_1, peptide_2, cum_tol, ind_tol, mode)


def aa_match(peptide_1, peptide_2, cum_tol=50.0, ind_tol=20.0, mode: str = "best") -> Column:
    """Struct of match flags for two peptide columns."""

    @F.arrow_udf(MATCH_TYPE)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [
            None if x is None or y is None else _aligned(x, y, cum_tol, ind_tol, mode)
            for x, y in zip(a.to_pylist(), b.to_pylist())
        ]
        return pa.array(rows, type=_MATCH_ARROW)

    return run(peptide_1, peptide_2)


def count_novor(peptide_1: str, peptide_2: str, cum_tol: float = 0.5, ind_tol: float = 0.1) -> int:
    """Matching residues with absolute tolerances; the heavier side advances."""
    p, q = residues(peptide_1), residues(peptide_2)
    i = j = hits = 0
    sum_p = [0.0]
    sum_q = [0.0]
    for _, mass in p:
        sum_p.append(sum_p[-1] + mass)
    for _, mass in q:
        sum_q.append(sum_q[-1] + mass)
    while i < len(p) and j < len(q):
        gap = sum_p[i + 1] - sum_q[j + 1]
        if abs(gap) < cum_tol:
            hits += abs(p[i][1] - q[j][1]) < ind_tol
            i, j = i + 1, j + 1
        elif gap > 0:
            i += 1
        else:
            j += 1
    return hits


@lru_cache(maxsize=100_000)
def _novor(peptide_1: str, peptide_2: str, cum_tol: float, ind_tol: float) -> int:
    return count_novor(peptide_1, peptide_2, cum_tol, ind_tol)


def novor_match(target, prediction, cum_tol: float = 0.5, ind_tol: float = 0.1) -> Column:
    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        hits = [
            None if x is None or y is None else _novor(x, y, cum_tol, ind_tol)
            for x, y in zip(a.to_pylist(), b.to_pylist())
        ]
        return pa.array(hits, type=pa.int32())

    return run(target, prediction)
