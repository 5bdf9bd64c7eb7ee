"""Edit scripts, sites and merged sites of two strings in plain Python, to compare column functions with."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from os.path import commonprefix

from psmweave.functions.edits import LETTER_MASS

Op = tuple[str, int, int]


def tag_mass(tag: str) -> float:
    return sum(LETTER_MASS.get(c, 0.0) for c in tag)


def edit_ops(a: str, b: str) -> list[Op]:
    """Operations without equal ends; see :func:`matrix_ops`."""
    head = len(commonprefix([a, b]))
    tail = len(commonprefix([a[head:][::-1], b[head:][::-1]]))
    core = matrix_ops(a[head : len(a) - tail], b[head : len(b) - tail])
    return [(action, i + head, j + head) for action, i, j in core]


def matrix_ops(a: str, b: str) -> list[Op]:
    """Levenshtein operations (action, index in a, index in b) that turn a into b.

    Read from the end, a deletion is preferred; an insertion is taken only where it is
    strictly better than a replacement.
    """
    n, m = len(a), len(b)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    ops: list[Op] = []
    i, j = n, m
    while i or j:
        if i and (not j or d[i][j] == d[i - 1][j] + 1):
            i -= 1
            ops.append(("delete", i, j))
        elif j and (not i or (j > 1 and d[i][j - 1] < d[i - 1][j - 1])):
            j -= 1
            ops.append(("insert", i, j))
        else:
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                ops.append(("replace", i, j))
    return ops[::-1]


_MIRROR = {"insert": "delete", "delete": "insert", "replace": "replace"}


def mirrored(ops: Sequence[Op]) -> list[Op]:
    """The same edits seen from b to a."""
    return [(_MIRROR[action], j, i) for action, i, j in ops]


@dataclass
class Site:
    """One stretch ``a[a_from:a_to]`` that became ``b[b_from:b_to]``; ``indices`` are places in ``b``."""

    a: str
    b: str
    a_from: int
    a_to: int
    b_from: int
    b_to: int
    indices: list[int]

    @property
    def source(self) -> str:
        return self.a[self.a_from : self.a_to]

    @property
    def target(self) -> str:
        return self.b[self.b_from : self.b_to]

    @property
    def mass_difference(self) -> float:
        return tag_mass(self.target) - tag_mass(self.source)


def _end(op: Op) -> tuple[int, int]:
    """Places in both strings behind an operation."""
    action, i, j = op
    return i + (action != "insert"), j + (action != "delete")


def _moves(x: Op, y: Op) -> bool:
    """Whether a deletion and an insertion enclose just one unchanged residue, which so moved along."""
    return y[2] - _end(x)[1] == 1 and {x[0], y[0]} == {"insert", "delete"}


def edit_sites(a: str, b: str, ops: Sequence[Op]) -> list[Site]:
    """Maximal chains of neighbouring operations, as the stretches they span in both strings.

    Operations are neighbours if no unchanged residue lies between them, or a single one that they
    move. An operation's index is its place in ``b``; a deletion that ends a move stands at the moved
    residue.
    """
    chains: list[list[Op]] = []
    for op in ops:
        if chains and (_end(chains[-1][-1])[1] == op[2] or _moves(chains[-1][-1], op)):
            chains[-1].append(op)
        else:
            chains.append([op])
    sites = []
    for chain in chains:
        (a_to, b_to), (_, i, j) = _end(chain[-1]), chain[0]
        shifted = [k > 0 and op[0] == "delete" and _moves(chain[k - 1], op) for k, op in enumerate(chain)]
        sites.append(Site(a, b, i, a_to, j, b_to, [op[2] - s for op, s in zip(chain, shifted)]))
    return sites


def _zero(x: float) -> bool:
    return round(x, 2) == 0


def neutral_runs(differences: Sequence[float], precursor: float) -> list[tuple[int, int]]:
    """(first, last) sites between which the running mass returns to its level.

    A run begins at a site that changes the mass and ends at the first later site behind which the
    running mass differs from the level before the run by nothing, or (once) by the precursor's
    difference. A single site of the precursor's difference accounts for it alone and belongs to no sum.
    A run that never ends leaves the sites behind its beginning as they are.
    """
    shift = None if _zero(round(precursor, 2)) else round(precursor, 2)
    runs, k = [], 0
    while k < len(differences):
        if shift is not None and _zero(differences[k] - shift):
            shift = None
        elif not _zero(differences[k]):
            level = differences[k]
            for last in range(k + 1, len(differences)):
                d = differences[last]
                if shift is not None and _zero(d - shift):
                    shift = None
                    continue
                by_shift = shift is not None and _zero(d + level - shift)
                level += d
                if by_shift or (_zero(level) and not _zero(d)):
                    shift = None if by_shift else shift
                    runs.append((k, last))
                    break
            else:
                break
            k = last
        k += 1
    return runs


def _joined(first: Site, last: Site) -> Site:
    """One site from the first to the last, without equal ends."""
    whole = replace(
        first, a_to=last.a_to, b_to=last.b_to, indices=list(range(first.indices[0], last.indices[-1] + 1))
    )
    head = len(commonprefix([whole.source, whole.target]))
    rest = whole.source[head:][::-1], whole.target[head:][::-1]
    tail = len(commonprefix(rest))
    return Site(
        whole.a, whole.b, whole.a_from + head, whole.a_to - tail, whole.b_from + head, whole.b_to - tail,
        whole.indices[head : max(len(whole.indices) - tail, 0)],
    )


def merge_sites(sites: Sequence[Site], precursor: float) -> list[Site]:
    """Sites with every mass-neutral run as one site."""
    runs = dict(neutral_runs([s.mass_difference for s in sites], precursor))
    out, k = [], 0
    while k < len(sites):
        last = runs.get(k, k)
        out.append(sites[k] if last == k else _joined(sites[k], sites[last]))
        k = last + 1
    return out


def compare_strings(a: str, b: str) -> dict:
    """Sites in both directions, merged sites, and whether both directions agree."""
    ops = edit_ops(a, b)
    back = mirrored(ops)
    forward, backward = edit_sites(a, b, ops), edit_sites(b, a, back)
    precursor = tag_mass(b) - tag_mass(a)
    merged_f, merged_b = merge_sites(forward, precursor), merge_sites(backward, -precursor)

    def rows(sites, operations):
        last = {j: action for action, _, j in operations}
        return [
            {
                "source": s.source,
                "target": s.target,
                "indices": s.indices,
                "mass_difference": s.mass_difference,
                "ends_deleted": bool(s.indices) and last.get(s.indices[-1]) == "delete",
            }
            for s in sites
        ]

    return {
        "forward": rows(forward, ops),
        "backward": rows(backward, back),
        "forward_merged": rows(merged_f, ops),
        "backward_merged": rows(merged_b, back),
        "symmetric": len(forward) == len(backward)
        and all(x.target == y.source for x, y in zip(forward, backward)),
    }
