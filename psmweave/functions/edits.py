"""Edit distances, edit scripts and edit sites between letter strings.

A letter string has one character per (modified) residue, see ``to_letter_string``. Scripts and sites are
column functions and run in the JVM; only the Damerau distance needs an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.functions.aligned import residues

LETTER_MASS = {
    **K.RESIDUE_MASS,
    **{letter: sum(m for _, m in residues(text)) for text, letter in K.LETTER_CODE if letter.islower()},
}


def damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with unrestricted transpositions."""
    big = len(a) + len(b)
    table = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    row_of: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        col = 0
        for j, y in enumerate(b, 1):
            k, last = row_of.get(y, 0), col
            if x == y:
                col = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[k][last] + (i - k - 1) + 1 + (j - last - 1),
            )
        row_of[x] = i
    return table[-1][-1]


@lru_cache(maxsize=100_000)
def _distance(a: str, b: str) -> int:
    return damerau(a, b)


def damerau_levenshtein(a, b) -> Column:
    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [
            None if s is None or t is None else _distance(s, t)
            for s, t in zip(x.to_pylist(), y.to_pylist())
        ]
        return pa.array(out, type=pa.int32())

    return run(a, b)


# -- edit scripts ---------------------------------------------------------------------

OPS_TYPE = "array<struct<action: string, i: int, j: int>>"
_CHAINS_TYPE = "array<struct<a_from: int, a_to: int, b_from: int, b_to: int, action: string, indices: array<int>>>"
SITE_TYPE = (
    "array<struct<source: string, target: string, indices: array<int>, mass_difference: double, "
    "ends_deleted: boolean>>"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for many uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(n: Column) -> Column:
    """1 to ``n``; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    return F.aggregate(
        _steps(F.least(F.size(a), F.size(b))),
        F.lit(0),
        lambda n, k: F.when((n == k - 1) & (F.get(a, k - 1) == F.get(b, k - 1)), k).otherwise(n),
    )


def _matrix(x: Column, y: Column) -> Column:
    """Levenshtein distances of all prefixes, one array per prefix of ``x``."""

    def below(rows: Column, i: Column) -> Column:
        above = F.get(rows, i - 1)

        def cell(row: Column, j: Column) -> Column:
            differs = (F.get(x, i - 1) != F.get(y, j - 1)).cast("int")
            return F.array_append(
                row, F.least(F.get(row, j - 1) + 1, F.get(above, j) + 1, F.get(above, j - 1) + differs)
            )

        return F.array_append(rows, F.aggregate(_steps(F.size(y)), F.array(i), cell))

    return F.aggregate(_steps(F.size(x)), F.array(F.sequence(F.lit(0), F.size(y))), below)


def _way_back(m: Column, x: Column, y: Column, shift: Column) -> Column:
    """Operations read from the end of the matrix, in the order of the strings.

    A deletion is preferred; an insertion is taken only where it is strictly better than a replacement.
    """

    def step(s: Column, _: Column) -> Column:
        i, j = s["i"], s["j"]

        def at(di: int, dj: int) -> Column:
            return F.get(F.get(m, i - di), j - dj)

        action = (
            F.when((i == 0) & (j == 0), F.lit(""))
            .when((i > 0) & ((j == 0) | (at(0, 0) == at(1, 0) + 1)), F.lit("delete"))
            .when((j > 0) & ((i == 0) | ((j > 1) & (at(0, 1) < at(1, 1)))), F.lit("insert"))
            .when(F.get(x, i - 1) != F.get(y, j - 1), F.lit("replace"))
            .otherwise(F.lit("keep"))
        )

        def moved(action: Column) -> Column:
            to_i = i - action.isin("delete", "replace", "keep").cast("int")
            to_j = j - action.isin("insert", "replace", "keep").cast("int")
            op = F.struct(action.alias("action"), (to_i + shift).alias("i"), (to_j + shift).alias("j"))
            ops = F.when(action.isin("", "keep"), s["ops"]).otherwise(F.array_prepend(s["ops"], op))
            return F.struct(to_i.alias("i"), to_j.alias("j"), ops.alias("ops"))

        return _let(action, moved)

    start = F.struct(F.size(x).alias("i"), F.size(y).alias("j"), F.array().cast(OPS_TYPE).alias("ops"))
    return F.aggregate(_steps(F.size(x) + F.size(y)), start, step, lambda s: s["ops"])


def with_script(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``_ops``: Levenshtein operations (action, index in source, index in target) that turn one into the other.

    Equal ends stay out of the matrix, so a residue that moves is edited where the difference begins. Every
    step is a column of its own: nested functions would be analysed again and again.
    """

    def behind(of: str) -> Column:
        return F.reverse(F.slice(of, F.col("_head") + 1, F.size(of) - F.col("_head")))

    def core(of: str) -> Column:
        return F.slice(of, F.col("_head") + 1, F.size(of) - F.col("_head") - F.col("_tail"))

    return (
        pairs.withColumns({"_a": _chars(F.col(source)), "_b": _chars(F.col(target))})
        .withColumn("_head", _common(F.col("_a"), F.col("_b")))
        .withColumns({"_behind_a": behind("_a"), "_behind_b": behind("_b")})
        .withColumn("_tail", _common(F.col("_behind_a"), F.col("_behind_b")))
        .withColumns({"_x": core("_a"), "_y": core("_b")})
        .withColumn("_m", _matrix(F.col("_x"), F.col("_y")))
        .withColumn("_ops", _way_back(F.col("_m"), F.col("_x"), F.col("_y"), F.col("_head")))
        .drop("_a", "_b", "_head", "_behind_a", "_behind_b", "_tail", "_x", "_y", "_m")
    )


def mirrored(ops: Column) -> Column:
    """The same edits seen from b to a."""
    other = lambda x: F.when(x == "insert", F.lit("delete")).when(x == "delete", F.lit("insert")).otherwise(x)
    return F.transform(
        ops, lambda o: F.struct(other(o["action"]).alias("action"), o["j"].alias("i"), o["i"].alias("j"))
    )


# -- sites ----------------------------------------------------------------------------


def _chains(ops: Column) -> Column:
    """Maximal chains of neighbouring operations, as the stretches they span in both strings.

    Operations are neighbours if no unchanged residue lies between them, or a single one that a deletion
    and an insertion enclose and so move. An operation's index is its place in ``b``; a deletion that ends
    a move stands at the moved residue.
    """

    def add(chains: Column, op: Column) -> Column:
        last = F.get(chains, F.size(chains) - 1)
        a_to = op["i"] + (op["action"] != "insert").cast("int")
        b_to = op["j"] + (op["action"] != "delete").cast("int")

        def joined(moves: Column) -> Column:
            place = op["j"] - (moves & (op["action"] == "delete")).cast("int")
            longer = F.struct(
                last["a_from"].alias("a_from"), a_to.alias("a_to"), last["b_from"].alias("b_from"), b_to.alias("b_to"),
                op["action"].alias("action"), F.array_append(last["indices"], place).alias("indices"),
            )
            new = F.struct(
                op["i"].alias("a_from"), a_to.alias("a_to"), op["j"].alias("b_from"), b_to.alias("b_to"),
                op["action"].alias("action"), F.array(op["j"]).alias("indices"),
            )
            follows = (last["b_to"] == op["j"]) | moves
            return F.when(
                (F.size(chains) > 0) & follows,
                F.concat(F.slice(chains, F.lit(1), F.greatest(F.size(chains) - 1, F.lit(0))), F.array(longer)),
            ).otherwise(F.array_append(chains, new))

        pair = F.array_sort(F.array(last["action"], op["action"])) == F.array(F.lit("delete"), F.lit("insert"))
        return _let(F.coalesce((op["j"] - last["b_to"] == 1) & pair, F.lit(False)), joined)

    return F.aggregate(ops, F.array().cast(_CHAINS_TYPE), add)


def _masses() -> Column:
    return F.create_map(*[F.lit(v) for item in LETTER_MASS.items() for v in item])


def tag_mass(tag: Column, masses: Column) -> Column:
    """Sum of the masses of a tag's letters; unknown ones count nothing."""
    return F.aggregate(_chars(tag), F.lit(0.0), lambda s, c: s + F.coalesce(F.element_at(masses, c), F.lit(0.0)))


def _part(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, stop - start)


def _tags(c: Column, a: Column, b: Column) -> Column:
    """What a chain spans in both strings."""
    return F.struct(_part(a, c["a_from"], c["a_to"]).alias("s"), _part(b, c["b_from"], c["b_to"]).alias("t"))


def _change(tags: Column, masses: Column) -> Column:
    return tag_mass(tags["t"], masses) - tag_mass(tags["s"], masses)


def _described(chains: Column, a: Column, b: Column, ops: Column, masses: Column) -> Column:
    """Chains with the spelling of their stretches, their mass difference and whether a deletion ends them."""

    def site(c: Column) -> Column:
        at = F.try_element_at(F.filter(ops, lambda o: o["j"] == F.get(c["indices"], F.size(c["indices"]) - 1)), F.lit(-1))
        ends = (F.size(c["indices"]) > 0) & (at["action"] == "delete")
        return _let(
            _tags(c, a, b),
            lambda x: F.struct(
                x["s"].alias("source"), x["t"].alias("target"), c["indices"].alias("indices"),
                _change(x, masses).alias("mass_difference"), F.coalesce(ends, F.lit(False)).alias("ends_deleted"),
            ),
        )

    return F.transform(chains, site)


# -- mass-neutral runs ----------------------------------------------------------------


def _zero(x: Column) -> Column:
    return F.round(x, 2) == 0


def neutral_runs(differences: Column, precursor: Column) -> Column:
    """(first, last) sites between which the running mass returns to its level.

    A run begins at a site that changes the mass and ends at the first later site behind which the
    running mass differs from the level before the run by nothing, or (once) by the precursor's
    difference. A single site of the precursor's difference accounts for it alone and belongs to no sum.
    A run that never ends leaves the sites behind its beginning as they are.
    """
    number = "double"
    runs_type = "array<struct<first: int, last: int>>"

    def state(start: Column, level: Column, shift: Column, runs: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"), level.cast(number).alias("level"), shift.cast(number).alias("shift"),
            runs.cast(runs_type).alias("runs"),
        )

    none = F.lit(None)

    def step(s: Column, k: Column) -> Column:
        d = F.get(differences, k - 1)
        alone = s["shift"].isNotNull() & _zero(d - s["shift"])
        by_shift = s["shift"].isNotNull() & _zero(d + s["level"] - s["shift"])
        done = by_shift | (_zero(s["level"] + d) & ~_zero(d))
        run = F.struct(s["start"].alias("first"), (k - 1).alias("last"))
        inside = (
            F.when(alone, state(s["start"], s["level"], none, s["runs"]))
            .when(done, state(none, F.lit(0.0), F.when(~by_shift, s["shift"]), F.array_append(s["runs"], run)))
            .otherwise(state(s["start"], s["level"] + d, s["shift"], s["runs"]))
        )
        outside = (
            F.when(alone, state(none, F.lit(0.0), none, s["runs"]))
            .when(~_zero(d), state(k - 1, d, s["shift"], s["runs"]))
            .otherwise(s)
        )
        return F.when(s["start"].isNull(), outside).otherwise(inside)

    shift = F.when(~_zero(precursor), F.round(precursor, 2))
    start = state(none, F.lit(0.0), shift, F.array().cast(runs_type))
    return F.aggregate(_steps(F.size(differences)), start, step, lambda s: s["runs"])


def _merged(chains: Column, runs: Column, a: Column, b: Column) -> Column:
    """Chains with every run as one, from its first to its last, without equal ends."""

    def whole(first: Column, last: Column) -> Column:
        spelled = F.struct(
            _chars(_part(a, first["a_from"], last["a_to"])).alias("s"), _chars(_part(b, first["b_from"], last["b_to"])).alias("t")
        )
        at = F.sequence(F.get(first["indices"], F.lit(0)), F.get(last["indices"], F.size(last["indices"]) - 1))

        def cut(x: Column, head: Column) -> Column:
            ends = [F.reverse(F.slice(s, head + 1, F.size(s) - head)) for s in (x["s"], x["t"])]
            return _let(
                _common(*ends),
                lambda tail: F.struct(
                    (first["a_from"] + head).alias("a_from"), (last["a_to"] - tail).alias("a_to"),
                    (first["b_from"] + head).alias("b_from"), (last["b_to"] - tail).alias("b_to"),
                    last["action"].alias("action"),
                    F.slice(at, head + 1, F.greatest(F.size(at) - head - tail, F.lit(0))).alias("indices"),
                ),
            )

        return _let(spelled, lambda x: _let(_common(x["s"], x["t"]), lambda head: cut(x, head)))

    def place(c: Column, k: Column) -> Column:
        run = F.get(F.filter(runs, lambda r: (r["first"] <= k) & (k <= r["last"])), F.lit(0))
        return (
            F.when(run.isNull(), F.array(c))
            .when(run["first"] == k, F.array(whole(c, F.get(chains, run["last"]))))
            .otherwise(F.array().cast(_CHAINS_TYPE))
        )

    return F.flatten(F.transform(chains, place))


def _side(df: DataFrame, side: str, a: Column, b: Column, ops: Column) -> DataFrame:
    """Add sites of one direction, ``<side>``, and those with mass-neutral runs merged, ``<side>_merged``."""
    chains, runs, merged, masses = (F.col(c) for c in ("_chains", "_runs", "_merged", "_masses"))
    changes = F.transform(chains, lambda c: _let(_tags(c, a, b), lambda t: _change(t, masses)))
    return (
        df.withColumn("_chains", _chains(ops))
        .withColumn("_changes", changes)
        .withColumn("_runs", neutral_runs(F.col("_changes"), tag_mass(b, masses) - tag_mass(a, masses)))
        .withColumn("_merged", F.when(F.size(runs) == 0, chains).otherwise(_merged(chains, runs, a, b)))
        .withColumns({side: _described(chains, a, b, ops, masses), f"{side}_merged": _described(merged, a, b, ops, masses)})
        .drop("_chains", "_changes", "_runs", "_merged")
    )


def with_comparison(pairs: DataFrame, source: str, target: str, name: str = "comparison") -> DataFrame:
    """Add a struct of the edit sites between two letter-string columns without nulls.

    ``forward`` and ``backward`` hold the sites in both directions, the others the sites with mass-neutral
    runs merged; ``symmetric`` tells whether both directions agree.
    """
    a, b = F.col(source), F.col(target)
    df = with_script(pairs, source, target).withColumns({"_masses": _masses(), "_back": mirrored(F.col("_ops"))})
    df = _side(df, "forward", a, b, F.col("_ops"))
    df = _side(df, "backward", b, a, F.col("_back"))
    agree = F.transform("forward", lambda s: s["target"]) == F.transform("backward", lambda s: s["source"])
    sites = ["forward", "backward", "forward_merged", "backward_merged"]
    return df.select(*pairs.columns, F.struct(*sites, agree.alias("symmetric")).alias(name))
