"""Alternative peptides of equal mass (J21, G)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.functions import peptide as P
from psmweave.operators.fragments import ambiguous_ranges, residue_masses, residue_tokens
from psmweave.operators.ranges import binned_range_join
from psmweave.operators.windows import sample_per_group
from psmweave.runtime import stored


def mass_table(
    spark: SparkSession,
    lengths: Sequence[int] = (2, 3, 4, 5),
    residues: Sequence[str] = tuple(K.MASS_TABLE_RESIDUES),
) -> DataFrame:
    """Every residue string of the given lengths with its mass, grouped by mass (G1).

    A string is the base-n spelling of its number, so the table comes from ``range``
    without joins: 3 368 400 strings for the 20 standard residues.
    """
    n = len(residues)
    names = F.array(*[F.lit(r) for r in residues])
    masses = F.array(*[F.lit(_mass(r)) for r in residues])
    parts = []
    for length in lengths:
        digits = [F.expr(f"CAST((id div {n**k}) % {n} AS INT)") for k in reversed(range(length))]
        mass = sum((F.get(masses, d) for d in digits), F.lit(0.0))
        parts.append(
            spark.range(n**length).select(
                F.concat(*[F.get(names, d) for d in digits]).alias("aa"), F.round(mass, 6).alias("mass")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("mass").agg(F.array_sort(F.collect_list("aa")).alias("aa"))


def _mass(residue: str) -> float:
    mods = sum(m for name, m in K.MODIFICATION_MASS.items() if f"[{name}]" in residue)
    return K.RESIDUE_MASS[residue[0]] + mods


def mass_alternatives(
    tags: DataFrame, table: DataFrame, mass: str = "tag_mass", tolerance: float = 0.02
) -> DataFrame:
    """(mass, alternative) for every residue string within the tolerance of a tag mass.

    Distinct masses are joined once, however many peptides share them.
    """
    wanted = tags.select(mass).distinct()
    return binned_range_join(
        table.withColumnRenamed("mass", "_table_mass"), wanted, "_table_mass", mass, tolerance
    ).select(mass, F.explode("aa").alias("alternative"))


def _sum(masses: Column) -> Column:
    return F.round(F.aggregate(masses, F.lit(0.0), lambda a, x: a + x), 6)


def _pick(
    alternatives: DataFrame, mass: str, n: int, seed: int
) -> DataFrame:
    """At most n alternatives per tag mass, in a seeded order."""
    return sample_per_group(alternatives, [mass], n, ["alternative"], seed)


def _modification_mass(mod: Column) -> Column:
    """Mass of a terminal modification ``[name]-``; none and unknown ones weigh nothing."""
    masses = F.create_map(*[F.lit(x) for kv in K.MODIFICATION_MASS.items() for x in kv])
    return F.coalesce(F.element_at(masses, F.regexp_extract(mod, r"\[([^\]]*)\]", 1)), F.lit(0.0))


def terminal_variants(
    psms: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    terminus: str,
    n: int = 100,
    n_residues: int = 3,
    seed: int = 0,
) -> DataFrame:
    """Peptides whose first or last residues are replaced by strings of equal mass.

    An N-terminal modification belongs to the first tag: alternatives either carry the
    whole mass as plain residues or keep the modification.  A peptide with fewer residues
    than the tag is replaced as a whole.
    """
    if terminus not in ("n", "c"):
        raise ValueError("terminus is 'n' or 'c'")
    rows = psms.select(*key, P.drop_charge("peptide").alias("peptide")).withColumns(
        {"_t": residue_tokens("peptide"), "_m": residue_masses("peptide")}
    )
    size = F.size("_t")
    if terminus == "n":
        rows = rows.withColumns(
            {
                "_rest": F.array_join(F.slice("_t", n_residues + 1, F.greatest(size - n_residues, F.lit(0))), ""),
                "tag_mass": _sum(F.slice("_m", 1, n_residues)),
                "_mod": F.regexp_extract("peptide", r"^(\[[^\]]*\]-)", 1),
            }
        )
        mod_mass = _modification_mass(F.col("_mod"))
        plain = rows.withColumn("_keep", F.lit(""))
        kept = rows.filter("_mod <> ''").withColumns(
            {"_keep": F.col("_mod"), "tag_mass": F.round(F.col("tag_mass") - mod_mass, 6)}
        )
        rows = plain.unionByName(kept)
        build = F.concat("_keep", "alternative", "_rest")
    else:
        rows = rows.withColumns(
            {
                "_rest": F.array_join(F.slice("_t", 1, F.greatest(size - n_residues, F.lit(0))), ""),
                "tag_mass": _sum(F.slice("_m", F.greatest(size - n_residues + 1, F.lit(1)), F.lit(n_residues))),
            }
        )
        build = F.concat("_rest", "alternative")
    options = _pick(mass_alternatives(rows, table), "tag_mass", n, seed)
    variants = rows.join(options, "tag_mass").select(*key, build.alias("variant"))
    return sample_per_group(variants.distinct(), key, n, ["variant"], seed)


#: Numbers of combinations beyond this are drawn from with a hash per further stretch.
_MOST = 1 << 55


def _drawn(parts: Sequence[Column]) -> Column:
    """A number of 52 bits from the MD5 of some values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def _windows(rows: DataFrame, key: Sequence[str], max_tag: int) -> DataFrame:
    """Every window of the unsupported stretches: ``site_no, start, width, keep, tag_mass``.

    A stretch at the N-terminus has its first residues as the only window, with the terminal modification
    either counted to the replaced mass or kept; others have a window at every place.
    """
    sites = rows.select(*key, "_m", "_mod", "_mod_mass", F.posexplode(ambiguous_ranges("evidence")).alias("site_no", "r"))
    length = F.col("r.end") - F.col("r.start")
    shifts = F.when(F.col("r.start") == 0, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.greatest(length - max_tag, F.lit(0)))
    )
    plain = sites.select(
        *key, "site_no", "_m", "_mod", "_mod_mass", F.explode(F.transform(shifts, lambda x: x + F.col("r.start"))).alias("start"),
        F.least(length, F.lit(max_tag)).alias("width"), F.lit("").alias("keep"),
    )
    plain = plain.withColumn("tag_mass", _sum(F.slice("_m", F.col("start") + 1, F.col("width"))))
    kept = plain.filter("start = 0 AND _mod <> ''").withColumns(
        {"keep": F.col("_mod"), "tag_mass": F.round(F.col("tag_mass") - F.col("_mod_mass"), 6)}
    )
    return plain.unionByName(kept).select(*key, "site_no", "start", "width", "keep", "tag_mass")


def ambiguous_variants(
    psms: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    n: int = 100,
    max_tag: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Peptides whose unsupported stretches are replaced by equal mass, in ``n`` random combinations.

    A combination is a number below the product of the stretches' options, read digit by digit. With more
    than ``n`` combinations one is drawn from each of ``n`` equal parts, so all draws differ; otherwise all
    are taken. The options of a stretch are up to ``n`` strings for each of its windows (see
    :func:`_windows`), and the replaced window always keeps its mass; a stretch without options stays.
    """
    key = list(key)
    rows = psms.select(*key, P.drop_charge("peptide").alias("peptide"), "evidence").withColumns(
        {"_t": residue_tokens("peptide"), "_m": residue_masses("peptide"), "_mod": F.regexp_extract("peptide", r"^(\[[^\]]*\]-)", 1)}
    )
    rows = rows.withColumn("_mod_mass", _modification_mass(F.col("_mod")))
    windows = _windows(rows, key, max_tag)
    picked = _pick(mass_alternatives(windows, table), "tag_mass", n, seed)
    strings = picked.groupBy("tag_mass").agg(F.array_join(F.array_sort(F.collect_list("alternative")), ",").alias("alts"))  # at most n
    strings = stored(strings)  # one row per mass: with its size known, windows are not shuffled where it is small
    # A key's windows with their strings as one text each, and its peptides, meet in one shuffle; all draws are made there.
    peptide = "struct<_t: array<string>>"
    parts = windows.join(strings, "tag_mass").select(
        *key, F.struct("site_no", "start", "width", "keep", "alts").alias("w"), F.lit(None).cast(peptide).alias("p")
    )
    met = (
        parts.unionByName(rows.select(*key, F.lit(None).cast(parts.schema["w"].dataType).alias("w"), F.struct("_t").alias("p")))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("w")).alias("w"), F.collect_set("p").alias("_ts"))  # the windows of one spectrum
        .filter(F.size("w") > 0)
    )

    def options(site: Column) -> Column:
        """One stretch's options, its windows in order."""
        mine = F.filter("w", lambda w: w["site_no"] == site)
        spelled = F.transform(mine, lambda w: F.transform(
            F.split(w["alts"], ","), lambda a: F.struct(w["start"], w["width"], F.concat(w["keep"], a).alias("text"))
        ))
        return F.struct(site.alias("site_no"), F.flatten(spelled).alias("options"))

    size = lambda x: F.size(x["options"]).cast("long")
    sites = met.select(*key, "_ts", F.transform(F.array_distinct(F.col("w")["site_no"]), options).alias("s"))
    total = F.aggregate(
        "s", F.lit(1).cast("long"), lambda t, x: F.when(t <= F.lit(_MOST) / size(x), t * size(x)).otherwise(t)
    )
    counted = sites.withColumn("total", total).withColumn("draws", F.least("total", F.lit(n).cast("long")))

    def choose(draw: Column):
        def step(acc: Column, x: Column) -> Column:
            fits = acc["product"] <= F.col("total") / size(x)
            digit = F.when(fits, F.pmod(acc["rest"], size(x))).otherwise(
                F.pmod(_drawn([F.lit(seed), *map(F.col, key), draw, x["site_no"]]), size(x))
            )
            taken = F.get(x["options"], digit.cast("int"))
            return F.struct(
                F.when(fits, F.floor(acc["rest"] / size(x))).otherwise(acc["rest"]).cast("long").alias("rest"),
                F.when(fits, acc["product"] * size(x)).otherwise(acc["product"]).alias("product"),
                F.array_append(acc["chosen"], taken).alias("chosen"),
            )

        return step

    def combination(draw: Column) -> Column:
        low, high = (F.call_function("div", (draw + k) * F.col("total"), F.col("draws")) for k in (0, 1))
        number = low + F.pmod(_drawn([F.lit(seed), *map(F.col, key), draw]), high - low)
        empty = F.array().cast("array<struct<start: int, width: int, text: string>>")
        start = F.struct(number.alias("rest"), F.lit(1).cast("long").alias("product"), empty.alias("chosen"))
        return F.aggregate("s", start, choose(draw), lambda a: a["chosen"])

    def built(chosen: Column, tokens: Column) -> Column:
        return F.aggregate(
            chosen,
            F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.concat(
                    acc["text"],
                    F.array_join(F.slice(tokens, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), ""),
                    x["text"],
                ).alias("text"),
                (x["start"] + x["width"]).alias("at"),
            ),
            lambda acc: F.concat(
                acc["text"], F.array_join(F.slice(tokens, acc["at"] + 1, F.greatest(F.size(tokens) - acc["at"], F.lit(0))), "")
            ),
        )

    chosen = F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), combination)
    drawn = counted.select(*key, "_ts", chosen.alias("chosen"))
    texts = F.flatten(F.transform("_ts", lambda tokens: F.transform("chosen", lambda c: built(c, tokens["_t"]))))
    return drawn.select(*key, F.explode(F.array_distinct(texts)).alias("variant"))


def _terminal_set(
    psms: DataFrame, table: DataFrame, spectrum: Sequence[str], n: int, max_terminal: int, seed: int
) -> DataFrame:
    """Terminal variants per spectrum without its own peptides, at most ``max_terminal``.

    They depend on the set of peptides alone, so each peptide and each set is worked out once and
    only the finished lists are joined to the spectra.
    """
    # Null never equals a spectrum, so nothing is known of spectra without a full key.
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in spectrum])
    sets = (
        psms.groupBy(*spectrum)
        .agg(F.array_sort(F.collect_set("peptide")).alias("_members"))  # the peptides of one spectrum
        .withColumn("_known", known)
    )
    texts = psms.select(F.col("peptide").alias("_id")).distinct().withColumn("peptide", F.col("_id"))
    ends = terminal_variants(texts, table, ["_id"], "n", n, seed=seed).unionByName(
        terminal_variants(texts, table, ["_id"], "c", n, seed=seed)
    )
    ends = ends.groupBy("_id").agg(F.collect_set("variant").alias("_ends"))  # at most 2 n
    own = F.when(F.col("_known"), F.transform("_members", P.drop_charge)).otherwise(F.array().cast("array<string>"))
    hashed = F.transform(
        F.array_except("_all", own),
        lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), v)).alias("h"), v.alias("variant")),
    )
    lists = (
        sets.select("_members", "_known").distinct()
        .select("_members", "_known", F.explode("_members").alias("_id"))
        .join(ends, "_id")
        .groupBy("_members", "_known")
        .agg(F.flatten(F.collect_list("_ends")).alias("_all"))
        .select("_members", "_known", F.slice(F.array_sort(hashed), 1, max_terminal)["variant"].alias("_list"))
    )
    # One row per set: with its size known, spectra are not shuffled where it is small.
    return sets.join(stored(lists), ["_members", "_known"]).select(*spectrum, F.explode("_list").alias("variant"))


#: Peptides of a task of :func:`candidate_set`; each becomes some hundred candidates, which may be sorted there.
TASK_PSMS = 4_000


def candidate_set(
    psms: DataFrame,
    table: DataFrame,
    spectrum: Sequence[str],
    n: int = 100,
    max_terminal: int = 1000,
    seed: int = 0,
) -> DataFrame:
    """Candidates per spectrum from ground truth and non-matching engine peptides.

    ``psms`` holds these peptides with their evidence.  Terminal variants are
    deduplicated, lose peptides an engine proposed and are sampled down to
    ``max_terminal`` (the operator's own limit); ambiguous variants are added.

    Rows are spread by spectrum before anything is made of them, so candidates, which are hundreds per
    spectrum, need no shuffle to be grouped by it.
    """
    spectrum = list(spectrum)
    tasks = max(psms.sparkSession.sparkContext.defaultParallelism, -(-psms.count() // TASK_PSMS))
    spread = psms.select(*spectrum, "peptide", "evidence").repartition(tasks, *spectrum)
    unique = spread.dropDuplicates([*spectrum, "peptide"])
    keyed = unique.withColumn("_id", F.col("peptide"))
    key = [*spectrum, "_id"]
    ends = _terminal_set(unique, table, spectrum, n, max_terminal, seed)
    middle = ambiguous_variants(keyed, table, key, n, seed=seed).select(*spectrum, "variant")
    return ends.withColumn("source", F.lit("Terminal-variant")).unionByName(
        middle.withColumn("source", F.lit("Ambiguous"))
    )
