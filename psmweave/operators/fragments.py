"""Theoretical fragments, peak annotation and the features derived from it (J19, J20, F)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.functions import peptide as P
from psmweave.operators.ranges import binned_range_join
from psmweave.operators.windows import best_annotation, mask_duplicates

# Mass offset of each fragment series relative to its residues.
SERIES_OFFSET = {
    "a": -K.CARBON_MONOXIDE_MASS,
    "b": 0.0,
    "c": K.AMMONIA_MASS,
    "x": K.WATER_MASS + K.CARBON_MONOXIDE_MASS - 2 * K.HYDROGEN_MASS,
    "y": K.WATER_MASS,
    "z": K.WATER_MASS - K.AMMONIA_MASS,
}
# Neutral losses in Dalton.
NEUTRAL_LOSS = {"": 0.0, "-H2O": K.WATER_MASS, "-NH3": K.AMMONIA_MASS}

FROM_C = ("x", "y", "z")


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(0.0))


def residue_masses(peptide: str) -> Column:
    """Masses per residue; an N-terminal modification is added to the first one."""

    def mass(token: Column) -> Column:
        mods = F.regexp_extract_all(token, F.lit(r"\[([^\]]*)\]"), F.lit(1))
        return F.aggregate(
            mods,
            _lookup(K.RESIDUE_MASS, F.substring(token, 1, 1)),
            lambda acc, m: acc + _lookup(K.MODIFICATION_MASS, m),
        )

    all_tokens = P.tokens(peptide)
    masses = F.transform(all_tokens, mass)
    first_is_mod = F.element_at(all_tokens, 1).endswith("-")
    merged = F.concat(
        F.array(F.try_element_at(masses, F.lit(1)) + F.coalesce(F.try_element_at(masses, F.lit(2)), F.lit(0.0))),
        F.slice(masses, F.lit(3), F.size(masses)),
    )
    return F.when(first_is_mod, merged).otherwise(masses)


def theoretical_fragments(
    psms: DataFrame,
    key: Sequence[str],
    series: Sequence[str] = ("b", "y"),
    charges: Sequence[int] = (1, 2),
    losses: Sequence[str] = ("",),
    precursor_charges: int = 0,
) -> DataFrame:
    """One row per fragment: (key, neutral_loss, ion_type, ion_index, charge, site, theo_mz).

    ``ion_type`` is series plus charge, ``site`` the cleavage site counted from the
    N-terminus.  ``precursor_charges`` adds precursor ions p1..pN with site 0.
    """
    base = psms.select(*key, residue_masses("peptide").alias("_m"))
    base = base.withColumn("_n", F.size("_m")).withColumn(
        "_total", F.aggregate("_m", F.lit(0.0), lambda a, x: a + x)
    )
    at_site = F.transform(
        F.sequence(F.lit(1), F.col("_n") - 1),
        lambda i: F.struct(
            i.alias("site"),
            F.aggregate(F.slice("_m", F.lit(1), i), F.lit(0.0), lambda a, x: a + x).alias("prefix"),
        ),
    )
    cut = base.filter("_n > 1").select(*key, "_n", "_total", F.inline(at_site))
    kinds = F.array(
        *[
            F.struct(
                F.lit(s).alias("series"),
                F.lit(z).alias("charge"),
                F.lit(nl).alias("neutral_loss"),
                F.lit(SERIES_OFFSET[s] - NEUTRAL_LOSS[nl]).alias("shift"),
            )
            for s in series
            for z in charges
            for nl in losses
        ]
    )
    ions = cut.select("*", F.inline(kinds))
    from_c = F.col("series").isin(*FROM_C)
    body = F.when(from_c, F.col("_total") - F.col("prefix")).otherwise(F.col("prefix"))
    out = ions.select(
        *key,
        "neutral_loss",
        F.concat("series", F.col("charge").cast("string")).alias("ion_type"),
        F.when(from_c, F.col("_n") - F.col("site")).otherwise(F.col("site")).alias("ion_index"),
        "charge",
        "site",
        ((body + F.col("shift")) / F.col("charge") + F.lit(K.PROTON_MASS)).alias("theo_mz"),
    )
    if precursor_charges:
        p = base.select(*key, "_total", F.explode(F.sequence(F.lit(1), F.lit(precursor_charges))).alias("charge"))
        out = out.unionByName(
            p.select(
                *key,
                F.lit("").alias("neutral_loss"),
                F.concat(F.lit("p"), F.col("charge").cast("string")).alias("ion_type"),
                F.lit(1).alias("ion_index"),
                "charge",
                F.lit(0).alias("site"),
                ((F.col("_total") + K.WATER_MASS) / F.col("charge") + F.lit(K.PROTON_MASS)).alias("theo_mz"),
            )
        )
    return out


def fragment_match(
    fragments: DataFrame,
    peaks: DataFrame,
    on: Sequence[str],
    tolerance: float = 0.02,
    unit: str = "Da",
) -> DataFrame:
    """Observed peaks on theoretical fragments within the tolerance.

    Peaks are ``(on..., mz, intensity)``.  Adds ``exp_mz, intensity, delta``.
    """
    out = binned_range_join(peaks, fragments, "mz", "theo_mz", tolerance, on, unit)
    return out.withColumnRenamed("mz", "exp_mz").withColumn(
        "delta", F.col("exp_mz") - F.col("theo_mz")
    )


def fragment_table(
    matched: DataFrame, ion_types: Sequence[str], neutral_losses: Sequence[str] = ("",)
) -> DataFrame:
    """Only the wanted ion types and losses (F1)."""
    return matched.filter(
        F.col("ion_type").isin(list(ion_types)) & F.col("neutral_loss").isin(list(neutral_losses))
    )


def ion_vectors(
    matched: DataFrame, lengths: DataFrame, key: Sequence[str], value: str = "intensity"
) -> DataFrame:
    """One array per (neutral loss, ion type), a value per cleavage site, 0 = missing (F2).

    x, y and z ions count from the C-terminus.  ``lengths`` has ``n_residues`` per key.
    Several peaks on one ion keep the strongest.
    """
    best = matched.groupBy(*key, "neutral_loss", "ion_type", "site").agg(
        F.max_by(value, "intensity").alias("v")
    )
    per_type = best.groupBy(*key, "neutral_loss", "ion_type").agg(
        F.map_from_entries(F.collect_list(F.struct("site", "v"))).alias("_v")
    )
    return per_type.join(lengths.select(*key, "n_residues"), list(key)).select(
        *key,
        "neutral_loss",
        "ion_type",
        F.transform(
            F.sequence(F.lit(1), F.col("n_residues") - 1),
            lambda s: F.coalesce(F.element_at("_v", s), F.lit(0.0)),
        ).alias("vector"),
    )


def choose_annotation(matched: DataFrame, peak_key: Sequence[str], order=None) -> DataFrame:
    """One annotation per peak."""
    return best_annotation(matched, peak_key, order)


def cleavage_evidence(
    psms: DataFrame,
    matched: DataFrame,
    key: Sequence[str],
    labels: Sequence[str] = ("b1", "b2", "y1", "y2"),
    losses: Sequence[str] = ("",),
) -> DataFrame:
    """Per PSM one flag per cleavage site: some wanted ion was seen."""
    seen = (
        matched.filter(
            F.col("ion_type").isin(list(labels)) & F.col("neutral_loss").isin(list(losses)) & (F.col("intensity") > 0)
        )
        .groupBy(*key)
        .agg(F.collect_set("site").alias("_seen"))
    )  # at most one entry per residue
    n = F.size(residue_masses("peptide"))
    return (
        psms.join(seen, list(key), "left")
        .withColumn(
            "evidence",
            F.transform(
                F.sequence(F.lit(1), n - 1),
                lambda s: F.coalesce(F.array_contains("_seen", s), F.lit(False)),
            ),
        )
        .withColumn("evidence_labels", F.array(*[F.lit(x + nl) for x in labels for nl in losses]))
        .drop("_seen")
    )


def ambiguous_ranges(evidence: Column | str) -> Column:
    """Maximal runs of sites without evidence as [start, end) residue ranges."""
    e = F.col(evidence) if isinstance(evidence, str) else evidence
    n = F.size(e)
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: ~F.get(e, i - 1) & ((i == 1) | F.coalesce(F.get(e, i - 2), F.lit(True))),
    )
    ends = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: ~F.get(e, i - 1) & ((i == n) | F.coalesce(F.get(e, i), F.lit(True))),
    )
    return F.when(
        n > 0,
        F.zip_with(starts, ends, lambda s, t: F.struct((s - 1).alias("start"), (t + 1).alias("end"))),
    ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def residue_tokens(peptide: str) -> Column:
    """Tokens with an N-terminal modification glued to the first residue."""
    t = P.tokens(peptide)
    glued = F.concat(
        F.array(F.concat(F.element_at(t, 1), F.coalesce(F.try_element_at(t, F.lit(2)), F.lit("")))),
        F.slice(t, F.lit(3), F.size(t)),
    )
    return F.when(F.element_at(t, 1).endswith("-"), glued).otherwise(t)


def ambiguous_tags(psms: DataFrame) -> DataFrame:
    """Ranges and tag strings of unsupported stretches."""
    tokens = F.col("_tokens")
    return (
        psms.withColumn("_tokens", residue_tokens("peptide"))
        .withColumn("tag_ranges", ambiguous_ranges("evidence"))
        .withColumn(
            "tags",
            F.transform(
                "tag_ranges",
                lambda r: F.array_join(F.slice(tokens, r["start"] + 1, r["end"] - r["start"]), ""),
            ),
        )
        .drop("_tokens")
    )


def missing_frag_features(psms: DataFrame, evidence: str = "evidence", prefix: str = "") -> DataFrame:
    """Counts of unsupported cleavage sites.

    With no evidence at all the distances from both ends are 0, as a search for the
    first true value gives.
    """
    e = F.col(evidence)
    n = F.size(e)
    sites = F.size(F.filter(e, lambda x: ~x))
    runs = ambiguous_ranges(evidence)
    first = F.array_position(e, True)
    last = F.array_position(F.reverse(e), True)
    names = {
        "missing_frag_sites": sites,
        "missing_frag_pct": F.when(n > 0, sites / n * 100),
        "missing_frag_count": F.size(runs),
        "missing_frag_longest_sequence": F.coalesce(
            F.array_max(F.transform(runs, lambda r: r["end"] - r["start"] - 1)), F.lit(0)
        ),
        "missing_frag_from_n": F.greatest(first - 1, F.lit(0)),
        "missing_frag_from_c": F.greatest(last - 1, F.lit(0)),
    }
    return psms.withColumns({prefix + k: v for k, v in names.items()})


def peak_features(spectra_peaks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Total ion current and peak count from long peaks."""
    return spectra_peaks.groupBy(*key).agg(
        F.sum("intensity").alias("tic"), F.count(F.lit(1)).alias("peak_count")
    )


def hyperscore(matched: DataFrame, key: Sequence[str]) -> DataFrame:
    """ln(n_y! n_b! (sum y + sum b)) over plain b and y ions up to charge 2 (F8).

    An empty series contributes 1 to the sum.
    """
    rows = matched.filter((F.col("neutral_loss") == "") & (F.col("charge") <= 2))
    is_y, is_b = F.col("ion_type").startswith("y"), F.col("ion_type").startswith("b")
    agg = rows.groupBy(*key).agg(
        F.count(F.when(is_y, 1)).alias("n_y"),
        F.count(F.when(is_b, 1)).alias("n_b"),
        F.sum(F.when(is_y, F.col("intensity"))).alias("sum_y"),
        F.sum(F.when(is_b, F.col("intensity"))).alias("sum_b"),
    )

    def ln_factorial(c: str) -> Column:
        return F.when(
            F.col(c) > 1,
            F.aggregate(F.sequence(F.lit(2), F.greatest(F.col(c).cast("int"), F.lit(2))), F.lit(0.0), lambda a, i: a + F.ln(i)),
        ).otherwise(F.lit(0.0))

    total = F.coalesce("sum_y", F.lit(1.0)) + F.coalesce("sum_b", F.lit(1.0))
    return agg.select(
        *key, (ln_factorial("n_y") + ln_factorial("n_b") + F.ln(total)).alias("hyperscore")
    )


# Order in which ion types keep a shared theoretical m/z.
BACKBONE_ORDER = ["y1", "b1", "y2", "b2"]
OTHER_ORDER = ["a1", "a2", "c1", "c2", "x1", "x2", "z1", "z2", "p1", "p2", "p3"]


def explained_intensity(
    theoretical: DataFrame,
    matched: DataFrame,
    tic: DataFrame,
    key: Sequence[str],
    loss: str = "-H2O",
) -> DataFrame:
    """Shares of the total ion current explained by y, b, b+y, losses and all ions.

    Ions with the same theoretical m/z count once, for the preferred type: backbone ions,
    their losses, other ions, their losses.
    """
    order = (
        [("", t) for t in BACKBONE_ORDER]
        + [(loss, t) for t in BACKBONE_ORDER]
        + [("", t) for t in OTHER_ORDER]
        + [(loss, t) for t in OTHER_ORDER]
    )
    label = F.concat_ws("|", "neutral_loss", "ion_type")
    index = F.element_at(
        F.create_map(*[F.lit(x) for i, (nl, t) in enumerate(order) for x in (f"{nl}|{t}", i)]), label
    )
    ion = [*key, "neutral_loss", "ion_type", "ion_index"]
    seen = matched.groupBy(*ion).agg(F.max("intensity").alias("intensity"))
    theo = theoretical.withColumn("_pref", index).filter("_pref IS NOT NULL")

    def kept(rows: DataFrame) -> DataFrame:
        # Sizes that Spark expects leave out how many ions a peptide has.
        ok = mask_duplicates(rows.select(*ion, "theo_mz", "_pref"), key, "theo_mz", F.col("_pref"))
        return ok.hint("merge").join(seen, ion)

    backbone = F.col("_pref") < len(BACKBONE_ORDER)
    by = kept(theo.filter(backbone)).groupBy(*key).agg(F.sum("intensity").alias("by"))
    everything = kept(theo).groupBy(*key).agg(F.sum("intensity").alias("all"))
    plain = seen.filter(F.col("neutral_loss") == "")
    series = plain.groupBy(*key).agg(
        F.sum(F.when(F.col("ion_type").isin("y1", "y2"), F.col("intensity"))).alias("y"),
        F.sum(F.when(F.col("ion_type").isin("b1", "b2"), F.col("intensity"))).alias("b"),
    )
    out = tic.select(*key, "tic")
    for part in (series, by, everything):
        out = out.join(part, list(key), "left")
    out = out.na.fill(0.0, subset=["y", "b", "by", "all"])
    t = F.col("tic")
    return out.select(
        *key,
        (F.col("y") / t).alias("explained_y_pct"),
        (F.col("b") / t).alias("explained_b_pct"),
        (F.col("by") / t).alias("explained_by_pct"),
        ((F.col("all") - F.col("by")) / t).alias("explained_nl_pct"),
        (F.col("all") / t).alias("explained_all_pct"),
    )


def ppm_features(
    psms: DataFrame, matched: DataFrame, key: Sequence[str], precursor: str = "precursor_mz"
) -> DataFrame:
    """Absolute mean ppm error of y, b and all ions, -1 without ions, and precursor ppm."""
    rows = matched.filter((F.col("neutral_loss") == "") & F.col("ion_type").isin(*BACKBONE_ORDER))
    best = rows.groupBy(*key, "ion_type", "ion_index").agg(
        F.max_by(F.struct("theo_mz", "exp_mz"), "intensity").alias("p")
    )
    ppm = (F.col("p.theo_mz") - F.col("p.exp_mz")) / F.col("p.theo_mz") * F.lit(1e6)
    is_y = F.col("ion_type").startswith("y")
    agg = best.withColumn("ppm", ppm).groupBy(*key).agg(
        F.abs(F.avg(F.when(is_y, F.col("ppm")))).alias("ppm_mean_y"),
        F.abs(F.avg(F.when(~is_y, F.col("ppm")))).alias("ppm_mean_b"),
        F.abs(F.avg("ppm")).alias("ppm_mean_all"),
    )
    theo = P.peptide_mz("peptide", "charge")
    return (
        psms.select(*key, P.precursor_ppm(F.col(precursor), theo, F.col("charge")).alias("ppm_precursor"))
        .join(agg, list(key), "left")
        .na.fill(-1.0, subset=["ppm_mean_y", "ppm_mean_b", "ppm_mean_all"])
    )


def isotope_peaks(
    matched: DataFrame,
    peaks: DataFrame,
    on: Sequence[str],
    ion: Sequence[str],
    n_isotopes: int = 5,
    spacing: float = K.ISOTOPE_SPACING,
    tolerance: float = 0.02,
) -> DataFrame:
    """Isotope chain of every annotated ion: the monoisotopic peak (0) and its followers.

    Followers lie at multiples of ``spacing / charge``; the strongest peak in the window
    wins and the chain ends at the first gap.
    """
    mono = matched.groupBy(*ion).agg(
        F.max(F.struct("intensity", F.col("exp_mz").alias("mz"), "charge")).alias("m")
    )
    wanted = mono.select(
        *ion,
        F.col("m.mz").alias("_mono"),
        F.col("m.charge").alias("_z"),
        F.explode(F.sequence(F.lit(1), F.lit(n_isotopes - 1))).alias("isotope_no"),
    ).withColumn("_want", F.col("_mono") + F.col("isotope_no") * F.lit(spacing) / F.col("_z"))
    hits = (
        binned_range_join(peaks.select(*on, "mz", "intensity"), wanted, "mz", "_want", tolerance, on)
        .groupBy(*ion, "isotope_no")
        .agg(F.max(F.struct("intensity", "mz")).alias("p"))
    )
    found = hits.groupBy(*ion).agg(F.array_sort(F.collect_list(F.struct("isotope_no", "p"))).alias("c"))
    chain = F.filter("c", lambda x, i: x["isotope_no"] == i + 1)
    # The sorted list loses its tail at the first number that is out of place.
    followers = found.select(*ion, F.explode(chain).alias("x")).select(
        *ion, "x.isotope_no", F.col("x.p.mz").alias("mz"), F.col("x.p.intensity").alias("intensity")
    )
    start = mono.select(
        *ion, F.lit(0).alias("isotope_no"), F.col("m.mz").alias("mz"), F.col("m.intensity").alias("intensity")
    )
    return start.unionByName(followers)


def isotope_intensity_features(
    psms: DataFrame, isotopes: DataFrame, totals: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Intensity shares including isotopes, annotated peak share, precursor error.

    ``totals`` has ``tic, peak_count``; ``isotopes`` the chains of b, y and precursor ions.
    """
    t = F.col("ion_type")

    def part(prefix: str) -> Column:
        return F.coalesce(F.sum(F.when(t.startswith(prefix), F.col("intensity"))), F.lit(0.0))

    agg = isotopes.filter(F.substring(t, 1, 1).isin("b", "y", "p")).groupBy(*key).agg(
        part("y").alias("y"), part("b").alias("b"), part("p").alias("p"),
        F.count(F.when(F.col("intensity") > 0, 1)).alias("n"),
    )
    theo = P.peptide_mz("peptide", "charge")
    obs = F.col("precursor_mz")
    out = psms.select(
        *key,
        P.mass_difference(theo, obs, "ppm").alias("precursor_err_ppm"),
        P.mass_difference(theo, obs).alias("precursor_err_da"),
    )
    out = out.join(totals.select(*key, "tic", "peak_count"), list(key)).join(agg, list(key), "left")
    out = out.na.fill(0.0, subset=["y", "b", "p"]).na.fill(0, subset=["n"])
    y, b, p = F.col("y"), F.col("b"), F.col("p")
    return out.select(
        *key,
        (y / F.col("tic")).alias("y_pct"),
        (b / F.col("tic")).alias("b_pct"),
        (p / F.col("tic")).alias("p_pct"),
        F.when(y + b + p > 0, (y + b) / (y + b + p)).alias("fragmented_pct"),
        (F.col("n") / F.col("peak_count")).alias("pct_peaks_annotated"),
        (p > 0).alias("precursor_peak_present"),
        "precursor_err_ppm",
        "precursor_err_da",
    )


def neutral_loss_evidence(
    psms: DataFrame, matched: DataFrame, key: Sequence[str], losses: Sequence[str] = ("-H2O", "-NH3")
) -> DataFrame:
    """Missing-fragment features where water and ammonia losses count as evidence."""
    wide = cleavage_evidence(psms, matched, key, losses=("", *losses))
    return missing_frag_features(wide, prefix="NL_")


def ion_counts(matched: DataFrame, lengths: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number and share of observed ions per type."""
    n = (
        matched.select(*key, "ion_type", "ion_index")
        .distinct()
        .groupBy(*key, "ion_type")
        .agg(F.count(F.lit(1)).alias("n_ions"))
    )
    return n.join(lengths.select(*key, "n_residues"), list(key)).select(
        *key, "ion_type", "n_ions", (F.col("n_ions") / (F.col("n_residues") - 1)).alias("share")
    )


@dataclass(frozen=True)
class Annotated:
    """What feature generators may read: PSMs, their peaks, theoretical and matched fragments, isotopes."""

    psms: DataFrame
    peaks: DataFrame
    theoretical: DataFrame
    matched: DataFrame
    isotopes: DataFrame
    key: Sequence[str]


Generator = Callable[[Annotated], DataFrame]
GENERATORS: dict[str, Generator] = {}


def register_generator(name: str) -> Callable[[Generator], Generator]:
    """Plug in a feature generator by name: annotated spectra in, (key, features) out."""

    def add(fn: Generator) -> Generator:
        GENERATORS[name] = fn
        return fn

    return add


def _features(rows: DataFrame, x: Annotated) -> DataFrame:
    return rows.select(*x.key, *[c for c in rows.columns if c not in {*x.psms.columns, "evidence", "evidence_labels"}])


@register_generator("missing_fragmentation")
def _missing(x: Annotated) -> DataFrame:
    return _features(missing_frag_features(cleavage_evidence(x.psms, x.matched, x.key)), x)


@register_generator("peaks")
def _peaks(x: Annotated) -> DataFrame:
    return peak_features(x.peaks, x.key)


@register_generator("hyperscore")
def _hyperscore(x: Annotated) -> DataFrame:
    return hyperscore(x.matched, x.key)


@register_generator("explained_intensity")
def _explained(x: Annotated) -> DataFrame:
    return explained_intensity(x.theoretical, x.matched, peak_features(x.peaks, x.key), x.key)


@register_generator("ppm_error")
def _ppm_error(x: Annotated) -> DataFrame:
    return ppm_features(x.psms, x.matched, x.key)


@register_generator("isotope_intensity")
def _isotope_intensity(x: Annotated) -> DataFrame:
    return isotope_intensity_features(x.psms, x.isotopes, peak_features(x.peaks, x.key), x.key)


@register_generator("neutral_loss")
def _neutral_loss(x: Annotated) -> DataFrame:
    return _features(neutral_loss_evidence(x.psms, x.matched, x.key), x)


def generate_features(x: Annotated, names: Sequence[str]) -> DataFrame:
    """PSMs with the features of the named generators; PSMs that lack one are dropped."""
    unknown = [n for n in names if n not in GENERATORS]
    if unknown:
        raise ValueError(f"unknown generators {unknown}; known: {', '.join(sorted(GENERATORS))}")
    return feature_table(x.psms, [GENERATORS[n](x) for n in names], x.key)


def feature_table(
    psms: DataFrame, parts: Sequence[DataFrame], key: Sequence[str], required: Sequence[str] | None = None
) -> DataFrame:
    """Join feature tables and drop PSMs that lack any required feature."""
    out = psms
    names: list[str] = []
    for part in parts:
        out = out.join(part, list(key), "left")
        names += [c for c in part.columns if c not in key]
    return out.na.drop(subset=list(required) if required is not None else names)


def regenerate(features: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace a subset of feature columns by newly computed ones."""
    new = [c for c in fresh.columns if c not in key]
    return features.drop(*new).join(fresh, list(key), "left")
