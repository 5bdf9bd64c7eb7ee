"""Column expressions on ProForma peptide strings, e.g. ``[UNIMOD:1]-PEM[UNIMOD:35]K/2``.

All of them are built-in Spark expressions and stay inside code generation.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from psmweave import constants as K

_TOKEN = r"(\[[^\]]*\]-|[A-Z](?:\[[^\]]*\])*)"
_MISPLACED = "\u0001"  # marks an N-terminal modification found inside a peptide


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column | str, pairs) -> Column:
    """Literal replacements in the given order."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs, _col(c))


def drop_charge(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", 1)


def charge_of(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"/(\d+)$", 1).try_cast("int")


def tokens(c: Column | str) -> Column:
    """Residues with their modifications; an N-terminal modification is its own token."""
    return F.regexp_extract_all(drop_charge(c), F.lit(_TOKEN), F.lit(1))


def letters(c: Column | str) -> Column:
    """Plain residue letters without modifications and charge."""
    return F.regexp_replace(drop_charge(c), r"\[[^\]]*\]-?", "")


def equate_leu_ile(c: Column | str) -> Column:
    """L -> I for residues only; text inside ``[...]`` is a name and stays as it is."""
    return F.regexp_replace(_col(c), r"L(?![^\[]*\])", "I")


def equate_deamidation(c: Column | str) -> Column:
    """I -> L on residues, then deamidated N and Q to their acids."""
    return replace_all(F.regexp_replace(_col(c), r"I(?![^\[]*\])", "L"), K.DEAMIDATION)


def to_letter_string(c: Column | str) -> Column:
    """One character per residue, modifications included."""
    return drop_charge(replace_all(c, K.LETTER_CODE))


def normalise_peptide(c: Column | str, engine: str) -> Column:
    """Engine notation to ProForma.

    Entries are applied in order.  An N-terminal entry replaces one leading
    occurrence; the same text anywhere else makes the peptide null.
    """
    out = _col(c)
    for old, new in K.ENGINE_MODIFICATIONS.get(engine, []):
        if "-" in new:
            # Each step mentions its input once: nested CASEs would multiply the plan.
            text = re.escape(old)
            out = F.regexp_replace(out, f"^{text}", new.replace("$", r"\$"))
            out = F.regexp_replace(out, f"(?<!^){text}", _MISPLACED)
        else:
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(~_col(c).startswith("nan/") & (F.instr(out, _MISPLACED) == 0), out)


def is_valid_peptide(c: Column | str, max_length: int = 30, max_charge: int = 6) -> Column:
    """Readable, 2..max_length residues, charge at most ``max_charge``; null counts as invalid."""
    charges = "|".join(str(z) for z in range(max_charge + 1))
    shape = rf"^(\[[^\]]+\]-)?([A-Z](\[[^\]]+\])*){{2,{max_length}}}(/({charges}))?$"
    return F.coalesce(_col(c).rlike(shape), F.lit(False))


def to_engine_format(c: Column | str, source: str, target: str) -> Column:
    """ProForma to the notation of ``target``; null where ``target`` lacks a modification
    that ``source`` can report.  The charge is dropped."""
    known = {new for _, new in K.ENGINE_MODIFICATIONS[target]}
    foreign = [new for _, new in K.ENGINE_MODIFICATIONS[source] if new not in known]
    lost = reduce(
        lambda acc, m: acc | (F.instr(_col(c), m) > 0), dict.fromkeys(foreign), F.lit(False)
    )
    back = [(new, old) for old, new in K.ENGINE_MODIFICATIONS[target]]
    return F.when(~lost, drop_charge(replace_all(c, back)))


def drop_unsupported_mods(c: Column | str, unsupported=tuple(K.REFINER_UNSUPPORTED)) -> Column:
    """Peptide without charge, or null when it carries a listed modification."""
    hit = reduce(lambda acc, m: acc | (F.instr(_col(c), m) > 0), unsupported, F.lit(False))
    return F.when(~hit, drop_charge(c))


def to_refiner_notation(c: Column | str) -> Column:
    return drop_unsupported_mods(replace_all(c, K.REFINER_NOTATION))


def to_spectralis(c: Column | str) -> Column:
    """Modifications the second refiner does not know are removed."""
    return drop_charge(replace_all(c, K.SPECTRALIS_NOTATION))


def refiner_tokens(c: Column | str) -> Column:
    """Tokens as the refiner input wants them: leading modifications, then residues with theirs.

    Cuts lie before every residue letter, that is a capital outside brackets, and between brackets
    that follow each other; the hyphen behind a terminal modification goes.
    """
    outside = r"(?![^\[(]*[\])])"
    text = F.regexp_replace(_col(c), rf"-{outside}", "")
    return F.filter(
        F.split(text, rf"(?=[A-Z]{outside})|(?<=[\])])(?=[\[(])"), lambda token: token != ""
    )


def split_residues(c: Column | str) -> Column:
    """Split in front of every capital letter."""
    return F.split(_col(c), r"(?<=.)(?=[A-Z])")


def modifications(c: Column | str) -> Column:
    """Distinct modification names, sorted."""
    return F.array_sort(
        F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"\[([^\]]*)\]"), F.lit(1)))
    )


def engine_label(source: Column | str, is_ground_truth: bool = False) -> Column:
    """Canonical engine name; a missing source becomes Ground-Truth or Unspecified."""
    names = F.create_map(*[F.lit(x) for kv in K.ENGINE_LABEL.items() for x in kv])
    fallback = "Ground-Truth" if is_ground_truth else "Unspecified"
    return F.coalesce(F.element_at(names, _col(source)), _col(source), F.lit(fallback))


def _count_of(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))


def residue_mass(c: Column | str) -> Column:
    """Mass of residues and modifications, without water.

    Computed from the composition, so the sum does not depend on residue order.
    """
    plain = letters(c)
    by_mass: dict[float, list[str]] = {}
    for aa, mass in K.RESIDUE_MASS.items():
        by_mass.setdefault(mass, []).append(aa)
    total = F.lit(0.0)
    for mass, group in by_mass.items():
        rest = F.translate(plain, "".join(group), "")
        total = total + (F.length(plain) - F.length(rest)) * F.lit(mass)
    mods = F.lit(0.0)
    for name, mass in K.MODIFICATION_MASS.items():
        mods = mods + _count_of(_col(c), f"[{name}]") * F.lit(mass)
    return total + F.when(F.instr(_col(c), "[") > 0, mods).otherwise(F.lit(0.0))


def peptide_mass(c: Column | str) -> Column:
    """Neutral mass."""
    return residue_mass(c) + F.lit(K.WATER_MASS)


def peptide_mz(c: Column | str, charge: Column | str) -> Column:
    return peptide_mass(c) / _col(charge) + F.lit(K.PROTON_MASS)


def mass_difference(a: Column, b: Column, unit: str = "Da") -> Column:
    diff = a - b
    return diff if unit == "Da" else diff / b * F.lit(1e6)


def precursor_ppm(
    observed: Column, theoretical: Column, charge: Column, isotopes=(-1, 0, 1, 2), cap: float = 50.0
) -> Column:
    """Smallest absolute ppm error over the given isotopes, capped."""
    errors = []
    for i in isotopes:
        shifted = theoretical + F.lit(i * K.NEUTRON_MASS) / charge
        errors.append(F.abs((observed - shifted) / shifted * F.lit(1e6)))
    return F.least(F.lit(float(cap)), *errors)


def matches_precursor(
    theoretical: Column, observed: Column, charge: Column, isotopes=(0, 1), tolerance: float = 50.0
) -> Column:
    """True when any allowed isotope lies within ``tolerance`` ppm of the measured m/z."""
    hits = [
        F.abs(
            (theoretical - (observed - F.lit(i * K.CARBON_ISOTOPE_DELTA) / charge))
            / observed
            * F.lit(1e6)
        )
        < tolerance
        for i in isotopes
    ]
    return reduce(lambda a, b: a | b, hits)
