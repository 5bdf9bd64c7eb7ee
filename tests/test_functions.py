"""Hand cases and properties of the peptide, alignment and edit functions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from psmweave.functions import aligned as A
from psmweave.functions import edits as E
from psmweave.functions import peptide as P

import edit_reference as R

PEPTIDE = st.text(alphabet="GASPVTLINDQKEMHFRYW", min_size=2, max_size=14)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_normalise_peptide(spark):
    cases = [
        ("casanovo", "+42.011M+15.995PEPK/2", "[UNIMOD:1]-M[UNIMOD:35]PEPK/2"),
        ("casanovo", "+43.006-17.027PEPK/2", "[+25.980265]-PEPK/2"),
        ("casanovo", "PEP+42.011K/2", None),
        ("casanovo", "nan/2", None),
        ("pepnet", "CZK/2", "C[UNIMOD:4]M[UNIMOD:35]K/2"),
        ("novob", "Cmnqsty/3", "C[UNIMOD:4]M[UNIMOD:35]N[UNIMOD:7]Q[UNIMOD:7]S[UNIMOD:21]T[UNIMOD:21]Y[UNIMOD:21]/3"),
        ("instanovo", "[UNIMOD:1]PEC(+57.02)K/2", "[UNIMOD:1]-PEC[UNIMOD:4]K/2"),
        ("piprimenovo", "[+42.011]-AC[+57.021]K/2", "[UNIMOD:1]-AC[UNIMOD:4]K/2"),
        ("unknown engine", "PEPK/2", "PEPK/2"),
    ]
    for engine, raw, want in cases:
        assert one(spark, P.normalise_peptide("p", engine), p=raw) == want, (engine, raw)


def test_valid_peptide(spark):
    for text, want in [
        ("PK/2", True), ("K/2", False), ("A" * 30 + "/6", True), ("A" * 31 + "/2", False),
        ("PEPK/7", False), ("pepk/2", False), ("[UNIMOD:1]-PEPM[UNIMOD:35]K/2", True),
    ]:
        assert one(spark, P.is_valid_peptide("p"), p=text) is want, text


def test_tokens_and_masses(spark):
    text = "[UNIMOD:1]-PEM[UNIMOD:35]K/2"
    assert one(spark, P.tokens("p"), p=text) == ["[UNIMOD:1]-", "P", "E", "M[UNIMOD:35]", "K"]
    mass = one(spark, P.peptide_mass("p"), p=text)
    assert abs(mass - (sum(m for _, m in A.residues(text)) + P.K.WATER_MASS)) < 1e-9
    assert one(spark, P.equate_leu_ile("p"), p="LIL[Formula:L]K") == "III[Formula:L]K"
    assert one(spark, P.to_letter_string("p"), p=text) == "zPEvK"
    assert one(spark, P.split_residues("p"), p="AM(ox)K") == ["A", "M(ox)", "K"]


@settings(max_examples=60, deadline=None)
@given(PEPTIDE)
def test_align_with_itself(p):
    got = A.align(p, p)
    assert got["pep_match"] and all(got["aa_match"]) and all(got["match_1"])


@settings(max_examples=60, deadline=None)
@given(PEPTIDE, PEPTIDE)
def test_reversing_swaps_forward_and_backward(p, q):
    f = A.align(p, q, mode="forward")
    b = A.align(p[::-1], q[::-1], mode="backward")
    assert f["match_1"] == b["match_1"][::-1]
    assert f["match_2"] == b["match_2"][::-1]


def test_align_cases():
    assert A.align("GITDEK", "GLTDEK")["pep_match"]  # I and L weigh the same
    got = A.align("GITDEK", "GLDTEK")
    assert got["aa_match"] == [True, True, False, False, True, True]
    got = A.align("GGK", "NK")  # G+G and N weigh the same
    assert got["match_1"] == [False, False, True] and got["match_2"] == [False, True]
    assert A.isobaric_label("Q", "K") == ("Q/K", False)
    assert A.count_novor("PEPTIDE", "PEPTIDE") == 7


def brute(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(brute(a[1:], b) + 1, brute(a, b[1:]) + 1, brute(a[1:], b[1:]) + (a[0] != b[0]))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ABC", max_size=5), st.text(alphabet="ABC", max_size=5))
def test_edit_ops_are_minimal_and_valid(a, b):
    ops = R.edit_ops(a, b)
    assert len(ops) == brute(a, b)
    out, pos = "", 0
    for action, i, j in ops:
        out += a[pos:i]
        pos = i
        if action != "insert":
            pos = i + 1
        if action != "delete":
            out += b[j]
    assert out + a[pos:] == b
    assert E.damerau(a, b) <= len(ops)


def test_edit_hand_cases():
    def sites(a, b, name="forward"):
        return [(s["source"], s["target"]) for s in R.compare_strings(a, b)[name]]

    assert E.damerau("ACB", "ABC") == 1 and E.damerau("CA", "ABC") == 2
    assert sites("ACBDEFGHJJ", "ABCDEFGHIJ") == [("CB", "BC"), ("J", "I")]
    assert sites("ACE", "ABCDE") == [("", "B"), ("", "D")]
    assert sites("ABDEGF", "ABCDEFG") == [("", "C"), ("GF", "FG")]
    assert sites("LPGLYYIETDSTGER", "LPGLYYLETDMDRK") == [("I", "L"), ("STGER", "MDRK")]
    for a, b in [("ACDEFHIJK", "ABCEFGHIJK"), ("ABCDEFGHIJK", "ACDEFGIJ"), ("aGTPGDDEEAQR", "GFPGDDEEAQR")]:
        assert R.compare_strings(a, b)["symmetric"]


def test_mass_neutral_sites_merge():
    # G -> A and A -> G cancel over the correct middle.
    got = R.compare_strings("GVTAK", "AVTGK")
    assert [(s["source"], s["target"]) for s in got["forward"]] == [("G", "A"), ("A", "G")]
    assert [(s["source"], s["target"]) for s in got["forward_merged"]] == [("GVTA", "AVTG")]
    assert R.neutral_runs([14.02, 0.0, -14.02, 5.0], 5.0) == [(0, 2)]
    assert R.neutral_runs([14.02], 14.02) == []


def test_udf_columns(spark):
    rows = spark.createDataFrame([("GITDEK", "GLTDEK"), ("AAK", None)], "a string, b string")
    out = rows.select(
        A.aa_match(F.col("a"), F.col("b"))["pep_match"].alias("m"),
        A.novor_match(F.col("a"), F.col("b")).alias("n"),
        E.damerau_levenshtein(F.col("a"), F.col("b")).alias("d"),
    ).collect()
    assert [tuple(r) for r in out] == [(True, 6, 1), (None, None, None)]


def test_backward_labels_name_the_residues_that_met():
    from psmweave.functions.aligned import align

    assert align("LGG", "IN", mode="backward")["isobaric"] == [{"pair": "L/I", "resolved": False}]
    assert align("GGL", "NI", mode="forward")["isobaric"] == [{"pair": "L/I", "resolved": False}]
    assert [x["pair"] for x in align("GGLK", "NIK", mode="backward")["isobaric"]] == ["K/Q", "L/I"]


def test_moved_residues_belong_to_a_site(spark):
    for a, b, source, target in [("PEPTIDE", "EPPTIDE", "PE", "EP"), ("PETPIDE", "PEPTIDE", "TP", "PT"), ("AKR", "ARK", "KR", "RK")]:
        (site,) = compared(spark, [(a, b)])[0]["forward"]
        assert (site["source"], site["target"]) == (source, target) and site["mass_difference"] == 0


def compared(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "no int, a string, b string")
    return [r["c"].asDict(True) for r in sorted(E.with_comparison(rows, "a", "b", "c").collect())]


def test_comparison_columns_equal_plain_python(spark):
    r = random.Random(3)
    pairs = [("", ""), ("", "AB"), ("AB", ""), ("A", "A"), ("ACBDEFGHJJ", "ABCDEFGHIJ"), ("ACE", "ABCDE"), ("X?", "?X")]
    for _ in range(400):
        a = "".join(r.choice("GAVNKQIm") for _ in range(r.randrange(12)))
        b = list(a)
        for _ in range(r.randrange(5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(3)] = r.choices("GAVNKQIm", k=r.randrange(3))
            b[k : k + 2] = b[k : k + 2][:: r.choice([1, -1])]
        pairs.append((a, "".join(b)))
    names = ("forward", "backward", "forward_merged", "backward_merged")
    rounded = lambda sites: [{**s, "mass_difference": round(s["mass_difference"], 6)} for s in sites]
    for (a, b), got in zip(pairs, compared(spark, pairs), strict=True):
        want = R.compare_strings(a, b)
        assert got["symmetric"] == want["symmetric"]
        assert all(rounded(got[n]) == rounded(want[n]) for n in names), (a, b)
        # The sites' spans rebuild both strings.
        sites = got["forward"]
        assert len(a) - sum(len(s["source"]) for s in sites) == len(b) - sum(len(s["target"]) for s in sites)


def test_neutral_runs_return_to_their_level(spark):
    cases = [([1.0, -1.0, 2.0, 3.0, -5.0], 0.0), ([0.0, 4.0, -1.0], 3.0), ([3.0, 1.0, -1.0], 3.0), ([1.0, 2.0], 0.0), ([], 1.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "no int, d array<double>, p double")
    runs = rows.select("no", E.neutral_runs(F.col("d"), F.col("p")).alias("r")).collect()
    got = [[tuple(x) for x in r.r] for r in sorted(runs)]
    assert got == [[(0, 1), (2, 4)], [(1, 2)], [(1, 2)], [], []] == [R.neutral_runs(*c) for c in cases]
