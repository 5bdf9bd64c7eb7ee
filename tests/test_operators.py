"""Operators: hand cases, properties, and the two ways of sorting large groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from psmweave.operators import candidates as G
from psmweave.operators import compare as C
from psmweave.operators import confidence as M
from psmweave.operators import containment as N
from psmweave.operators import curves as U
from psmweave.operators import filters as X
from psmweave.operators import fragments as E
from psmweave.operators import joins as J
from psmweave.operators import summary as S
from psmweave.operators import windows as W
from psmweave.operators.ranges import binned_range_join
from psmweave.operators.running import attach_group_values, rank_rows, running


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    data = [
        ("hot" if rnd.random() < 0.6 else rnd.choice("ab"), i, rnd.choice([0.1, 0.5, 0.5, 0.9, rnd.random()]), rnd.random() < 0.5)
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "engine string, spectrum_id long, score double, correct boolean").persist()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("fn", ["sum", "min", "max"])
def test_running_split_equals_single(skewed, inclusive, fn):
    order = [("score", False), ("spectrum_id", True)]
    got = [
        rows(running(skewed, ["engine"], order, {"x": (fn, "spectrum_id")}, inclusive, how, parts=7))
        for how in ("single", "split")
    ]
    assert got[0] == got[1]


@pytest.mark.parametrize("method", ["dense", "min", "first"])
def test_rank_split_equals_single(skewed, method):
    order = [("score", False)] + ([("spectrum_id", True)] if method == "first" else [])
    got = [rows(rank_rows(skewed, ["engine"], order, method, "r", how).select("engine", "spectrum_id", "r")) for how in ("single", "split")]
    assert got[0] == got[1]


def test_group_values_both_ways(skewed):
    got = [
        rows(attach_group_values(skewed, ["engine"], {"m": F.max("score"), "n": F.count(F.lit(1))}, fits))
        for fits in (True, False)
    ]
    assert got[0] == got[1]


def test_curves_split_equals_single_and_properties(skewed):
    n = F.lit(5000)
    a = U.precision_coverage(skewed, n, strategy="single")
    b = U.precision_coverage(skewed, n, strategy="split")
    assert rows(a) == rows(b)
    assert a.filter("precision < 0 OR precision > 1 OR recall > 1").count() == 0
    exact = U.exact_pr_curve(skewed.withColumnRenamed("correct", "match"), ["engine"])
    falling = exact.filter("engine = 'hot'").orderBy(F.desc("score")).collect()
    recalls = [r["recall"] for r in falling]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    assert rows(U.pr_auc(skewed, strategy="single").select("engine", F.round("auc", 9))) == rows(
        U.pr_auc(skewed, strategy="split").select("engine", F.round("auc", 9))
    )
    shares = U.cumulative_share(skewed.withColumn("v", F.col("spectrum_id") % 7), ["engine"], "v")
    assert all(abs(r[0] - 1) < 1e-9 for r in shares.groupBy("engine").agg(F.sum("share")).select("sum(share)").collect())


def test_strict_thresholds(spark):
    df = spark.createDataFrame([("e", 0.2, False), ("e", 0.5, True), ("e", 0.5, True), ("e", 0.9, True)], "engine string, score double, correct boolean")
    row = U.precision_coverage(df, F.lit(4)).filter("score = 0.5").first()
    assert (row.tp, row.fp, row.fn, row.u) == (1, 0, 0, 1)
    assert U.threshold_at_precision(U.precision_coverage(df, F.lit(4)), 0.9).first().score == 0.2


def test_best_of_two(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, 3.0, 2.0), (2, 0.5, 0.5, 2.0, -2.0), (3, 0.5, 0.5, 1.0, -2.0), (4, 0.6, 0.5, 9.0, 0.0)],
        "id int, probability_forward double, probability_reverse double, mass_forward double, mass_reverse double",
    )
    out = X.best_of_two(df, ["probability", "mass"]).orderBy("id").select("direction").collect()
    assert [r[0] for r in out] == ["reverse", "reverse", "forward", "forward"]


def test_missing_fragment_vectors(spark):
    T, Fa = True, False
    df = spark.createDataFrame([(1, [T] * 4), (2, [Fa, Fa, T, Fa]), (3, [Fa] * 4)], "id int, evidence array<boolean>")
    out = E.missing_frag_features(df).orderBy("id").collect()
    names = ["sites", "count", "longest_sequence", "from_n", "from_c"]
    got = [tuple(r[f"missing_frag_{n}"] for n in names) for r in out]
    assert got == [(0, 0, 0, 0, 0), (3, 2, 2, 2, 1), (4, 1, 4, 0, 0)]
    assert [r.missing_frag_pct for r in out] == [0.0, 75.0, 100.0]
    spans = df.select("id", E.ambiguous_ranges("evidence").alias("r")).orderBy("id").collect()
    assert [[tuple(x) for x in r.r] for r in spans] == [[], [(0, 3), (3, 5)], [(0, 5)]]


def test_hyperscore(spark):
    df = spark.createDataFrame(
        [(1, "", "b1", 1, 2.0), (1, "", "b1", 1, 3.0), (1, "", "y1", 1, 5.0), (1, "-H2O", "y1", 1, 50.0), (2, "", "y1", 1, 4.0)],
        "id int, neutral_loss string, ion_type string, charge int, intensity double",
    )
    out = {r.id: r.hyperscore for r in E.hyperscore(df, ["id"]).collect()}
    assert abs(out[1] - math.log(20)) < 1e-9
    assert abs(out[2] - math.log(5)) < 1e-9  # the empty series counts 1


def test_fragments_of_modified_peptide(spark):
    df = spark.createDataFrame([(1, "[UNIMOD:1]-GAK")], "id int, peptide string")
    out = {(r.ion_type, r.ion_index): r.theo_mz for r in E.theoretical_fragments(df, ["id"], charges=(1,), precursor_charges=2).collect()}
    g, a, k = 57.021463719204, 71.037113783, 128.094963010536
    assert abs(out["b1", 1] - (42.010565 + g + 1.007276466812)) < 1e-9
    assert abs(out["y1", 1] - (k + 18.0105646837 + 1.007276466812)) < 1e-9
    assert abs(out["p2", 1] - ((42.010565 + g + a + k + 18.0105646837) / 2 + 1.007276466812)) < 1e-9


def test_isotope_chain_stops_at_gap(spark):
    matched = spark.createDataFrame([(1, "y1", 1, 100.0, 10.0, 1)], "s int, ion_type string, ion_index int, exp_mz double, intensity double, charge int")
    peaks = spark.createDataFrame([(1, 100.0, 10.0), (1, 101.0034, 5.0), (1, 101.0100, 6.0), (1, 103.01, 3.0)], "s int, mz double, intensity double")
    out = E.isotope_peaks(matched, peaks, ["s"], ["s", "ion_type", "ion_index"]).orderBy("isotope_no").collect()
    assert [(r.isotope_no, r.intensity) for r in out] == [(0, 10.0), (1, 6.0)]


@pytest.mark.parametrize("unit,tol", [("Da", 0.02), ("ppm", 30.0)])
def test_range_join_equals_brute_force(spark, unit, tol):
    rnd = random.Random(5)
    left = [(i, rnd.uniform(100, 101.5)) for i in range(120)]
    right = [(i, rnd.uniform(100, 101.5)) for i in range(120)] + [(999, left[0][1])]
    want = sorted(
        (i, j) for i, a in left for j, b in right if (abs(a - b) if unit == "Da" else abs(a - b) / b * 1e6) < tol
    )
    out = binned_range_join(
        spark.createDataFrame(left, "i int, a double"), spark.createDataFrame(right, "j int, b double"), "a", "b", tol, unit=unit
    )
    assert sorted((r.i, r.j) for r in out.collect()) == want


def test_containment_equals_brute_force(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("GAL") for _ in range(n))
    proteins = [(i, text(rnd.choice([3, 40, 300, 1300]))) for i in range(25)] + [(99, "GAGA" * 200)]
    peps = [p[1][s : s + n] for p in proteins for s, n in [(0, 5), (7, 12), (100, 30), (118, 25), (250, 160)]]
    peps = sorted({p for p in peps if p} | {text(n) for n in (2, 4, 9, 13)} | {"GAGAGAGAGAGAGA"})
    fold = lambda s: s.replace("L", "I")
    want = sorted((p, i) for p in peps for i, s in proteins if fold(p) in fold(s))
    got = N.kmer_contains_join(
        spark.createDataFrame([(p,) for p in peps], "peptide string"),
        spark.createDataFrame(proteins, "protein_id int, sequence string"),
    )
    assert sorted(map(tuple, got.collect())) == want


def test_q_values(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame(
        [(i, round(rnd.random() + (0 if i % 3 == 0 else 0.4), 2), i % 3 == 0) for i in range(400)], "id int, score double, is_decoy boolean"
    )
    single, split = (M.q_values(df, strategy=s) for s in ("single", "split"))
    assert rows(single.select("id", "qvalue")) == rows(split.select("id", "qvalue"))
    q = [r.qvalue for r in single.orderBy(F.desc("score")).collect()]
    assert q == sorted(q) and max(q) <= 1


def test_rescoring_improves_and_is_repeatable(spark, tmp_path):
    rnd = random.Random(2)
    data = [
        ("r", i, i % 2 == 0, rnd.gauss(0 if i % 2 == 0 else 1.5, 1), rnd.gauss(0 if i % 2 == 0 else 1.5, 1)) for i in range(600)
    ]
    df = spark.createDataFrame(data, "run string, spectrum_id int, is_decoy boolean, a double, b double")
    models = M.rescoring_train(df, ["a", "b"], train_fdr=0.1, rounds=1, iterations=10)
    scored = M.rescoring_apply(df, models)
    means = {r.is_decoy: r.m for r in scored.groupBy("is_decoy").agg(F.avg("score_rescored").alias("m")).collect()}
    assert means[False] > means[True]
    models.save(spark, str(tmp_path / "m"))
    again = M.rescoring_apply(df, M.FoldModels.load(spark, str(tmp_path / "m"), ["a", "b"]))
    assert rows(again.select("spectrum_id", F.round("score_rescored", 9))) == rows(scored.select("spectrum_id", F.round("score_rescored", 9)))


def _plain_em(x, k, tol=1e-3):
    """The same mixture by a loop over plain lists."""
    from statistics import NormalDist, pvariance

    n, mean, var = len(x), sum(x) / len(x), pvariance(x)
    w, mu, v = [1 / k] * k, [mean + NormalDist().inv_cdf((j + 0.5) / k) * var**0.5 for j in range(k)], [var / k + 1e-6] * k
    before = -math.inf
    while True:
        dens = [[w[j] * math.exp(-((s - mu[j]) ** 2) / (2 * v[j])) / math.sqrt(2 * math.pi * v[j]) for j in range(k)] for s in x]
        like = sum(math.log(sum(d)) for d in dens)
        if abs(like - before) < tol * n:
            return like, w, mu, v
        before = like
        share = [[y / sum(d) for y in d] for d in dens]
        for j in range(k):
            c = sum(r[j] for r in share)
            w[j], mu[j] = c / n, sum(r[j] * s for r, s in zip(share, x)) / c
            v[j] = sum(r[j] * (s - mu[j]) ** 2 for r, s in zip(share, x)) / c + 1e-6


def test_mixtures_equal_plain_em(spark):
    from psmweave.operators.mixtures import fit_mixtures

    rnd = random.Random(4)
    x = {g: [round(rnd.gauss(0, 1) if rnd.random() < 0.4 else rnd.gauss(4 + g, 0.7), 2) for _ in range(400)] for g in range(3)}
    odd = [("0", None), ("1", float("nan")), (None, 1.0)]
    df = spark.createDataFrame([(str(g), s) for g, xs in x.items() for s in xs] + odd, "engine string, score double")
    found = fit_mixtures(df, components=(1, 2, 4))
    assert len(found) == 9
    for (g, k), m in found.items():
        like, w, mu, v = _plain_em(x[int(g)], k)
        assert abs(m.log_likelihood - like) < 1e-6 * abs(like) and m.n == 400
        for got, want in ((m.weights, w), (m.means, mu), (m.variances, v)):
            assert all(abs(a - b) < 1e-6 for a, b in zip(got, [b for _, b in sorted(zip(mu, want))]))
    assert fit_mixtures(df.limit(0)) == {}
    marked = M.gmm_by_engine(df)
    assert marked.filter("gmm_cluster IS NULL").count() == 3
    top = marked.filter("gmm_cluster = 1").groupBy("engine").agg(F.min("score").alias("m")).collect()
    assert {r.engine: r.m > 1 for r in top} == {"0": True, "1": True, "2": True}
    one = spark.createDataFrame([("e", 1.0)] * 5, "engine string, score double")
    assert {r.gmm_cluster for r in M.gmm_by_engine(one).collect()} == {1}


def _dense_svm(z, y, penalty):
    """Minimum of the squared hinge loss by plain gradient descent."""
    import numpy as np

    w = np.zeros(z.shape[1])
    rate = 1 / (2 * (np.linalg.norm(z, 2) ** 2 / len(z) + penalty.max()))
    for _ in range(60_000):
        gap = np.maximum(1 - y * (z @ w), 0)
        grad = -2 * (z.T @ (y * gap)) / len(z) + 2 * penalty * w
        w = w - rate * grad
        if np.abs(grad).max() < 1e-10:
            break
    return w


def test_joint_training_minimises_the_loss(spark):
    import numpy as np

    rnd = random.Random(9)
    data = [
        ("r", i, i % 3 == 0, rnd.gauss(0 if i % 3 == 0 else 1, 1), 10 * rnd.gauss(0 if i % 3 == 0 else 0.5, 1),
         None if i % 50 == 0 else rnd.gauss(0, 1)) for i in range(900)
    ]
    df = spark.createDataFrame(data, "run string, spectrum_id int, is_decoy boolean, a double, b double, c double")
    sets = {"a": ["a"], "ab": ["a", "b"], "all": ["c", "b", "a"]}
    models = M.train_sets(df, sets, train_fdr=0.2, rounds=1)
    folds = {r.spectrum_id: r.fold for r in M.with_fold(df).collect()}
    for name, features in sets.items():
        for fold in range(3):
            rows_ = [r for r in data if folds[r[1]] != fold]
            full = [r for r in rows_ if None not in (r[3 + "abc".index(f)] for f in features)]
            x = np.array([[r[3 + "abc".index(f)] for f in features] for r in full])
            decoy = np.array([r[2] for r in full])
            # The start: the feature and direction that accept most targets among all training rows.
            best = None
            for f in features:
                for sign in (1, -1):
                    s = [(sign * r[3 + "abc".index(f)], r[2]) for r in rows_ if r[3 + "abc".index(f)] is not None]
                    for cut in sorted({v for v, _ in s}):
                        t, d = (sum(v >= cut and q == want for v, q in s) for want in (False, True))
                        if t and (d + 1) / t <= 0.2:
                            best = max(best or (0,), (t, f, sign, cut), key=lambda o: o[0])
                            break
            use = decoy | (best[2] * x[:, features.index(best[1])] >= best[3] - 1e-9) if best else decoy
            mean, scale = x.mean(axis=0), x.std(axis=0)
            z = np.column_stack([(x - mean) / scale, np.ones(len(x))])[use]
            want = _dense_svm(z, np.where(decoy[use], -1.0, 1.0), np.array([0.01] * len(features) + [1e-9]))
            assert np.allclose(models[name].weights[fold], want[:-1], atol=1e-3), (name, fold)


def test_accepted_counts_equal_q_values(spark):
    df = spark.range(300).selectExpr("id % 5 = 0 AS is_decoy", "CAST(id * 37 % 101 AS DOUBLE) + id % 5 AS x", "CAST(id % 7 AS DOUBLE) AS y")
    models = {"x": M.FoldModels(["x"], [[1.0], [3.0]], [0.0, 1.0], [[1.0], [3.0]]), "xy": M.FoldModels(["x", "y"], [[1.0, -2.0]], [0.5], [[1.0, -2.0]])}
    got = {(r.features, r.psm_type): r.n for r in M.accepted_by_models(df, models, cutoff=0.2).collect()}
    for name, m in models.items():
        q = M.q_values(M.rescoring_apply(df, m), "score_rescored")
        accepted = q.filter("NOT is_decoy AND qvalue < 0.2").count()
        assert got.get((name, "target_accepted"), 0) == accepted
        assert got[name, "decoy"] == 60 and got.get((name, "target_rejected"), 0) == 240 - accepted


def test_gmm_threshold():
    params = M.TwoGaussians((0.0, 5.0), (1.0, 1.0), (0.5, 0.5))
    t = M.gmm_fdr_threshold(params, 0.01)
    low = 0.5 * math.erfc(t / math.sqrt(2))
    high = 0.5 * math.erfc(-(t - 5) / math.sqrt(2))
    assert abs(low - 0.01 * high) < 1e-9


def test_mass_table_and_variants_keep_mass(spark):
    table = G.mass_table(spark, (2, 3), ["G", "A", "S", "V", "N", "Q", "K"])
    assert table.agg(F.sum(F.size("aa"))).first()[0] == 7**2 + 7**3
    psms = spark.createDataFrame([(1, "GGNAKQ", [False, True, False, False, True])], "id int, peptide string, evidence array<boolean>")
    for out in (
        G.terminal_variants(psms, table, ["id"], "n"),
        G.terminal_variants(psms, table, ["id"], "c"),
        G.ambiguous_variants(psms, table, ["id"], n=20),
    ):
        from psmweave.functions.peptide import residue_mass

        got = out.select("variant", residue_mass("variant").alias("m")).collect()
        base = spark.createDataFrame([("GGNAKQ",)], "p string").select(residue_mass("p")).first()[0]
        assert got and all(abs(r.m - base) < 0.05 for r in got)
    with pytest.raises(ValueError):
        G.terminal_variants(psms, table, ["id"], "x")


def test_refinement_matching(spark):
    psms = spark.createDataFrame(
        [("r", 1, "e", 1, "AAK", 0.5), ("r", 2, "e", 1, "AAK", 0.5), ("r", 2, "e", 2, "GGK", 0.4)],
        "run string, spectrum_id int, engine string, rank int, peptide string, score double",
    )
    ref = spark.createDataFrame(
        [("r", 1, "e", "x", 7, "AAK", 0.9), ("r", 2, "e", "x", 2, "GVK", 0.8), ("r", 2, "e", "x", 9, "GVK", 0.8), ("r", 3, "e", "x", 1, "GVK", 0.8)],
        "run string, spectrum_id int, engine string, refiner string, rank int, refined_peptide string, refined_score double",
    )
    out = J.attach_refinement(psms, ref)
    got = sorted((r.spectrum_id, r.status, r["rank"], r.unchanged, r.refined_peptide) for r in out.collect() if r.status == "matched")
    assert got == [(1, "matched", 1, True, None), (2, "matched", 2, False, "GVK")]
    assert sorted(r.status for r in out.collect()) == ["ambiguous", "matched", "matched", "no_base"]


def test_errors_are_raised(spark):
    a = spark.createDataFrame([("r", 1), ("r", 2)], "run string, ordinal long")
    b = spark.createDataFrame([("r", 1)], "run string, ordinal long")
    with pytest.raises(ValueError):
        J.join_by_key(a, b, ["run", "ordinal"], require_all=True)
    with pytest.raises(ValueError):
        J.zip_positional(a, b)
    bad = spark.createDataFrame([("r", "id|1", "PEP", "e")], "run string, spectrum_id string, peptide string, engine string")
    with pytest.raises(Exception, match="separator"):
        S.group_engines(bad).collect()


def test_rank_of_truth(spark):
    df = spark.createDataFrame(
        [("r", 1, True, "match", 0.5), ("r", 1, False, "match", 0.7), ("r", 1, False, "Higher score", 0.7), ("r", 1, False, "Higher score", 0.8), ("r", 2, False, "Different", 0.1)],
        "run string, spectrum_id int, is_gt boolean, error_type string, score double",
    )
    got = {r.spectrum_id: r.rank_score for r in W.rank_of_truth(df, ["score"]).collect()}
    assert got == {1: 2, 2: -1}


def test_error_type_isobaric_peak(spark):
    T, Fa = True, False
    df = spark.createDataFrame(
        [
            (1, "GASK", "AGSK", [Fa, Fa, T], [Fa, Fa, T], 0.5, 0.4),
            (2, "GASK", "AGSK", [T, T, T], [Fa, T, T], 0.5, 0.4),
            (3, "GASK", "GASK", [T, T, T], [T, T, T], 0.5, 0.4),
            (4, "GASK", "VVSK", None, None, None, 0.4),
        ],
        "id int, gt_peptide string, peptide string, gt_ev array<boolean>, ev array<boolean>, score double, gt_score double",
    )
    got = {r.id: r.error_type for r in C.error_type(df, "ev", "gt_ev").collect()}
    assert got == {1: "isobaric_peak", 2: "Higher score", 3: "match", 4: "Different"}


def test_t_test_matches_known_value():
    assert abs(S._t_two_sided(2.0, 10) - 0.07338803) < 1e-6
    assert abs(S._t_two_sided(-1.0, 3) - 0.39100222) < 1e-6


def test_aa_scores_leading_extra(spark):
    df = spark.createDataFrame([(1, [0.2, 0.4, 0.9], [True, False])], "id int, aa_scores array<double>, aa_match array<boolean>")
    out = U.aa_score_rows(df, ["id"]).orderBy("pos").collect()
    assert [(round(r.score, 6), r.correct) for r in out] == [(0.3, True), (0.9, False)]


def test_rescoring_loads_saved_models(spark, tmp_path):
    from psmweave.operators import confidence as M
    from psmweave.plans.rescoring import rescore_with_models

    df = spark.range(400).selectExpr(
        "concat('run_', CAST(id % 2 AS STRING)) AS run", "id AS spectrum_id", "concat('engine_', CAST(id % 3 AS STRING)) AS engine",
        "id % 4 = 3 AS is_decoy", "CAST(CASE WHEN id % 4 = 3 THEN id % 50 ELSE id % 90 + 20 END AS DOUBLE) AS score",
        "CAST(id % 7 AS DOUBLE) AS other",
    )
    out, models = str(tmp_path / "out"), str(tmp_path / "models")
    features = ["score", "other"]
    small = {"rounds": 1, "iterations": 3, "train_fdr": 0.1}
    first = rescore_with_models(df.filter("run = 'run_0'"), out, models, features, **small)
    assert {r.run for r in first.select("run").distinct().collect()} == {"run_0"}
    done = rescore_with_models(df, out, models, features, **small)
    loaded = M.FoldModels.load(spark, models, features)
    want = M.rescoring_apply(df, loaded)
    key = ["run", "engine", "spectrum_id", "score_rescored"]
    assert sorted(map(tuple, done.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    with pytest.raises(ValueError, match="other features"):
        rescore_with_models(df, out, models, ["score"], **small)


def test_containment_of_random_peptides(spark):
    from psmweave.operators.containment import kmer_contains_join

    rnd = random.Random(11)
    texts = {i: "".join(rnd.choices("AIK", k=rnd.choice([0, 3, 7, 20, 200, 9000]))) for i in range(12)}
    texts[12] = "A" * 5000
    peptides = {"I", "AK", "W", "A" * 4999, "A" * 5001, "AIKAIKAIK"}
    for n in (1, 2, 3, 4, 5, 8, 10, 11, 12, 30, 5000):
        for t in texts.values():
            if len(t) >= n:
                at = rnd.randrange(len(t) - n + 1)
                peptides |= {t[at : at + n], t[at : at + n - 1] + "K", t[:n], t[len(t) - n :]}
    got = kmer_contains_join(
        spark.createDataFrame([(p,) for p in peptides] + [(None,), ("",)], "peptide string"),
        spark.createDataFrame([*texts.items(), (13, None)], "protein_id int, sequence string"),
    )
    want = {(p, i) for p in peptides for i, t in texts.items() if p in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
