"""Queries for score models, confidence and candidates (M, G, J21)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.operators import candidates as G
from psmweave.operators import confidence as M
from psmweave.operators import fragments as E
from psmweave.operators import joins as J
from psmweave.operators import summary as S
from psmweave.suite import views as V
from psmweave.suite.registry import query


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _em_sql(groups: str, components) -> str:
    """Mixtures by expectation and maximisation in a recursion; ``em`` keeps the rows that have converged as ``done``."""
    starts = ", ".join(
        f"({k}, [{', '.join(f'{NormalDist().inv_cdf((j + 0.5) / k)!r}::DOUBLE' for j in range(k))}])" for k in components
    )
    return f"""WITH RECURSIVE lv AS (SELECT {groups} AS g, score AS x, count(*)::DOUBLE AS c FROM scored GROUP BY ALL),
s1 AS (SELECT g, sum(c) AS n, sum(c * x) / sum(c) AS mean FROM lv GROUP BY g),
s2 AS (SELECT g, n, mean, sum(c * (x - mean) ** 2) / n AS var FROM lv JOIN s1 USING (g) GROUP BY g, n, mean),
em AS (
  SELECT g, k, n, 0 AS passes, list_transform(zs, lambda z: 1.0::DOUBLE / k) AS w, list_transform(zs, lambda z: mean + z * sqrt(var)) AS mu,
    list_transform(zs, lambda z: var / k + 1e-6) AS v, '-inf'::DOUBLE AS ll, FALSE AS done FROM s2, (VALUES {starts}) t(k, zs)
  UNION ALL
  SELECT g, k, n, passes + 1, CASE WHEN stop THEN w ELSE list_transform(s0, lambda a: a / list_sum(s0)) END,
    CASE WHEN stop THEN mu ELSE list_transform(range(1, k + 1), lambda j: mu[j] + s1[j] / s0[j]) END,
    CASE WHEN stop THEN v ELSE list_transform(range(1, k + 1), lambda j: greatest(s2[j] / s0[j] - (s1[j] / s0[j]) ** 2, 0) + 1e-6) END,
    new, stop
  FROM (SELECT g, k, n, passes, w, mu, v, any_value(new) AS new, abs(any_value(new) - ll) < 1e-3 * n AS stop,
      list(s0 ORDER BY j) AS s0, list(s1 ORDER BY j) AS s1, list(s2 ORDER BY j) AS s2
    FROM (SELECT g, k, n, passes, w, mu, v, ll, j, sum(c * lse) AS new, sum(c * exp(ld[j] - lse)) + 2.220446049250313e-15 AS s0,
        sum(c * exp(ld[j] - lse) * (x - mu[j])) AS s1, sum(c * exp(ld[j] - lse) * (x - mu[j]) ** 2) AS s2
      FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM (SELECT *, list_max(ld) +
          ln(list_sum(list_transform(ld, lambda a: exp(a - list_max(ld))))) AS lse
        FROM (SELECT em.*, x, c, list_transform(range(1, k + 1), lambda j: ln(w[j]) - 0.5 * (ln(2 * pi() * v[j]) + (x - mu[j]) ** 2 / v[j])) AS ld
          FROM em JOIN lv ON lv.g = em.g WHERE NOT done)))
      GROUP BY g, k, n, passes, w, mu, v, ll, j)
    GROUP BY g, k, n, passes, w, mu, v, ll))
"""


_PARAMS = [f"{name}_{side}" for name in ("mean", "std", "weight") for side in ("low", "high")]


@query(
    "M1_gmm_clusters",
    _em_sql("engine", [2]) + """, pa AS (SELECT g, lo, 3 - lo AS hi, w, mu, v FROM (SELECT *, CASE WHEN mu[1] <= mu[2] THEN 1 ELSE 2 END AS lo
  FROM em WHERE done)),
ma AS (SELECT lv.g, x, c, ln(w[hi]) - ln(v[hi]) / 2 - (x - mu[hi]) ** 2 / v[hi] / 2 > ln(w[lo]) - ln(v[lo]) / 2 - (x - mu[lo]) ** 2 / v[lo] / 2
  AS up FROM lv JOIN pa USING (g)),
cl AS (SELECT *, up = arg_max(up, x) OVER (PARTITION BY g) AS one FROM ma)
SELECT g AS engine, sum(c)::BIGINT AS n_all, (sum(c) FILTER (WHERE one))::BIGINT AS n_accepted,
  coalesce((sum(c) FILTER (WHERE NOT one))::BIGINT, 0) AS n_filtered,
  round((min(x) FILTER (WHERE one) + max(x) FILTER (WHERE NOT one)) / 2, 6) AS cutoff,
  any_value(round(mu[lo], 6)) AS mean_low, any_value(round(mu[hi], 6)) AS mean_high, any_value(round(sqrt(v[lo]), 6)) AS std_low,
  any_value(round(sqrt(v[hi]), 6)) AS std_high, any_value(round(w[lo], 6)) AS weight_low, any_value(round(w[hi], 6)) AS weight_high
FROM cl JOIN pa USING (g) GROUP BY g""",
)
def m1(spark, sf):
    return _r(M.gmm_summary(M.gmm_by_engine(V.scored(spark, sf))), "cutoff", *_PARAMS)


@query(
    "M2_gmm_bic",
    _em_sql("''", range(1, 11)) + """, bi AS (SELECT k AS components, -2 * ll + (3 * k - 1) * ln(n) AS bic, passes FROM em WHERE done)
SELECT components, round(bic, 3) AS bic, passes, bic = min(bic) OVER () AS best FROM bi""",
)
def m2(spark, sf):
    return _r(M.gmm_bic(V.scored(spark, sf)), "bic", places=3)


@query("M3_gmm_fdr_threshold")
def m3(spark, sf):
    """Rows above the score with 5 % of the low component, per run."""
    scored = V.scored(spark, sf)
    cut = M.gmm_fdr_threshold(M.fit_two(scored), 0.05)
    counts = S.count_by(scored.filter(F.col("score") >= cut), "run") if cut is not None else scored.select(
        F.lit(None).cast("string").alias("run"), F.lit(0).cast("long").alias("n")
    ).limit(1)
    return counts.withColumn("threshold", F.lit(cut).cast("double"))


_RESCORE_COLS = [
    "concat('run_', CAST(l_orderkey % 4 AS STRING)) AS run",
    "l_orderkey AS spectrum_id",
    "concat('engine_', CAST(l_suppkey % 8 AS STRING)) AS engine",
    "concat('P', CAST(l_partkey % 500 AS STRING)) AS peptide",
    "l_partkey % 3 = 0 AND l_quantity < 35 AS is_decoy",
    "l_quantity / 50 AS score",
    "l_extendedprice / 1000 AS price",
    "l_discount AS discount",
    "CAST(l_linenumber AS DOUBLE) AS line",
]


def _rescore_rows(spark, sf):
    return V.table(spark, sf, "lineitem").selectExpr(*_RESCORE_COLS)


def _models(spark, sf):
    return M.rescoring_train(_rescore_rows(spark, sf), ["score", "price", "discount"])


@query("M4_rescoring_train")
def m4(spark, sf):
    """Accepted targets per fold after training."""
    rows = _rescore_rows(spark, sf)
    scored = M.rescoring_apply(rows, _models(spark, sf))
    q = M.q_values(scored, "score_rescored")
    return M.with_fold(q).groupBy("fold", "is_decoy").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("qvalue") <= 0.01, 1)).alias("n_accepted")
    )


@query("M5_rescoring_apply")
def m5(spark, sf):
    out = M.rescoring_apply(_rescore_rows(spark, sf), _models(spark, sf))
    return out.groupBy("run", "engine").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score_rescored"), 2).alias("mean_score")
    )


_Q_SQL = """
lv AS (SELECT {s} AS score, count(*) FILTER (WHERE NOT is_decoy) AS t, count(*) FILTER (WHERE is_decoy) AS d
  FROM {src} GROUP BY 1),
ac AS (SELECT score, sum(t) OVER w AS ct, sum(d) OVER w AS cd FROM lv WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT score, CASE WHEN ct > 0 THEN (cd + 1) / ct ELSE 1 END AS fdr FROM ac),
q AS (SELECT score, least(min(fdr) OVER (ORDER BY score), 1) AS qvalue FROM f)
"""
_RESCORE_SQL = "rr AS (SELECT " + ", ".join(_RESCORE_COLS) + " FROM lineitem),\n"


@query(
    "M6_q_values",
    "WITH " + _RESCORE_SQL + _Q_SQL.format(s="score", src="rr")
    + "SELECT rr.score, is_decoy, count(*) AS n, round(any_value(qvalue), 6) AS qvalue FROM rr JOIN q "
    "ON q.score = rr.score GROUP BY 1, 2",
)
def m6(spark, sf):
    q = M.q_values(_rescore_rows(spark, sf))
    return q.groupBy("score", "is_decoy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.first("qvalue"), 6).alias("qvalue")
    )


_GAPS = "CASE WHEN line = 3 THEN NULL ELSE score END"


@query(
    "M6_q_values_null_scores",
    "WITH " + _RESCORE_SQL + f"gp AS (SELECT * REPLACE ({_GAPS} AS score) FROM rr),\n"
    "gs AS (SELECT * FROM gp WHERE score IS NOT NULL),\n" + _Q_SQL.format(s="score", src="gs")
    + "SELECT gp.score, is_decoy, count(*) AS n, round(any_value(qvalue), 6) AS qvalue FROM gp LEFT JOIN q "
    "ON q.score = gp.score GROUP BY 1, 2",
)
def m6_null(spark, sf):
    """Rows without a score stay, without a q-value."""
    q = M.q_values(_rescore_rows(spark, sf).withColumn("score", F.expr(_GAPS)))
    return q.groupBy("score", "is_decoy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.first("qvalue"), 6).alias("qvalue")
    )


@query(
    "M6_peptide_q_values",
    "WITH " + _RESCORE_SQL + "bp AS (SELECT peptide, is_decoy, max(score * price) AS score FROM rr GROUP BY 1, 2),\n"
    + _Q_SQL.format(s="score", src="bp")
    + "SELECT peptide, is_decoy, round(bp.score, 6) AS score, round(qvalue, 6) AS qvalue FROM bp JOIN q "
    "ON q.score = bp.score",
)
def m6b(spark, sf):
    rows = _rescore_rows(spark, sf).withColumn("score", F.col("score") * F.col("price"))
    return _r(M.peptide_q_values(rows, strategy="split"), "score", "qvalue")


@query("M7_feature_subset_ablation")
def m7(spark, sf):
    return M.feature_subset_ablation(
        _rescore_rows(spark, sf),
        {
            "score": ["score"], "price": ["score", "price"], "discount": ["score", "discount"],
            "all": ["score", "price", "discount", "line"],
        },
    )


#: Fold models that are given, for what follows from coefficients.
_GIVEN = {
    "score": M.FoldModels(["score"], [[1.5], [2.0], [2.5]], [0.25, 0.0, -0.25], [[0.5], [0.75], [0.25]]),
    "price": M.FoldModels(
        ["score", "price"], [[1.5, 0.0617], [2.0, -0.0311], [1.0, 0.1233]], [0.0, 0.5, 1.0], [[0.5, 0.125], [1.0, -0.25], [0.75, 0.5]]
    ),
}


def _given_sql(m: M.FoldModels) -> str:
    folds = [" + ".join([repr(b), *(f"{c!r} * {f}" for f, c in zip(m.features, cs))]) for cs, b in zip(m.coefficients, m.intercepts)]
    return f"({' + '.join(f'({x})::DOUBLE' for x in folds)}) / {len(folds)}"


@query(
    "M5_apply_given_models",
    "WITH " + _RESCORE_SQL.rstrip(",\n") + f" SELECT run, spectrum_id, line, round({_given_sql(_GIVEN['price'])}, 3) AS score_rescored FROM rr",
)
def m5_given(spark, sf):
    """Every row rescored by given models."""
    out = M.rescoring_apply(_rescore_rows(spark, sf), _GIVEN["price"])
    return _r(out.select("run", "spectrum_id", "line", "score_rescored"), "score_rescored", places=3)


_ACCEPTED_SQL = (
    "SELECT '{name}' AS features, CASE WHEN is_decoy THEN 'decoy' WHEN qvalue < 0.2 THEN 'target_accepted' "
    "ELSE 'target_rejected' END AS psm_type, count(*) AS n FROM (WITH sc AS (SELECT round({score}, 9) AS score, is_decoy FROM rr),\n"
    + _Q_SQL.format(s="score", src="sc") + "SELECT is_decoy, qvalue FROM sc JOIN q USING (score)) GROUP BY ALL"
)


@query(
    "M7_accepted_by_given_models",
    "WITH " + _RESCORE_SQL.rstrip(",\n") + " " + " UNION ALL ".join(
        _ACCEPTED_SQL.format(name=n, score=_given_sql(m)) for n, m in _GIVEN.items()
    ),
)
def m7_given(spark, sf):
    """Targets accepted by given models, all sets in one pass."""
    return M.accepted_by_models(_rescore_rows(spark, sf), _GIVEN, cutoff=0.2)


@query("M8_coefficient_summary")
def m8(spark, sf):
    return _r(M.coefficient_summary(_models(spark, sf), spark), "mean_coefficient", "sd", places=3)


@query(
    "M9_incremental_rescore",
    "SELECT run, spectrum_id, engine, psm_no, round(CASE WHEN run = 'run_0' THEN score ELSE score * 2 END, 6) AS score FROM psms",
)
def m9(spark, sf):
    """run_0 exists already; the second pass only writes the other runs."""
    from psmweave.plans.rescoring import incremental_rescore
    from psmweave.runtime import scratch_path

    path = scratch_path(spark, "rescored")
    psms = V.psms(spark, sf)
    incremental_rescore(psms.filter("run = 'run_0'"), path, lambda df: df)
    out = incremental_rescore(psms, path, lambda df: df.withColumn("score", F.col("score") * 2))
    return _r(out.select("run", "spectrum_id", "engine", "psm_no", "score"), "score")


@query("M9_rescore_with_models")
def m9_models(spark, sf):
    """Models are trained and saved with the first run; the other runs load them."""
    from psmweave.plans.rescoring import rescore_with_models
    from psmweave.runtime import scratch_path

    rows, features = _rescore_rows(spark, sf), ["score", "price", "discount"]
    out, models = scratch_path(spark, "rescored"), scratch_path(spark, "models")
    rescore_with_models(rows.filter("run = 'run_0'"), out, models, features)
    done = rescore_with_models(rows, out, models, features)
    return done.groupBy("run", "engine").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score_rescored"), 2).alias("mean_score")
    )


# -- candidates -----------------------------------------------------------------------

_RESIDUE_ROWS = ", ".join(f"('{r}', {G._mass(r)!r}::DOUBLE)" for r in K.MASS_TABLE_RESIDUES)
_TABLE_SQL = f"""
res AS (SELECT * FROM (VALUES {_RESIDUE_ROWS}) t(aa, m)),
m2 AS (SELECT a.aa || b.aa AS aa, a.m + b.m AS m FROM res a, res b),
m3 AS (SELECT a.aa || b.aa AS aa, a.m + b.m AS m FROM m2 a, res b),
m4 AS (SELECT a.aa || b.aa AS aa, a.m + b.m AS m FROM m3 a, res b),
m5 AS (SELECT a.aa || b.aa AS aa, a.m + b.m AS m FROM m4 a, res b),
mt AS (SELECT aa, round(m, 6) AS mass FROM (FROM m2 UNION ALL FROM m3 UNION ALL FROM m4 UNION ALL FROM m5)),
tags AS (SELECT peptide, round(sum(m), 6) AS tag_mass FROM (SELECT DISTINCT peptide,
  unnest(string_split(substr(peptide, 1, 3), '')) AS aa, unnest([1, 2, 3]) AS k FROM psms) JOIN residue_mass USING (aa)
  GROUP BY 1)
"""


def _tags(spark, sf):
    return (
        V.psms(spark, sf)
        .select("peptide")
        .distinct()
        .withColumn("tag_mass", F.round(F.aggregate(F.slice(E.residue_masses("peptide"), 1, 3), F.lit(0.0), lambda a, x: a + x), 6))
    )


@query(
    "J21_mass_alternatives",
    "WITH " + _TABLE_SQL + "SELECT peptide, mt.aa AS alternative FROM tags JOIN mt ON abs(mt.mass - tag_mass) < 0.02",
)
def j21(spark, sf):
    tags = _tags(spark, sf)
    table = G.mass_table(spark)
    return tags.join(G.mass_alternatives(tags, table), "tag_mass").select("peptide", "alternative")


@query(
    "G1_mass_table",
    "WITH " + _TABLE_SQL + "SELECT mass, count(*) AS n, min(aa) AS first_aa FROM mt GROUP BY mass",
)
def g1(spark, sf):
    """All strings of two to five residues by mass."""
    return G.mass_table(spark).select(
        "mass",
        F.size("aa").cast("long").alias("n"),
        F.element_at("aa", 1).alias("first_aa"),
    )


@query(
    "G2_terminal_variants",
    "WITH " + _TABLE_SQL + "SELECT DISTINCT peptide, concat(mt.aa, substr(peptide, 4)) AS variant "
    "FROM tags JOIN mt ON abs(mt.mass - tag_mass) < 0.02",
)
def g2(spark, sf):
    psms = V.psms(spark, sf).select("peptide").distinct().withColumn("id", F.col("peptide"))
    table = G.mass_table(spark)
    out = G.terminal_variants(psms, table, ["id"], "n", n=1_000_000)
    return out.select(F.col("id").alias("peptide"), "variant")


def _with_evidence(spark, sf):
    return V.gt_ok(spark, sf).select(
        *J.KEY,
        F.col("gt_peptide").alias("peptide"),
        F.expr("transform(sequence(1, length(gt_peptide) - 1), i -> (spectrum_id + i) % 3 > 0)").alias("evidence"),
    )


_DRAWN = "('0x' || substr(md5({0}), 1, 13))::BIGINT"

#: The evidence leaves single sites out, so every stretch has two residues and one window.
_G3_SQL = """
sp AS (SELECT DISTINCT run, spectrum_id, gt_peptide AS peptide FROM gt_ok),
ws AS (SELECT run, spectrum_id, peptide, i - 1 AS start, substr(peptide, i::INT, 2) AS tag,
  row_number() OVER (PARTITION BY run, spectrum_id, peptide ORDER BY i) - 1 AS site_no
  FROM sp, range(1, 40) r(i) WHERE i < length(peptide) AND (spectrum_id + i) % 3 = 0),
tm AS (SELECT tag, round(a.m + b.m, 6) AS tag_mass FROM (SELECT DISTINCT tag FROM ws)
  JOIN residue_mass a ON a.aa = substr(tag, 1, 1) JOIN residue_mass b ON b.aa = substr(tag, 2, 1)),
al AS (SELECT tag_mass, aa FROM (SELECT DISTINCT tag_mass FROM tm) JOIN mt ON abs(mt.mass - tag_mass) < 0.02
  QUALIFY row_number() OVER (PARTITION BY tag_mass ORDER BY md5('0|' || aa), aa) <= 100),
ao AS (SELECT tag_mass, list(aa ORDER BY aa) AS options FROM al GROUP BY 1),
si AS (SELECT ws.*, options, len(options) AS n FROM ws JOIN tm USING (tag) JOIN ao USING (tag_mass)),
tt AS (SELECT run, spectrum_id, peptide, product(n)::BIGINT AS total, least(product(n)::BIGINT, 100) AS draws,
  list(start ORDER BY site_no) AS starts, list(options ORDER BY site_no) AS options, list(n ORDER BY site_no) AS ns FROM si GROUP BY ALL),
dr AS (SELECT *, (d * total) // draws + """ + _DRAWN.format("concat_ws('|', '0', run, spectrum_id, {id}d)") + """
  % (((d + 1) * total) // draws - (d * total) // draws) AS number FROM tt, range(0, 100) r(d) WHERE d < draws),
bu AS (SELECT run, spectrum_id, peptide, number AS rest, 0 AS k, 0::BIGINT AS pos, '' AS text, starts, options, ns FROM dr UNION ALL
  SELECT run, spectrum_id, peptide, rest // ns[k + 1], k + 1, starts[k + 1] + 2,
    text || substr(peptide, (pos + 1)::INT, (starts[k + 1] - pos)::INT) || options[k + 1][rest % ns[k + 1] + 1], starts, options, ns
  FROM bu WHERE k < len(ns)),
va AS (SELECT DISTINCT run, spectrum_id, text || substr(peptide, (pos + 1)::INT) AS variant FROM bu WHERE k = len(ns))
"""


def _variants(df, *group):
    """All variants of a group as one hash, so that every one of them counts."""
    spelled = F.array_join(F.array_sort(F.collect_list("variant")), ",")
    return df.groupBy(*J.KEY, *group).agg(F.count(F.lit(1)).alias("n"), F.md5(spelled).alias("variants"))


_VARIANTS_SQL = "count(*) AS n, md5(string_agg(variant, ',' ORDER BY variant)) AS variants"


@query(
    "G3_ambiguous_variants",
    "WITH RECURSIVE " + _TABLE_SQL.rstrip() + "," + _G3_SQL.format(id="")
    + f"SELECT run, spectrum_id, {_VARIANTS_SQL} FROM va GROUP BY ALL",
)
def g3(spark, sf):
    table = G.mass_table(spark)
    return _variants(G.ambiguous_variants(_with_evidence(spark, sf), table, J.KEY))


#: Terminal variants: 100 strings per mass, 100 variants per peptide and end, without the peptides themselves.
_ENDS_SQL = """,
en AS (SELECT run, spectrum_id, peptide, 'n' AS side, substr(peptide, 1, 3) AS tag, substr(peptide, 4) AS rest FROM sp UNION ALL
  SELECT run, spectrum_id, peptide, 'c', right(peptide, 3), left(peptide, greatest(length(peptide) - 3, 0)::INT) FROM sp),
em AS (SELECT tag, round(sum(m), 6) AS tag_mass FROM (SELECT tag, unnest(string_split(tag, '')) AS aa FROM (SELECT DISTINCT tag FROM en))
  JOIN residue_mass USING (aa) GROUP BY 1),
ea AS (SELECT tag_mass, mt.aa FROM (SELECT DISTINCT tag_mass FROM em) JOIN mt ON abs(mt.mass - tag_mass) < 0.02
  QUALIFY row_number() OVER (PARTITION BY tag_mass ORDER BY md5('0|' || mt.aa), mt.aa) <= 100),
ev AS (SELECT DISTINCT run, spectrum_id, peptide, side, CASE side WHEN 'n' THEN aa || rest ELSE rest || aa END AS variant
  FROM en JOIN em USING (tag) JOIN ea USING (tag_mass)),
e1 AS (SELECT run, spectrum_id, variant FROM (SELECT DISTINCT run, spectrum_id, variant FROM (SELECT * FROM ev
    QUALIFY row_number() OVER (PARTITION BY run, spectrum_id, peptide, side ORDER BY md5('0|' || variant), variant) <= 100)
  ) e WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.run = e.run AND sp.spectrum_id = e.spectrum_id AND sp.peptide = e.variant)),
e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY run, spectrum_id ORDER BY md5('0|' || variant), variant) <= 1000)
"""


@query(
    "G4_candidate_set",
    "WITH RECURSIVE " + _TABLE_SQL.rstrip() + "," + _G3_SQL.format(id="peptide, ").rstrip() + _ENDS_SQL
    + f"SELECT run, spectrum_id, source, {_VARIANTS_SQL} FROM (SELECT run, spectrum_id, variant, 'Ambiguous' AS source FROM va "
    "UNION ALL SELECT run, spectrum_id, variant, 'Terminal-variant' FROM e2) GROUP BY ALL",
)
def g4(spark, sf):
    return _variants(G.candidate_set(_with_evidence(spark, sf), G.mass_table(spark), J.KEY), "source")
