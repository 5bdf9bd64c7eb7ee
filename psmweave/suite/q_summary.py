"""Queries for windows, grouped tables and set operations (W, A, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.operators import joins as J
from psmweave.operators import summary as S
from psmweave.operators import windows as W
from psmweave.operators.filters import psm_type
from psmweave.functions import peptide as P
from psmweave.suite import views as V
from psmweave.suite.registry import query
from psmweave.suite.q_curves import _REFINED_SQL, _refined


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


# -- windows -------------------------------------------------------------------


@query(
    "W1_rank_in_spectrum",
    "SELECT run, spectrum_id, engine, psm_no, CAST(dense_rank() OVER (PARTITION BY run, spectrum_id "
    "ORDER BY score DESC) AS INT) AS dense FROM psms",
)
def w1(spark, sf):
    return W.rank_in_spectrum(V.psms(spark, sf).drop("rank"), name="dense").select(
        "run", "spectrum_id", "engine", "psm_no", "dense"
    )


@query(
    "W1_rank_in_engine_split",
    "SELECT engine, psm_no, run, spectrum_id, CAST(dense_rank() OVER (PARTITION BY engine "
    "ORDER BY score DESC) AS INT) AS dense FROM psms",
)
def w1b(spark, sf):
    """Dense rank over a few very large groups, on the path for such groups."""
    out = W.rank_in_spectrum(
        V.psms(spark, sf).drop("rank"), key=["engine"], name="dense", strategy="split"
    )
    return out.select("engine", "psm_no", "run", "spectrum_id", "dense")


@query(
    "W2_rank_by_file_order",
    "SELECT run, spectrum_id, engine, psm_no, CAST(row_number() OVER (PARTITION BY run, spectrum_id "
    "ORDER BY engine, psm_no) AS INT) AS inferred FROM psms",
)
def w2(spark, sf):
    rows = V.psms(spark, sf).drop("rank").withColumn("ordinal", F.struct("engine", "psm_no"))
    return J.infer_rank(rows).select(
        "run", "spectrum_id", "engine", "psm_no", F.col("rank").alias("inferred")
    )


@query(
    "W3_top1",
    """
SELECT run, spectrum_id, engine, psm_no, score FROM (SELECT *, row_number() OVER (PARTITION BY run,
 spectrum_id ORDER BY score DESC, engine, psm_no) AS rn FROM psms) WHERE rn <= 1
""",
)
def w3(spark, sf):
    order = [("score", False), ("engine", True), ("psm_no", True)]
    return W.top_k(V.psms(spark, sf), 1, J.KEY, order).select(
        "run", "spectrum_id", "engine", "psm_no", "score"
    )


@query(
    "W4_rerank",
    """
SELECT run, spectrum_id, engine, psm_no, CAST(row_number() OVER (PARTITION BY run, spectrum_id
 ORDER BY alt DESC, engine, psm_no) - 1 AS INT) AS alt_rank
FROM (SELECT *, round(score * (1 + psm_no), 6) AS alt FROM psms WHERE engine IN ('engine_1', 'engine_2', 'engine_3'))
""",
)
def w4(spark, sf):
    rows = V.psms(spark, sf).withColumn("alt", F.round(F.col("score") * (1 + F.col("psm_no")), 6))
    return W.rerank(
        rows, "alt", ["engine_1", "engine_2", "engine_3"], "alt_rank", ["engine", "psm_no"]
    ).select("run", "spectrum_id", "engine", "psm_no", "alt_rank")


_TRUTH_SQL = """
cand AS (SELECT run, spectrum_id, false AS is_gt, error_type, score, round(score * psm_no, 6) AS alt
  FROM evaluated
 UNION ALL SELECT run, CASE WHEN spectrum_id % 7 = 0 THEN -1 - spectrum_id ELSE spectrum_id END, true, 'match',
  gt_score, gt_score FROM gt_ok),
best AS (SELECT run, spectrum_id, count(*) FILTER (WHERE is_gt OR error_type = 'match') AS hits,
  max(score) FILTER (WHERE is_gt OR error_type = 'match') AS bs,
  max(alt) FILTER (WHERE is_gt OR error_type = 'match') AS ba FROM cand GROUP BY 1, 2),
ranks AS (SELECT run, spectrum_id,
 CASE WHEN any_value(hits) > 0 THEN 1 + count(*) FILTER (WHERE NOT is_gt AND error_type <> 'match' AND score > bs)
  ELSE -1 END AS rank_score,
 CASE WHEN any_value(hits) > 0 THEN 1 + count(*) FILTER (WHERE NOT is_gt AND error_type <> 'match' AND alt > ba)
  ELSE -1 END AS rank_alt
FROM cand JOIN best USING (run, spectrum_id) GROUP BY 1, 2)
"""


def _truth_ranks(spark, sf):
    cands = V.evaluated(spark, sf).select(
        *J.KEY,
        F.lit(False).alias("is_gt"),
        "error_type",
        "score",
        F.round(F.col("score") * F.col("psm_no"), 6).alias("alt"),
    )
    # The truth of some spectra stands under spectra without candidates.
    moved = F.expr("CASE WHEN spectrum_id % 7 = 0 THEN -1 - spectrum_id ELSE spectrum_id END")
    truth = V.gt_ok(spark, sf).withColumn("spectrum_id", moved).select(
        *J.KEY,
        F.lit(True).alias("is_gt"),
        F.lit("match").alias("error_type"),
        F.col("gt_score").alias("score"),
        F.col("gt_score").alias("alt"),
    )
    return W.rank_of_truth(cands.unionByName(truth), ["score", "alt"])


@query("W5_rank_of_truth", "WITH " + _TRUTH_SQL + "SELECT * FROM ranks")
def w5(spark, sf):
    return _truth_ranks(spark, sf).selectExpr(
        "run", "spectrum_id", "CAST(rank_score AS BIGINT) rank_score", "CAST(rank_alt AS BIGINT) rank_alt"
    )


@query(
    "W8_second_rank_gap",
    """
SELECT run, spectrum_id, engine, round(least(max(score) FILTER (WHERE rank = 1) -
 max(score) FILTER (WHERE rank = 2), 0.3), 6) AS gap FROM psms GROUP BY ALL
""".replace("least(", "(SELECT CASE WHEN g > 0.3 THEN 0.3 ELSE g END FROM (SELECT ").replace(
        ", 0.3), 6)", " AS g)), 6)"
    ),
)
def w8(spark, sf):
    return _r(W.second_rank_gap(V.psms(spark, sf), J.ENGINE_KEY, cap=0.3), "gap")


@query(
    "W9_share_in_group",
    "WITH c AS (SELECT engine, run, count(*) AS n FROM psms GROUP BY 1, 2) "
    "SELECT engine, run, n, round(n / sum(n) OVER (PARTITION BY engine), 6) AS share FROM c",
)
def w9(spark, sf):
    counts = S.count_by(V.psms(spark, sf), "engine", "run")
    return _r(W.share_in_group(counts, ["engine"]), "share")


@query(
    "W10_gaps_islands",
    """
WITH m AS (SELECT spectrum_id, peak_no, peak_no - row_number() OVER (PARTITION BY spectrum_id ORDER BY peak_no)
 AS g FROM peaks WHERE NOT intensity > 80)
SELECT spectrum_id, min(peak_no) AS start, max(peak_no) AS "end" FROM m GROUP BY spectrum_id, g
""",
)
def w10(spark, sf):
    sites = V.peaks(spark, sf).selectExpr("spectrum_id", "peak_no AS site", "intensity > 80 AS seen")
    return W.gaps_islands(sites, ["spectrum_id"])


_OPT_SQL = """
cls AS (SELECT *, CASE error_type WHEN 'match' THEN 0 WHEN 'Higher score' THEN 1 WHEN 'isobaric_aa' THEN 2
  WHEN 'isobaric_peak' THEN 3 WHEN 'Lower score' THEN 4 END AS k FROM evaluated),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run, spectrum_id ORDER BY k, score DESC, engine, peptide)
  AS rn FROM cls WHERE k IS NOT NULL),
opt AS (SELECT c.* FROM cls c JOIN firsts f ON f.rn = 1 AND f.run = c.run AND f.spectrum_id = c.spectrum_id
  WHERE c.k = f.k AND (c.k = 0 OR c.peptide = f.peptide))
"""


@query(
    "W11_optimal_set",
    "WITH " + _OPT_SQL + "SELECT run, spectrum_id, engine, rank, error_type, peptide FROM opt",
)
def w11(spark, sf):
    return W.optimal_set(V.evaluated(spark, sf)).select(*J.PSM_KEY, "error_type", "peptide")


@query(
    "W12_tool_selection_counts",
    "WITH " + _OPT_SQL + "SELECT engine, error_type, count(*) AS n FROM (SELECT DISTINCT run, "
    "spectrum_id, engine, error_type FROM opt) GROUP BY ALL",
)
def w12(spark, sf):
    return W.tool_selection_counts(W.optimal_set(V.evaluated(spark, sf)))


@query(
    "W13_paired_only",
    "SELECT run, spectrum_id, engine, rank FROM psms WHERE (run, spectrum_id) IN "
    "(SELECT (run, spectrum_id) FROM psms GROUP BY run, spectrum_id HAVING count(*) = 2)",
)
def w13(spark, sf):
    return W.paired_only(V.psms(spark, sf)).select(*J.PSM_KEY)


_FRAG = (
    "SELECT vec_id AS spectrum_id, {pos} AS ion_index, CAST(floor({x} * 20) AS BIGINT) AS mz, "
    "CASE WHEN {pos} % 3 = 0 THEN 'y1' WHEN {pos} % 3 = 1 THEN 'b1' ELSE 'y2' END AS ion_type"
)


@query(
    "W14_mask_duplicates",
    "WITH f AS (" + _FRAG.format(pos="(i - 1)", x="CAST(x AS DOUBLE)")
    + """ FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT spectrum_id, ion_index, mz, ion_type FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, mz
 ORDER BY CASE ion_type WHEN 'y1' THEN 0 WHEN 'b1' THEN 1 ELSE 2 END, ion_index) AS rn FROM f) WHERE rn = 1
""",
)
def w14(spark, sf):
    frags = (
        V.table(spark, sf, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("p", "x"))
        .selectExpr(
            "vec_id AS spectrum_id",
            "CAST(p AS BIGINT) AS ion_index",
            "CAST(floor(CAST(x AS DOUBLE) * 20) AS BIGINT) AS mz",
            "CASE WHEN p % 3 = 0 THEN 'y1' WHEN p % 3 = 1 THEN 'b1' ELSE 'y2' END AS ion_type",
        )
    )
    pref = F.expr("CASE ion_type WHEN 'y1' THEN 0 WHEN 'b1' THEN 1 ELSE 2 END")
    return W.mask_duplicates(frags, ["spectrum_id"], "mz", pref)


_ANNOT = [
    "l_orderkey AS spectrum_id",
    "CAST(l_linenumber AS INT) AS peak_no",
    "CASE WHEN l_partkey % 2 = 0 THEN '-H2O' ELSE '' END AS neutral_loss",
    "l_discount - 0.05 AS delta",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'b1' ELSE 'y1' END AS ion_type",
    "l_partkey AS ion_index",
]


@query(
    "W15_best_annotation",
    f"""
SELECT spectrum_id, peak_no, neutral_loss, ion_type, ion_index FROM (SELECT *, row_number() OVER (
 PARTITION BY spectrum_id, peak_no ORDER BY neutral_loss <> '', d, ion_type, ion_index) AS rn
 FROM (SELECT *, CAST(round(abs(delta) * 1000) AS INT) AS d FROM (SELECT {", ".join(_ANNOT)} FROM lineitem)))
WHERE rn = 1
""",
)
def w15(spark, sf):
    rows = V.table(spark, sf, "lineitem").selectExpr(*_ANNOT)
    rows = rows.withColumn("delta", F.expr("CAST(round(delta * 1000) AS INT)"))
    return W.best_annotation(rows, ["spectrum_id", "peak_no"]).drop("delta")


# -- grouped tables ---------------------------------------------------------------

_TYPED = (
    "SELECT * REPLACE (CASE WHEN spectrum_id % 11 = 0 THEN -1 - spectrum_id ELSE spectrum_id END AS spectrum_id), "
    "CASE WHEN is_decoy THEN 'decoy' WHEN qvalue < 0.01 THEN 'target_accepted' "
    "ELSE 'target_rejected' END AS psm_type FROM gt"
)


def _typed_truth(spark, sf):
    """Ground truth with its type; some of it belongs to spectra that no engine has."""
    moved = F.expr("CASE WHEN spectrum_id % 11 = 0 THEN -1 - spectrum_id ELSE spectrum_id END")
    return V.gt(spark, sf).withColumns({"spectrum_id": moved, "psm_type": psm_type("is_decoy", "qvalue")})


@query(
    "A4_accuracy_by_psm_type",
    f"""
WITH t AS ({_TYPED}), n AS (SELECT psm_type, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT engine, psm_type FROM (SELECT DISTINCT engine FROM psms),
  (SELECT unnest(['target_accepted', 'target_rejected', 'decoy']) AS psm_type)),
f AS (SELECT engine, psm_type, count(*) AS m, count(*) FILTER (WHERE peptide = gt_peptide) AS c
  FROM top_psms JOIN t USING (run, spectrum_id) GROUP BY ALL)
SELECT engine, psm_type, round(c / m, 6) AS precision, round(coalesce(m, 0) / n.n, 6) AS coverage
FROM g LEFT JOIN f USING (engine, psm_type) LEFT JOIN n USING (psm_type)
""",
)
def a4(spark, sf):
    truth = _typed_truth(spark, sf)
    psms = J.evaluate_exact(V.top_psms(spark, sf), truth)
    return _r(S.accuracy_by_psm_type(psms, truth), "precision", "coverage")


@query(
    "A4_extra_predictions",
    f"""
WITH t AS ({_TYPED})
SELECT engine, count(*) FILTER (WHERE t.run IS NULL) AS absolute,
 round(count(*) FILTER (WHERE t.run IS NULL) / count(*), 6) AS pct
FROM top_psms p LEFT JOIN t USING (run, spectrum_id) GROUP BY 1
""",
)
def a4b(spark, sf):
    return _r(S.extra_predictions(J.evaluate_exact(V.top_psms(spark, sf), _typed_truth(spark, sf))), "pct")


@query(
    "A16_group_engines",
    """
SELECT run, spectrum_id, peptide, concat(CAST(spectrum_id AS VARCHAR), '||',
 array_to_string(list(engine ORDER BY engine), '|')) AS title FROM psms GROUP BY run, spectrum_id, peptide
""",
)
def a16(spark, sf):
    return S.group_engines(V.psms(spark, sf)).drop("engines")


_TYPES = ["match", "isobaric_aa", "Higher score", "Lower score", "Different"]


def _pivot_sql(values, column="error_type"):
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS \"{v}\"" for v in values)


@query("A17_error_type_counts", f"SELECT engine, {_pivot_sql(_TYPES)} FROM top_eval GROUP BY 1")
def a17(spark, sf):
    return S.pivot_counts(V.top_eval(spark, sf), ["engine"], "error_type", _TYPES)


_REF_EVAL_SQL = (
    _REFINED_SQL
    + """, re AS (SELECT rj.*, e.error_type, CASE WHEN refined_correct THEN 'match'
  WHEN refined_score > e.gt_score THEN 'Higher score' ELSE 'Lower score' END AS refined_error_type,
  e.gt_score FROM rj JOIN evaluated e USING (run, spectrum_id, engine, rank))
"""
)


def _refined_eval(spark, sf):
    top, ref = _refined(spark, sf)
    types = V.evaluated(spark, sf).select(*J.PSM_KEY, "error_type", "gt_score", "correct")
    return ref.join(types, J.PSM_KEY).withColumn(
        "refined_error_type",
        F.expr(
            "CASE WHEN refined_correct THEN 'match' WHEN refined_score > gt_score "
            "THEN 'Higher score' ELSE 'Lower score' END"
        ),
    )


@query(
    "A18_refinement_error_table",
    "WITH " + _REF_EVAL_SQL + f"""
SELECT refiner, state, {_pivot_sql(_TYPES)} FROM (
 SELECT refiner, 'Unchanged' AS state, error_type FROM re WHERE unchanged
 UNION ALL SELECT refiner, 'Refined_base', error_type FROM re WHERE NOT unchanged
 UNION ALL SELECT refiner, 'Refined', refined_error_type FROM re WHERE NOT unchanged) GROUP BY 1, 2
""",
)
def a18(spark, sf):
    states = S.refinement_states(_refined_eval(spark, sf))
    return S.pivot_counts(states, ["refiner", "state"], "error_type", _TYPES)


@query(
    "A19_refinement_flow",
    "WITH " + _REF_EVAL_SQL + """
SELECT j.run, j.spectrum_id, j.engine, j.rank, refiner, j.error_type AS base_type, NOT unchanged AS refined,
 CASE WHEN unchanged THEN j.error_type ELSE refined_error_type END AS refined_type,
 CASE WHEN refiner IS NULL THEN NULL
  WHEN j.error_type = 'match' AND (unchanged OR refined_error_type = 'match') THEN 'kept'
  WHEN j.error_type <> 'match' AND NOT unchanged AND refined_error_type = 'match' THEN 'improved'
  WHEN j.error_type = 'match' THEN 'lost'
  WHEN unchanged OR j.error_type = refined_error_type THEN 'kept' END AS flow
FROM top_eval j LEFT JOIN re USING (run, spectrum_id, engine, rank)
""",
)
def a19(spark, sf):
    return S.refinement_flow(V.top_eval(spark, sf), _refined_eval(spark, sf))


@query(
    "A20_refined_share",
    "WITH " + _REF_EVAL_SQL + "SELECT engine, correct, count(*) AS n, "
    "round(avg(CASE WHEN unchanged THEN 0 ELSE 1 END), 6) AS share_refined FROM re GROUP BY 1, 2",
)
def a20(spark, sf):
    return _r(S.refined_share(_refined_eval(spark, sf), ["engine", "correct"]), "share_refined")


@query(
    "A20_refined_share_summary",
    "WITH " + _REF_EVAL_SQL + """, sh AS (SELECT engine, avg(CASE WHEN unchanged THEN 0 ELSE 1 END) AS s
 FROM re GROUP BY 1)
SELECT count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS min,
 round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50,
 round(quantile_cont(s, 0.75), 6) AS q75, round(max(s), 6) AS max FROM sh""",
)
def a20b(spark, sf):
    out = S.describe(S.refined_share(_refined_eval(spark, sf)), "share_refined")
    return _r(out, "mean", "std", "min", "q25", "q50", "q75", "max")


_OUTCOME_SQL = """, oc AS (SELECT engine, refiner, CASE WHEN error_type = 'match' THEN 'correct-perturbed'
  WHEN unchanged THEN 'wrong-unperturbed' WHEN refined_correct THEN 'corrected-by-refinement'
  ELSE 'wrong-wrong' END AS outcome FROM re WHERE NOT (error_type = 'match' AND unchanged))
"""


def _outcomes(spark, sf):
    from psmweave.operators.compare import refinement_outcome

    return refinement_outcome(_refined_eval(spark, sf))


@query(
    "A21_outcome_rates",
    "WITH " + _REF_EVAL_SQL + _OUTCOME_SQL + """,
p AS (SELECT engine, count(*) AS a, count(*) FILTER (WHERE error_type = 'match') AS c FROM top_eval GROUP BY 1)
SELECT engine, refiner, outcome, count(*) AS n, round(count(*) / any_value(a), 6) AS per_prediction,
 round(count(*) / any_value(c), 6) AS per_correct, round(count(*) / any_value(a - c), 6) AS per_incorrect
FROM oc JOIN p USING (engine) GROUP BY 1, 2, 3
""",
)
def a21(spark, sf):
    preds = V.top_eval(spark, sf).withColumn("correct", F.col("error_type") == "match")
    out = S.outcome_rates(_outcomes(spark, sf), preds)
    return _r(out, "per_prediction", "per_correct", "per_incorrect")


@query(
    "A22_distance_histogram",
    """
WITH c AS (SELECT engine, least(levenshtein(peptide, gt_peptide), 3) AS distance, count(*) AS n
  FROM top_eval GROUP BY 1, 2)
SELECT engine, CAST(distance AS BIGINT) AS distance, n, round(n / sum(n) OVER (PARTITION BY engine), 6) AS share
FROM c
""",
)
def a22(spark, sf):
    rows = V.top_eval(spark, sf).withColumn(
        "distance", F.levenshtein("peptide", "gt_peptide").cast("long")
    )
    return _r(S.distance_histogram(rows, "distance", ["engine"], high=3), "share")


@query(
    "A22_mean_over_engines",
    """
WITH c AS (SELECT engine, greatest(-2, least(length(peptide) - length(gt_peptide), 2)) AS distance,
  count(*) AS n FROM top_eval GROUP BY 1, 2),
s AS (SELECT distance, n / sum(n) OVER (PARTITION BY engine) AS share FROM c)
SELECT CAST(distance AS BIGINT) AS distance, round(avg(share), 6) AS mean_share FROM s GROUP BY 1
""",
)
def a22b(spark, sf):
    rows = V.top_eval(spark, sf).withColumn(
        "distance", (F.length("peptide") - F.length("gt_peptide")).cast("long")
    )
    hist = S.distance_histogram(rows, "distance", ["engine"], low=-2, high=2)
    return _r(S.mean_over(hist, ["distance"], "share"), "mean_share")


_COMBO_SQL = """
mem AS (SELECT DISTINCT run, spectrum_id, peptide, engine FROM psms),
com AS (SELECT run, spectrum_id, peptide, list(engine ORDER BY engine) AS m FROM mem GROUP BY 1, 2, 3)
"""


@query(
    "A26_intersections",
    "WITH " + _COMBO_SQL
    + "SELECT array_to_string(m, '|') AS combination, CAST(len(m) AS BIGINT) AS degree, count(*) AS n "
    "FROM com GROUP BY ALL",
)
def a26(spark, sf):
    return S.intersections(V.psms(spark, sf), ["run", "spectrum_id", "peptide"]).selectExpr(
        "combination", "CAST(degree AS BIGINT) AS degree", "n"
    )


@query(
    "A27_pairwise_overlap",
    """
WITH mem AS (SELECT DISTINCT run, spectrum_id, peptide, engine FROM evaluated WHERE correct),
sz AS (SELECT engine, count(*) AS n FROM mem GROUP BY 1),
sh AS (SELECT a.engine AS tool_a, b.engine AS tool_b, count(*) AS shared FROM mem a
  JOIN mem b USING (run, spectrum_id, peptide) GROUP BY 1, 2)
SELECT x.engine AS tool_a, y.engine AS tool_b, x.n AS size_a, coalesce(shared, 0) AS shared,
 round(coalesce(shared, 0) / x.n, 6) AS overlap
FROM sz x JOIN sz y ON x.engine <> y.engine LEFT JOIN sh ON sh.tool_a = x.engine AND sh.tool_b = y.engine
""",
)
def a27(spark, sf):
    rows = V.evaluated(spark, sf).filter("correct")
    return _r(S.pairwise_overlap(rows, ["run", "spectrum_id", "peptide"]), "overlap")


@query(
    "A28_consensus_false",
    """
WITH w AS (SELECT run, spectrum_id, peptide, count(DISTINCT engine) AS n_tools FROM evaluated
  WHERE error_type <> 'match' GROUP BY 1, 2, 3 HAVING count(DISTINCT engine) >= 2),
t AS (SELECT run, spectrum_id, error_type, row_number() OVER (PARTITION BY run, spectrum_id
  ORDER BY count(*) DESC, error_type) AS rn FROM evaluated GROUP BY 1, 2, 3)
SELECT run, spectrum_id, peptide, n_tools, error_type AS main_type FROM w JOIN t USING (run, spectrum_id)
WHERE rn = 1
""",
)
def a28(spark, sf):
    return S.consensus_false(V.evaluated(spark, sf), 2)


@query(
    "A29_species_counts",
    """
WITH s AS (SELECT run, spectrum_id, engine, rank, list(DISTINCT organism) AS o
 FROM (SELECT run, spectrum_id, engine, rank, unnest([spectrum_id % 200, psm_no % 200]) AS protein_id
  FROM psms) JOIN proteins USING (protein_id) GROUP BY 1, 2, 3, 4),
x AS (SELECT unnest(o) AS organism, len(o) AS k FROM s)
SELECT organism, count(*) AS count_all, count(*) FILTER (WHERE k = 1) AS count_specific FROM x GROUP BY 1
""",
)
def a29(spark, sf):
    rows = V.psms(spark, sf).withColumn(
        "protein_list", F.expr("array(spectrum_id % 200, CAST(psm_no % 200 AS BIGINT))")
    )
    species = J.species_of_proteins(rows, V.proteins(spark, sf), J.PSM_KEY)
    out = S.species_counts(species, False).join(S.species_counts(species), "organism", "left")
    return out.na.fill(0)


@query(
    "A30_modification_counts",
    """
SELECT run, m, count(*) AS n FROM (SELECT DISTINCT run, spectrum_id, m FROM (
 SELECT run, spectrum_id, unnest(regexp_extract_all(proforma, '\\[([^\\]]*)\\]', 1)) AS m FROM mod_rows))
GROUP BY 1, 2
""",
)
def a30(spark, sf):
    rows = V.mod_rows(spark, sf).select(
        "run", "spectrum_id", F.explode(P.modifications("proforma")).alias("m")
    ).distinct()
    return S.count_by(rows, "run", "m")


from psmweave.suite.q_projections import _ISO_SQL, _MASS_SQL  # noqa: E402


@query(
    "A31_precursor_error_counts",
    _MASS_SQL.replace("FROM psms)", "FROM psms UNION SELECT DISTINCT gt_peptide FROM gt)")
    + f""", pairs AS (SELECT p.engine, x.neutral / 2 + {K.PROTON_MASS!r}::DOUBLE AS a,
   y.neutral / 2 + {K.PROTON_MASS!r}::DOUBLE AS b
   FROM joined p JOIN w x ON x.peptide = p.peptide JOIN w y ON y.peptide = p.gt_peptide)
SELECT engine, count(*) AS n, count(*) FILTER (WHERE ppm >= 50) AS n_capped,
 round(avg((ppm >= 50)::INT), 6) AS share_capped FROM (SELECT engine, least(50.0::DOUBLE, {_ISO_SQL}) AS ppm
 FROM pairs) GROUP BY 1""",
)
def a31(spark, sf):
    rows = V.joined(spark, sf).select(
        "engine",
        P.precursor_ppm(
            P.peptide_mz("peptide", F.lit(2)), P.peptide_mz("gt_peptide", F.lit(2)), F.lit(2)
        ).alias("ppm"),
    )
    return _r(S.precursor_error_counts(rows), "share_capped")


@query(
    "A32_rank_distribution",
    "WITH " + _TRUTH_SQL + """, l AS (SELECT 'rank_score' AS m, rank_score AS rank FROM ranks
 UNION ALL SELECT 'rank_alt', rank_alt FROM ranks)
SELECT rank, count(*) FILTER (WHERE m = 'rank_score') AS rank_score, count(*) FILTER (WHERE m = 'rank_alt')
 AS rank_alt, count(*) FILTER (WHERE m = 'rank_alt') - count(*) FILTER (WHERE m = 'rank_score')
 AS gain_rank_alt FROM l GROUP BY 1
""",
)
def a32(spark, sf):
    return S.rank_distribution(
        _truth_ranks(spark, sf).select("rank_score", "rank_alt"), ["rank_score", "rank_alt"], "rank_score"
    )


@query(
    "A33_higher_scoring_rate",
    "SELECT engine, count(*) AS n, round(avg((score - gt_score > 0)::INT), 6) AS higher_rate, "
    "round(avg(score - gt_score), 6) AS mean_diff FROM top_eval WHERE error_type <> 'match' GROUP BY 1",
)
def a33(spark, sf):
    return _r(S.higher_scoring_rate(V.top_eval(spark, sf)), "higher_rate", "mean_diff")


@query(
    "A34_binned_heatmap",
    """
WITH b AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem),
r AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM b)
SELECT x_bin, y_bin, count(*) AS n FROM (SELECT
 CAST(least(greatest(ceil((x - r.a) / (r.b - r.a) * 10), 1), 10) AS BIGINT) AS x_bin,
 CAST(least(greatest(ceil((y - r.c) / (r.d - r.c) * 7), 1), 7) AS BIGINT) AS y_bin FROM b, r) GROUP BY 1, 2
""",
)
def a34(spark, sf):
    rows = V.table(spark, sf, "lineitem").selectExpr("l_quantity AS x", "l_discount AS y")
    return S.binned_heatmap(rows, "x", "y", 10, 7).selectExpr(
        "CAST(x_bin AS BIGINT) x_bin", "CAST(y_bin AS BIGINT) y_bin", "n"
    )


@query(
    "A36_one_sample_t",
    "WITH " + _REF_EVAL_SQL + """
SELECT engine, refiner, count(*) AS n, round(avg(d), 6) AS mean,
 round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM (
 SELECT engine, refiner, refined_score - score AS d FROM re) GROUP BY 1, 2
""",
)
def a36(spark, sf):
    rows = _refined_eval(spark, sf).withColumn("d", F.col("refined_score") - F.col("score"))
    out = S.one_sample_t(rows, "d", ["engine", "refiner"])
    return out.select("engine", "refiner", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query(
    "A37_skip_reason_counts",
    """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN vec_id % 13 = 0 THEN 'not_listed'
  WHEN 10 + vec_id % 20 < 15 THEN 'few_peaks' WHEN vec_id % 11 = 0 OR vec_id % 10 = 0 THEN 'no_charge'
  WHEN vec_id % 10 > 8 THEN 'high_charge' ELSE 'kept' END AS reason FROM embeddings) GROUP BY 1
""",
)
def a37(spark, sf):
    from psmweave.suite.q_projections import p15

    return S.count_by(p15(spark, sf), "reason")


@query(
    "A38_feature_correct_vs_rank",
    """
WITH c AS (SELECT correct AS found, rank, count(*) AS n FROM joined GROUP BY 1, 2)
SELECT found, CAST(rank AS INT) AS rank, n, round(n / sum(n) OVER (PARTITION BY found), 6) AS share FROM c
""",
)
def a38(spark, sf):
    rows = V.joined(spark, sf)
    return _r(S.flagged_shares(rows.filter("correct"), rows.filter("NOT correct"), "rank"), "share")


@query(
    "A39_group_map",
    "SELECT organism, protein_id, row_number() OVER (PARTITION BY organism ORDER BY protein_id) - 1 AS position "
    "FROM proteins WHERE organism IS NOT NULL",
)
def a39(spark, sf):
    return S.group_map(V.proteins(spark, sf), "organism", "protein_id")


# -- limits, samples, set operations -------------------------------------------------


@query(
    "T1_top_k",
    "SELECT peptide, count(*) AS n FROM psms GROUP BY 1 ORDER BY n DESC, peptide LIMIT 10",
)
def t1(spark, sf):
    return S.count_by(V.psms(spark, sf), "peptide").orderBy(F.desc("n"), "peptide").limit(10)


@query(
    "T2_top_n_peaks",
    """
SELECT spectrum_id, peak_no, round(intensity, 4) AS intensity FROM (SELECT *, row_number() OVER (
 PARTITION BY spectrum_id ORDER BY intensity DESC, peak_no) AS rn FROM peaks) WHERE rn <= 15
""",
)
def t2(spark, sf):
    best = W.top_k(
        V.peaks(spark, sf), 15, ["spectrum_id"], [("intensity", False), ("peak_no", True)]
    )
    return _r(best.select("spectrum_id", "peak_no", "intensity"), "intensity", places=4)


@query(
    "T3_min_group_size",
    "WITH " + _COMBO_SQL
    + "SELECT array_to_string(m, '|') AS combination, count(*) AS n FROM com GROUP BY ALL HAVING count(*) >= 20",
)
def t3(spark, sf):
    combos = S.intersections(V.psms(spark, sf), ["run", "spectrum_id", "peptide"])
    return combos.filter("n >= 20").select("combination", "n")


@query(
    "T4_sample_per_group",
    "SELECT run, spectrum_id, engine, psm_no FROM psms QUALIFY row_number() OVER (PARTITION BY run, spectrum_id "
    "ORDER BY md5(concat_ws('|', '7', engine, psm_no::VARCHAR)), engine, psm_no) <= 3",
)
def t4(spark, sf):
    """Seeded sample: 3 PSMs per spectrum (the sampling operator itself)."""
    return W.sample_per_group(
        V.psms(spark, sf), J.KEY, 3, ["engine", "psm_no"], seed=7
    ).select(*J.KEY, "engine", "psm_no")


@query(
    "T4_sample_sizes",
    "SELECT run, spectrum_id, least(count(*), 3) AS n FROM psms GROUP BY 1, 2",
)
def t4b(spark, sf):
    """How many rows the sample holds per spectrum."""
    return S.count_by(t4(spark, sf), *J.KEY)


@query(
    "U1_union_tables",
    "SELECT run, spectrum_id, 'psm' AS kind, peptide FROM psms UNION ALL "
    "SELECT run, spectrum_id, 'gt', gt_peptide FROM gt",
)
def u1(spark, sf):
    a = V.psms(spark, sf).select(*J.KEY, F.lit("psm").alias("kind"), "peptide")
    b = V.gt(spark, sf).select(*J.KEY, F.lit("gt").alias("kind"), F.col("gt_peptide").alias("peptide"))
    return a.unionByName(b)


@query(
    "U2_union_ragged",
    "SELECT run, spectrum_id, engine, peptide, NULL::DOUBLE AS qvalue FROM psms UNION ALL "
    "SELECT run, spectrum_id, NULL, NULL, round(qvalue, 6) FROM gt",
)
def u2(spark, sf):
    a = V.psms(spark, sf).select(*J.KEY, "engine", "peptide")
    b = V.gt(spark, sf).select(*J.KEY, F.round("qvalue", 6).alias("qvalue"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "U3_distinct_union",
    "SELECT run, spectrum_id FROM psms WHERE engine = 'engine_0' UNION "
    "SELECT run, spectrum_id FROM psms WHERE engine = 'engine_1'",
)
def u3(spark, sf):
    p = V.psms(spark, sf)
    ids = [p.filter(F.col("engine") == e).select(*J.KEY) for e in ("engine_0", "engine_1")]
    return ids[0].union(ids[1]).distinct()


@query(
    "U4_intersect",
    "SELECT run, spectrum_id, peptide FROM psms WHERE engine = 'engine_0' INTERSECT "
    "SELECT run, spectrum_id, peptide FROM psms WHERE engine = 'engine_1'",
)
def u4(spark, sf):
    p = V.psms(spark, sf)
    a, b = (
        p.filter(F.col("engine") == e).select(*J.KEY, "peptide") for e in ("engine_0", "engine_1")
    )
    return a.intersect(b)


@query(
    "U5_except",
    "SELECT run, spectrum_id FROM gt EXCEPT SELECT run, spectrum_id FROM joined WHERE correct",
)
def u5(spark, sf):
    correct = V.joined(spark, sf).filter("correct").select(*J.KEY)
    return V.gt(spark, sf).select(*J.KEY).join(correct, J.KEY, "left_anti")
