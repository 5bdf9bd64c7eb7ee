"""Queries for joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave.operators import joins as J
from psmweave.suite import views as V
from psmweave.suite.registry import query

_KEYED = "run, spectrum_id, engine, rank"


@query(
    "J1_join_by_title",
    "SELECT p.run, p.spectrum_id, p.engine, p.rank, round(g.gt_score, 6) AS gt_score "
    "FROM psms p JOIN gt g USING (run, spectrum_id)",
)
def j1(spark, sf):
    out = J.join_by_key(V.psms(spark, sf), V.gt(spark, sf), J.KEY)
    return out.select("run", "spectrum_id", "engine", "rank", F.round("gt_score", 6).alias("gt_score"))


@query(
    "J1_join_loss",
    """
SELECT CAST(count(*) FILTER (WHERE g.spectrum_id IS NULL) AS BIGINT) AS results_lost,
 (SELECT count(*) FROM gt_ok x WHERE NOT EXISTS (SELECT 1 FROM psms p
   WHERE p.run = x.run AND p.spectrum_id = x.spectrum_id)) AS spectra_without_result
FROM psms p LEFT JOIN gt_ok g USING (run, spectrum_id)
""",
)
def j1b(spark, sf):
    return J.join_loss(V.psms(spark, sf), V.gt_ok(spark, sf), J.KEY)


_ORD = "row_number() OVER (PARTITION BY run ORDER BY spectrum_id) - 1"


def _with_ordinal(df):
    """Stored ordinals, as the readers write them at ingest."""
    from psmweave.operators.running import rank_rows

    ranked = rank_rows(df, ["run"], [("spectrum_id", True)], "first", "ordinal")
    return ranked.withColumn("ordinal", (F.col("ordinal") - 1).cast("long"))


@query(
    "J2_join_by_index",
    f"""
WITH s AS (SELECT run, spectrum_id, {_ORD} AS ordinal FROM gt),
r AS (SELECT run, dense_rank() OVER (PARTITION BY run ORDER BY spectrum_id) - 1 AS ordinal, engine, rank, score
 FROM psms)
SELECT r.run, r.ordinal, r.engine, s.spectrum_id, count(*) AS n, round(sum(r.score), 4) AS score
FROM r JOIN s USING (run, ordinal) GROUP BY ALL
""",
)
def j2(spark, sf):
    spectra = _with_ordinal(V.gt(spark, sf).select("run", "spectrum_id"))
    psms = V.psms(spark, sf)
    places = _with_ordinal(psms.select("run", "spectrum_id").distinct())
    results = psms.join(places, ["run", "spectrum_id"]).select("run", "ordinal", "engine", "rank", "score")
    return (
        J.join_by_key(results, spectra, ["run", "ordinal"])
        .groupBy("run", "ordinal", "engine", "spectrum_id")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))
    )


@query(
    "J3_zip_positional",
    f"""
WITH s AS (SELECT run, spectrum_id, {_ORD} AS ordinal FROM gt),
r AS (SELECT run, gt_peptide AS prediction, {_ORD} AS ordinal FROM gt)
SELECT run, ordinal, spectrum_id, prediction FROM r JOIN s USING (run, ordinal)
""",
)
def j3(spark, sf):
    base = _with_ordinal(V.gt(spark, sf))
    spectra = base.select("run", "ordinal", "spectrum_id")
    results = base.select("run", "ordinal", F.col("gt_peptide").alias("prediction"))
    return J.zip_positional(results, spectra)


@query("J4_attach_ground_truth", f"SELECT {_KEYED}, peptide, gt_peptide, correct FROM joined")
def j4(spark, sf):
    return V.joined(spark, sf).select(*J.PSM_KEY, "peptide", "gt_peptide", "correct")


@query(
    "J4_attach_ground_truth_keep_all",
    f"""
SELECT p.run, p.spectrum_id, p.engine, p.rank,
 CASE WHEN NOT is_decoy AND qvalue <= 0.01 THEN 'accepted' ELSE 'rejected' END AS gt_status
FROM psms p JOIN gt USING (run, spectrum_id)
""",
)
def j4b(spark, sf):
    out = J.attach_ground_truth(
        V.psms(spark, sf), V.gt(spark, sf), filter_by_gt=False, filter_decoys=False
    )
    return out.select(*J.PSM_KEY, "gt_status")


@query(
    "J5_attach_refinement",
    """
WITH n AS (SELECT run, spectrum_id, engine, count(*) AS n FROM psms GROUP BY ALL)
SELECT r.run, r.spectrum_id, r.engine, r.rank, r.refiner, CASE WHEN p.rank IS NULL THEN 'no_base' ELSE 'matched' END AS status,
 replace(p.peptide, 'L', 'I') = replace(r.refined_peptide, 'L', 'I') AS unchanged,
 CASE WHEN replace(p.peptide, 'L', 'I') <> replace(r.refined_peptide, 'L', 'I')
  THEN r.refined_peptide END AS refined_peptide,
 round(r.refined_score, 6) AS refined_score
FROM refinements r LEFT JOIN psms p ON p.run = r.run AND p.spectrum_id = r.spectrum_id AND p.engine = r.engine
 AND p.rank = r.rank
""",
)
def j5(spark, sf):
    return J.attach_refinement(V.psms(spark, sf), V.refinements(spark, sf)).select(
        *J.PSM_KEY,
        "refiner",
        "status",
        "unchanged",
        "refined_peptide",
        F.round("refined_score", 6).alias("refined_score"),
    )


@query(
    "J6_attach_scores_with_status",
    """
WITH ext AS (SELECT run, spectrum_id, concat('engine_', CAST((CAST(substr(engine, 8) AS INT) * 2)
   AS STRING)) AS engine, rank FROM psms)
SELECT CASE WHEN g.spectrum_id IS NULL THEN 'spectrum not found'
  WHEN e.engine NOT IN ('engine_0', 'engine_2', 'engine_4', 'engine_6') THEN 'source psm not found'
  WHEN p.rank IS NOT NULL THEN 'registered' ELSE 'rank not found' END AS status, count(*) AS n
FROM ext e LEFT JOIN gt_ok g USING (run, spectrum_id)
LEFT JOIN (SELECT DISTINCT run, spectrum_id, engine, rank FROM psms) p
  USING (run, spectrum_id, engine, rank) GROUP BY 1
""",
)
def j6(spark, sf):
    psms = V.psms(spark, sf)
    ext = psms.selectExpr(
        "run",
        "spectrum_id",
        "concat('engine_', CAST((CAST(substr(engine, 8) AS INT) * 2) AS STRING)) AS engine",
        "rank",
    )
    out = J.attach_scores_with_status(
        ext, psms, V.gt_ok(spark, sf), ["engine_0", "engine_2", "engine_4", "engine_6"]
    )
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_FEATURE_SQL = (
    "SELECT run, spectrum_id, engine, CASE WHEN psm_no = 3 THEN rank + 1000 ELSE rank END AS rank, "
    "length(peptide) AS n_residues, score * score AS squared FROM psms"
)


def _features(spark, sf):
    """Features of all PSMs; some stand under ranks that no PSM has."""
    return V.psms(spark, sf).selectExpr(
        "run", "spectrum_id", "engine", "CASE WHEN psm_no = 3 THEN rank + 1000 ELSE rank END AS rank", "length(peptide) AS n_residues", "score * score AS squared"
    )


@query(
    "J7_attach_features",
    f"""
WITH f AS ({_FEATURE_SQL})
SELECT {_KEYED}, peptide, n_residues, round(squared, 6) AS squared
FROM psms JOIN f USING ({_KEYED})
""",
)
def j7(spark, sf):
    return J.attach_features(V.psms(spark, sf), _features(spark, sf)).select(
        *J.PSM_KEY, "peptide", "n_residues", F.round("squared", 6).alias("squared")
    )


@query(
    "J8_score_feature_table",
    f"""
WITH f AS ({_FEATURE_SQL})
SELECT e.run, e.spectrum_id, e.engine, e.error_type, round(e.score - e.gt_score, 6) AS score_diff,
 f.n_residues FROM top_eval e JOIN f USING ({_KEYED})
""",
)
def j8(spark, sf):
    return J.attach_features(V.top_eval(spark, sf), _features(spark, sf)).select(
        "run",
        "spectrum_id",
        "engine",
        "error_type",
        F.round(F.col("score") - F.col("gt_score"), 6).alias("score_diff"),
        "n_residues",
    )


@query(
    "J9_natural_merge",
    """
WITH a AS (SELECT run, spectrum_id, rank, score AS score_a, psm_no FROM psms WHERE engine = 'engine_0'),
b AS (SELECT run, spectrum_id, rank, score AS score_b FROM psms WHERE engine = 'engine_1'),
c AS (SELECT run, spectrum_id, rank, score AS score_c FROM psms WHERE engine = 'engine_2')
SELECT run, spectrum_id, rank, score_a, score_b, score_c
FROM a JOIN b USING (run, spectrum_id, rank) JOIN c USING (run, spectrum_id, rank)
""",
)
def j9(spark, sf):
    psms = V.psms(spark, sf)

    def side(engine, name):
        return psms.filter(F.col("engine") == engine).select(
            "run", "spectrum_id", "rank", F.col("score").alias(name)
        )

    return J.append_scores(
        side("engine_0", "score_a"),
        [side("engine_1", "score_b"), side("engine_2", "score_c")],
        ["run", "spectrum_id", "rank"],
    )


@query(
    "J10_common_spectra",
    """
SELECT run, spectrum_id FROM psms WHERE engine IN ('engine_0', 'engine_1')
GROUP BY 1, 2 HAVING count(DISTINCT engine) = 2
""",
)
def j10(spark, sf):
    return J.common_spectra(V.psms(spark, sf), ["engine_0", "engine_1"])


@query(
    "J11_unique_spectra",
    """
SELECT run, spectrum_id FROM psms GROUP BY 1, 2
HAVING count(DISTINCT engine) = 1 AND min(engine) = 'engine_3'
""",
)
def j11(spark, sf):
    return J.unique_spectra(V.psms(spark, sf), "engine_3")


_SEV = (
    "CASE error_type WHEN 'match' THEN 0 WHEN 'isobaric_aa' THEN 1 WHEN 'isobaric_peak' THEN 2 "
    "WHEN 'Higher score' THEN 3 WHEN 'Lower score' THEN 4 ELSE 5 END"
)


@query(
    "J12_correct_spectra",
    f"""
SELECT run, spectrum_id, count(*) FILTER (WHERE s <= 1) <= 1 AS exclusive
FROM (SELECT *, {_SEV} AS s FROM evaluated) GROUP BY 1, 2
HAVING count(*) FILTER (WHERE s <= 1 AND engine IN ('engine_0', 'engine_1', 'engine_2')) > 0
""",
)
def j12(spark, sf):
    ev = V.evaluated(spark, sf)
    engines = ["engine_0", "engine_1", "engine_2"]
    anyone = J.correct_spectra(ev, engines, "isobaric_aa")
    alone = J.correct_spectra(ev, engines, "isobaric_aa", exclusive=True)
    return anyone.join(alone.withColumn("x", F.lit(True)), J.KEY, "left").select(
        *J.KEY, F.coalesce("x", F.lit(False)).alias("exclusive")
    )


@query(
    "J13_modified_spectra",
    """
SELECT run, spectrum_id, count(*) AS n FROM mod_rows
WHERE proforma LIKE '%[UNIMOD:35]%' AND proforma NOT LIKE '%[UNIMOD:1]%'
 AND proforma NOT LIKE '%[UNIMOD:5]%' GROUP BY ALL
""",
)
def j13(spark, sf):
    return (
        J.modified_spectra(
            V.mod_rows(spark, sf), "UNIMOD:35", ["UNIMOD:1", "UNIMOD:5"], peptide="proforma"
        )
        .groupBy("run", "spectrum_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "J14_exclude_out_of_scope",
    f"""
SELECT {_KEYED} FROM psms p WHERE NOT (engine = 'engine_5' AND EXISTS (SELECT 1 FROM mod_rows m
 WHERE m.run = p.run AND m.spectrum_id = p.spectrum_id AND m.proforma LIKE '%[UNIMOD:7]%'))
""",
)
def j14(spark, sf):
    scope = J.modified_spectra(V.mod_rows(spark, sf), "UNIMOD:7", peptide="proforma")
    return J.exclude_out_of_scope(V.psms(spark, sf), scope, "engine_5").select(*J.PSM_KEY)


@query(
    "J15_semi_by_ids",
    f"SELECT {_KEYED} FROM psms WHERE (run, spectrum_id) IN (SELECT (run, spectrum_id) FROM gt_ok)",
)
def j15(spark, sf):
    return J.semi_by_ids(V.psms(spark, sf), V.gt_ok(spark, sf)).select(*J.PSM_KEY)


@query(
    "J18_species_of_proteins",
    """
SELECT run, spectrum_id, engine, rank, array_to_string(list_sort(list(DISTINCT organism)), ',')
 AS species, count(DISTINCT organism) AS species_n
FROM (SELECT run, spectrum_id, engine, rank, unnest([spectrum_id % 200, psm_no % 200]) AS protein_id
      FROM psms) JOIN proteins USING (protein_id) GROUP BY ALL
""",
)
def j18(spark, sf):
    rows = V.psms(spark, sf).withColumn(
        "protein_list", F.expr("array(spectrum_id % 200, CAST(psm_no % 200 AS BIGINT))")
    )
    return J.species_of_proteins(rows, V.proteins(spark, sf), J.PSM_KEY).select(
        *J.PSM_KEY,
        F.array_join("species", ",").alias("species"),
        F.col("species_n").cast("long").alias("species_n"),
    )


@query(
    "J22_anti_candidates",
    """
SELECT g.run, g.spectrum_id, g.gt_peptide AS peptide FROM gt g WHERE NOT EXISTS (
 SELECT 1 FROM psms p WHERE p.run = g.run AND p.spectrum_id = g.spectrum_id
 AND p.peptide = g.gt_peptide)
""",
)
def j22(spark, sf):
    cands = V.gt(spark, sf).select("run", "spectrum_id", F.col("gt_peptide").alias("peptide"))
    return J.anti_candidates(cands, V.psms(spark, sf), ["run", "spectrum_id", "peptide"])


@query(
    "J23_identified_scans",
    """
SELECT g.run, g.spectrum_id AS scan_number, p.engine, p.peptide
FROM (SELECT run, CASE WHEN spectrum_id % 2 = 0 THEN spectrum_id ELSE -1 - spectrum_id END AS spectrum_id FROM gt) g
JOIN top_psms p ON p.run = g.run AND p.spectrum_id = g.spectrum_id
""",
)
def j23(spark, sf):
    spectra = V.gt(spark, sf).selectExpr(
        "run", "CASE WHEN spectrum_id % 2 = 0 THEN spectrum_id ELSE -1 - spectrum_id END AS scan_number"
    )
    psms = V.psms(spark, sf).withColumn(
        "spectrum_id",
        F.concat(F.lit("controllerType=0 controllerNumber=1 scan="), F.col("spectrum_id").cast("string")),
    )
    return J.identified_scans(spectra, psms).select("run", "scan_number", "engine", "peptide")


@query(
    "J24_score_requests",
    f"""
WITH s AS (SELECT run, spectrum_id, {_ORD} AS ordinal FROM gt),
m AS (SELECT run, spectrum_id, min(split_part(proforma, '/', 1)) AS p FROM mod_rows GROUP BY ALL)
SELECT run, spectrum_id, ordinal, CASE WHEN p LIKE '[UNIMOD%' OR p LIKE '[+25%' OR p LIKE '%Q[UN%'
 OR p LIKE '%N[UN%' THEN NULL ELSE replace(replace(p, 'C[UNIMOD:4]', 'C(1)'), 'M[UNIMOD:35]', 'M(0)')
 END AS sequence, CASE WHEN ordinal % 3 = 0 THEN NULL ELSE ordinal * 2 END AS returned
FROM m JOIN s USING (run, spectrum_id)
""",
)
def j24(spark, sf):
    spectra = _with_ordinal(V.gt(spark, sf).select("run", "spectrum_id"))
    psms = (
        V.mod_rows(spark, sf)
        .groupBy("run", "spectrum_id")
        .agg(F.min(F.substring_index("proforma", "/", 1)).alias("peptide"))
    )
    requests = J.score_requests(psms, spectra, "casanovo", "novor")
    returned = spectra.selectExpr(
        "run", "CASE WHEN ordinal % 3 = 0 THEN -1 - ordinal ELSE ordinal END AS ordinal", "ordinal * 2 AS returned"
    )
    return J.attach_returned_scores(requests, returned, ["run", "ordinal"]).select(
        "run", "spectrum_id", "ordinal", "sequence", "returned"
    )
