"""Queries for curves and running counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave.operators import curves as C
from psmweave.operators import joins as J
from psmweave.runtime import shared_shuffle
from psmweave.suite import views as V
from psmweave.suite.registry import query


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


_LEVELS = """
lv AS (SELECT engine, score, count(*) AS n, count(*) FILTER (WHERE correct) AS c
       FROM {src} GROUP BY 1, 2),
cum AS (SELECT *, coalesce(sum(n) OVER w, 0) AS an, coalesce(sum(c) OVER w, 0) AS ac,
  sum(n) OVER (PARTITION BY engine) AS tn, sum(c) OVER (PARTITION BY engine) AS tc FROM lv
  WINDOW w AS (PARTITION BY engine ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT engine, score, n, ac AS tp, an - ac AS fp, tc - ac - c AS fn, tn - an - n AS u,
  (SELECT count(*) FROM gt_ok) - an AS u_mgf FROM cum),
curve AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN tp + fp + u > 0 THEN (tp + fp) / (tp + fp + u) END AS coverage,
  CASE WHEN tp + fp + u_mgf <> 0 THEN (tp + fp) / (tp + fp + u_mgf) END AS coverage_mgf FROM m)
"""


def _top(spark, sf):
    return V.joined(spark, sf).filter("rank = 1")


def _n_spectra(spark, sf):
    return V.gt_ok(spark, sf).agg(F.count(F.lit(1))).scalar()


@query(
    "A1_precision_coverage",
    "WITH top_joined AS (SELECT * FROM joined WHERE rank = 1), "
    + _LEVELS.format(src="top_joined")
    + """SELECT t.run, t.spectrum_id, t.engine, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
 CAST(fn AS BIGINT) AS fn, CAST(u AS BIGINT) AS u, CAST(u_mgf AS BIGINT) AS u_mgf,
 round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage,
 round(coverage_mgf, 6) AS coverage_mgf
 FROM top_joined t JOIN curve USING (engine, score)""",
)
def a1(spark, sf):
    top = _top(spark, sf)
    curve = C.precision_coverage(top, _n_spectra(spark, sf)).drop("n_rows")
    out = top.select("run", "spectrum_id", "engine", "score").join(curve, ["engine", "score"])
    return _r(out.drop("score"), "precision", "recall", "coverage", "coverage_mgf")


@query(
    "A1_precision_coverage_split",
    "WITH " + _LEVELS.format(src="scored")
    + """SELECT engine, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
 CAST(fn AS BIGINT) AS fn, CAST(u AS BIGINT) AS u, round(precision, 6) AS precision FROM curve""",
)
def a1b(spark, sf):
    """Same operator on the path for very large groups."""
    curve = C.precision_coverage(V.scored(spark, sf), _n_spectra(spark, sf), strategy="split")
    return _r(curve.select("engine", "score", "tp", "fp", "fn", "u", "precision"), "precision")


@query(
    "A2_threshold_at_precision",
    "WITH " + _LEVELS.format(src="scored")
    + """SELECT engine, min(score) AS score, round(arg_min(precision, score), 6) AS precision
 FROM curve WHERE precision > 0.9 GROUP BY 1""",
)
def a2(spark, sf):
    curve = C.precision_coverage(V.scored(spark, sf), _n_spectra(spark, sf))
    return _r(C.threshold_at_precision(curve, 0.9), "precision")


_MATCH_TYPE = (
    "CASE WHEN correct THEN 'Match' WHEN lenient THEN 'Better' "
    "WHEN spectrum_id % 3 = 0 THEN 'Isobaric' ELSE 'Worse' END"
)


@query(
    "A3_accuracy_profile",
    "WITH "
    + _LEVELS.format(src="scored")
    + ", "
    + _LEVELS.format(src="(SELECT engine, score, lenient AS correct FROM scored)")
    .replace("lv AS", "lv2 AS").replace("FROM lv\n", "FROM lv2\n").replace("cum AS", "cum2 AS")
    .replace("FROM cum)", "FROM cum2)").replace("\nm AS", "\nm2 AS").replace("FROM m)", "FROM m2)")
    .replace("curve AS", "curve2 AS")
    + f""", th AS (SELECT unnest([0.99, 0.95, 0.9, 0.85, 0.8])::DOUBLE AS threshold),
p AS (SELECT engine, 'strict' AS mode, threshold, min(score) AS score, arg_min(recall, score) AS recall,
  arg_min(coverage, score) AS coverage FROM curve, th WHERE precision > threshold GROUP BY ALL
 UNION ALL SELECT engine, 'lenient', threshold, min(score), arg_min(recall, score),
  arg_min(coverage, score) FROM curve2, th WHERE precision > threshold GROUP BY ALL),
sh AS (SELECT p.engine, p.mode, p.threshold, avg((t = 'Match')::INT) AS share_match,
  avg((t = 'Better')::INT) AS share_better, avg((t = 'Worse')::INT) AS share_worse,
  avg((t = 'Isobaric')::INT) AS share_isobaric
 FROM p JOIN (SELECT engine, score, {_MATCH_TYPE} AS t FROM scored) s
   ON s.engine = p.engine AND s.score >= p.score WHERE p.mode = 'lenient' GROUP BY ALL)
SELECT engine, mode, threshold, score, round(recall, 6) AS recall, round(coverage, 6) AS coverage,
 round(share_match, 6) AS share_match, round(share_better, 6) AS share_better,
 round(share_worse, 6) AS share_worse, round(share_isobaric, 6) AS share_isobaric
FROM p LEFT JOIN sh USING (engine, mode, threshold)""",
)
def a3(spark, sf):
    rows = V.scored(spark, sf).withColumn("match_type", F.expr(_MATCH_TYPE))
    out = C.accuracy_profile(rows, _n_spectra(spark, sf))
    shares = ["share_match", "share_better", "share_worse", "share_isobaric"]
    return _r(out, "recall", "coverage", *shares)


@query(
    "A9_pr_auc",
    """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY score, spectrum_id) - 1 AS pos,
  count(*) OVER (PARTITION BY engine) AS n FROM scored),
th AS (SELECT DISTINCT engine, score AS t FROM s, range(21) q(i)
  WHERE pos = CASE WHEN i = 20 THEN n - 1 ELSE CAST(floor(n * i / 20) AS BIGINT) END),
pt AS (SELECT th.engine, t, count(*) FILTER (WHERE s.score >= t AND correct) / count(*) AS recall,
  count(*) FILTER (WHERE s.score >= t AND correct) / count(*) FILTER (WHERE s.score >= t) AS precision
  FROM th JOIN s ON s.engine = th.engine GROUP BY ALL),
d AS (SELECT engine, (recall - lag(recall) OVER w) * (precision + lag(precision) OVER w) / 2 AS a
  FROM pt WINDOW w AS (PARTITION BY engine ORDER BY t DESC))
SELECT engine, round(coalesce(sum(a), 0), 6) AS auc FROM d GROUP BY 1
""",
)
def a9(spark, sf):
    return _r(C.pr_auc(V.scored(spark, sf)), "auc")


@query(
    "A10_prc_linspace",
    """
WITH sp AS (SELECT engine, max(score) AS hi, min(score) AS lo, count(*) AS n FROM scored GROUP BY 1),
th AS (SELECT engine, n, k, CASE WHEN k = 999 THEN lo ELSE hi + k * ((lo - hi) / 999) END AS threshold
  FROM sp, range(1000) r(k)),
x AS (SELECT engine, k, n, threshold, (SELECT count(*) FROM scored s WHERE s.engine = th.engine
   AND s.score > th.threshold) AS ci, (SELECT count(*) FROM scored s WHERE s.engine = th.engine
   AND s.score > th.threshold AND s.correct) AS c FROM th)
SELECT engine, k, round(threshold, 6) AS threshold, round(CASE WHEN ci > 0 THEN c / ci END, 6) AS precision,
 round(c / n, 6) AS recall, round(ci / n, 6) AS coverage FROM x
""",
)
def a10(spark, sf):
    return _r(C.prc_linspace(V.scored(spark, sf)), "threshold", "precision", "recall", "coverage")


_GRID_SQL = """
s AS (SELECT *, row_number() OVER w AS r, count(*) FILTER (WHERE correct) OVER w AS cc,
  count(*) OVER (PARTITION BY engine) AS n FROM {src}
  WINDOW w AS (PARTITION BY engine ORDER BY score DESC, spectrum_id))
SELECT engine, k, round(cc / r, 6) AS precision, round(cc / n, 6) AS recall, round(r / n, 6) AS coverage
FROM s JOIN (SELECT range AS k FROM range(1, 200)) ON r = (k * n + 198) // 199
"""


@query("A11_prc_coverage_grid", "WITH " + _GRID_SQL.format(src="scored"))
def a11(spark, sf):
    return _r(C.prc_coverage_grid(V.scored(spark, sf)), "precision", "recall", "coverage")


@query("A11_prc_coverage_grid_split", "WITH " + _GRID_SQL.format(src="scored"))
def a11b(spark, sf):
    """Same operator on the path for very large groups."""
    out = C.prc_coverage_grid(V.scored(spark, sf), strategy="split")
    return _r(out, "precision", "recall", "coverage")


_REFINED_SQL = """
rj AS (SELECT j.run, j.spectrum_id, j.engine, j.rank, r.refiner, j.score, j.correct,
  replace(j.peptide, 'L', 'I') = replace(r.refined_peptide, 'L', 'I') AS unchanged, r.refined_score,
  replace(r.refined_peptide, 'L', 'I') = replace(j.gt_peptide, 'L', 'I') AS refined_correct
  FROM joined j JOIN refinements r USING (run, spectrum_id, engine, rank) WHERE j.rank = 1)
"""


def _refined(spark, sf, rows=None):
    from psmweave.functions import peptide as P

    rows = V.psms(spark, sf) if rows is None else rows
    top = V.joined(spark, sf, rows).filter("rank = 1")
    ref = J.attach_refinement(rows, V.refinements(spark, sf, rows))
    truth = top.select(*J.PSM_KEY, "gt_peptide")
    out = ref.join(truth, J.PSM_KEY)
    return top, out.withColumn(
        "refined_correct", P.equate_leu_ile("proposed_peptide") == P.equate_leu_ile("gt_peptide")
    )


@query(
    "A12_match_score_table",
    "WITH " + _REFINED_SQL
    + """SELECT run, spectrum_id, engine, rank, refiner,
 round(CASE WHEN unchanged THEN score ELSE refined_score END, 6) AS score,
 CASE WHEN unchanged THEN correct ELSE refined_correct END AS match FROM rj""",
)
def a12(spark, sf):
    top, ref = _refined(spark, sf)
    return _r(C.match_score_table(top, J.PSM_KEY, ref), "score")


@query(
    "A12_exact_pr_curve",
    """
WITH lv AS (SELECT engine, score, count(*) AS n, count(*) FILTER (WHERE correct) AS c
  FROM scored GROUP BY 1, 2),
x AS (SELECT engine, score, sum(n) OVER w AS an, sum(c) OVER w AS ac,
  sum(c) OVER (PARTITION BY engine) AS tc FROM lv WINDOW w AS (PARTITION BY engine ORDER BY score DESC))
SELECT engine, score, round(ac / an, 6) AS precision, round(ac / tc, 6) AS recall FROM x
""",
)
def a12b(spark, sf):
    out = C.exact_pr_curve(V.scored(spark, sf), ["engine"], match="correct")
    return _r(out, "precision", "recall")


@query(
    "A12_missing_refinements",
    "WITH " + _REFINED_SQL
    + """SELECT engine, count(*) AS missing FROM joined j WHERE rank = 1 AND NOT EXISTS
 (SELECT 1 FROM rj WHERE rj.run = j.run AND rj.spectrum_id = j.spectrum_id AND rj.engine = j.engine
  AND rj.rank = j.rank) GROUP BY 1""",
)
def a12c(spark, sf):
    top, ref = _refined(spark, sf)
    return C.missing_refinements(top, ref, J.PSM_KEY)


@query(
    "A13_score_dict_tables",
    "WITH " + _REFINED_SQL + """,
l AS (SELECT engine, 'engine_score' AS scoring, 'base' AS refinement, run, spectrum_id, score, correct AS m
   FROM joined WHERE rank = 1
 UNION ALL SELECT engine, 'gap_score', 'base', run, spectrum_id, score - gt_score, correct
   FROM joined WHERE rank = 1
 UNION ALL SELECT engine, 'refiner_score', refiner, run, spectrum_id,
   CASE WHEN unchanged THEN score ELSE refined_score END,
   CASE WHEN unchanged THEN correct ELSE refined_correct END FROM rj),
s AS (SELECT *, row_number() OVER w AS r, count(*) FILTER (WHERE m) OVER w AS cc,
  count(*) OVER (PARTITION BY engine, scoring, refinement) AS n FROM l
  WINDOW w AS (PARTITION BY engine, scoring, refinement ORDER BY score DESC, run, spectrum_id))
SELECT engine, scoring, refinement, k, round(cc / r, 6) AS precision, round(cc / n, 6) AS recall,
 round(r / n, 6) AS coverage
FROM s JOIN (SELECT range AS k FROM range(1, 200)) ON r = (k * n + 198) // 199
""",
)
def a13(spark, sf):
    from psmweave.plans.benchmark import score_tables

    with shared_shuffle(V.psms(spark, sf)) as psms:
        top, ref = _refined(spark, sf, psms)
        refined = C.match_score_table(top, J.PSM_KEY, ref)
        long = score_tables(
            [
                ("engine_score", top.select(*J.KEY, "engine", "score", "correct")),
                (
                    "gap_score",
                    top.select(
                        *J.KEY, "engine", (F.col("score") - F.col("gt_score")).alias("score"), "correct"
                    ),
                ),
            ],
            [("refiner_score", refined.withColumnRenamed("match", "correct"))],
        )
        out = C.prc_coverage_grid(
            long,
            ["engine", "scoring", "refinement"],
            [("score", False), ("run", True), ("spectrum_id", True)],
        )
    return _r(out, "precision", "recall", "coverage")


@query(
    "A14_precision_coverage_by_run",
    """
WITH a AS (SELECT run, count(*) AS n_all FROM gt_ok GROUP BY 1),
e AS (SELECT engine, run, count(*) AS n_predicted, count(*) FILTER (WHERE correct) AS n_correct
      FROM joined WHERE rank = 1 GROUP BY 1, 2)
SELECT engine, run, n_predicted, n_correct, n_all, round(n_correct / n_predicted, 6) AS precision,
 round(n_predicted / n_all, 6) AS coverage FROM e JOIN a USING (run)
""",
)
def a14(spark, sf):
    out = C.precision_coverage_by_run(_top(spark, sf), V.gt_ok(spark, sf))
    return _r(out, "precision", "coverage")


@query(
    "A35_spearman",
    """
WITH a AS (SELECT spectrum_id, count(*) AS n, avg(score) AS x, CAST(min(psm_no) AS DOUBLE) AS y
  FROM psms GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM
  (SELECT round(x, 6) AS x, y FROM a))
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r
""",
)
def a35(spark, sf):
    rows = V.psms(spark, sf).groupBy("spectrum_id").agg(
        F.round(F.avg("score"), 6).alias("x"), F.min("psm_no").cast("double").alias("y")
    )
    return _r(C.spearman(rows, "x", "y"), "rho")


@query(
    "W6_running_counts",
    """
WITH lv AS (SELECT run, engine, score, count(*) AS n, count(*) FILTER (WHERE correct) AS c
  FROM scored GROUP BY ALL)
SELECT run, engine, score, CAST(sum(n) OVER w AS BIGINT) AS at_or_above,
 CAST(sum(c) OVER w AS BIGINT) AS correct_at_or_above
FROM lv WINDOW w AS (PARTITION BY run, engine ORDER BY score DESC)
""",
)
def w6(spark, sf):
    p = C.prefix_counts(V.scored(spark, sf), ["run", "engine"], inclusive=True)
    return p.select(
        "run",
        "engine",
        "score",
        F.col("above_n").alias("at_or_above"),
        F.col("above_c").alias("correct_at_or_above"),
    )


@query(
    "W7_cumulative_share",
    """
WITH c AS (SELECT engine, rank, count(*) AS n FROM psms GROUP BY 1, 2)
SELECT engine, CAST(rank AS INT) AS rank, round(n / sum(n) OVER (PARTITION BY engine), 6) AS share,
 round(sum(n) OVER (PARTITION BY engine ORDER BY rank) / sum(n) OVER (PARTITION BY engine), 6) AS cumulative
FROM c
""",
)
def w7(spark, sf):
    return _r(C.cumulative_share(V.psms(spark, sf), ["engine"], "rank"), "share", "cumulative")
