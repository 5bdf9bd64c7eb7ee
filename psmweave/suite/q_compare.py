"""Queries for comparison with the ground truth (C, A5-A8, A15, A23-A25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave.functions import aligned as A
from psmweave.functions import edits as E
from psmweave.functions import peptide as P
from psmweave.operators import compare as C
from psmweave.operators import curves as U
from psmweave.operators import joins as J
from psmweave.operators import summary as S
from psmweave.operators import windows as W
from psmweave.suite import views as V
from psmweave.suite.q_summary import _OUTCOME_SQL, _REF_EVAL_SQL, _outcomes
from psmweave.suite.registry import query


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


# Residues of every peptide with position, mass and cumulative mass.
_WALK_SQL = """
pl AS (SELECT peptide AS p FROM joined WHERE rank = 1 UNION SELECT gt_peptide FROM joined WHERE rank = 1),
pm AS (SELECT p, i, m, sum(m) OVER (PARTITION BY p ORDER BY i) AS c FROM (SELECT p, unnest(string_split(p, '')) AS aa,
  unnest(range(1, length(p) + 1)) AS i FROM {peptides}) JOIN residue_mass USING (aa)),
pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM joined WHERE rank = 1)
"""
_NOVOR_SQL = (
    "WITH RECURSIVE "
    + _WALK_SQL.format(peptides="pl", a="gt_peptide", b="peptide")
    + """, walk AS (SELECT a, b, 1 AS i, 1 AS j, 0 AS hits FROM pairs UNION ALL
 SELECT a, b, CASE WHEN abs(x.c - y.c) < 0.5 OR x.c > y.c THEN w.i + 1 ELSE w.i END,
  CASE WHEN abs(x.c - y.c) < 0.5 OR NOT x.c > y.c THEN w.j + 1 ELSE w.j END,
  w.hits + CASE WHEN abs(x.c - y.c) < 0.5 AND abs(x.m - y.m) < 0.1 THEN 1 ELSE 0 END
 FROM walk w JOIN pm x ON x.p = w.a AND x.i = w.i JOIN pm y ON y.p = w.b AND y.i = w.j),
nv AS (SELECT a, b, max(hits) AS hits FROM walk GROUP BY 1, 2)
"""
)


def _prefix_sql(name: str, back: bool) -> str:
    """Recursive forward walk; on reversed peptides it is the backward mode."""
    turn = "reverse({})" if back else "{}"
    rev = "(SELECT reverse(p) AS p FROM pl)" if back else "pl"
    base = _WALK_SQL.format(peptides=rev, a=turn.format("gt_peptide"), b=turn.format("peptide"))
    for t in ("pm", "pairs"):
        base = base.replace(f"{t} AS", f"{t}_{name} AS")
    if back:
        base = base[base.index("pm_") :]
    return (
        base
        + f""", w_{name} AS (SELECT a, b, 1 AS i, 1 AS j, -1 AS at, false AS ok FROM pairs_{name} UNION ALL
 SELECT a, b, CASE WHEN g OR cy > cx THEN i + 1 ELSE i END, CASE WHEN g OR NOT cy > cx THEN j + 1 ELSE j END,
  CASE WHEN g THEN greatest(i, j) ELSE -1 END, g AND abs(mx - my) / my * 1e6 < 20 FROM (
  SELECT a, b, w.i, w.j, x.c AS cx, y.c AS cy, x.m AS mx, y.m AS my, abs(x.c - y.c) / y.c * 1e6 < 50 AS g
  FROM w_{name} w JOIN pm_{name} x ON x.p = w.a AND x.i = w.i JOIN pm_{name} y ON y.p = w.b AND y.i = w.j)),
f_{name} AS (SELECT a, b, array_to_string(list(CASE WHEN hit THEN '1' ELSE '0' END ORDER BY k), '') AS flags FROM (
  SELECT q.a, q.b, k, EXISTS (SELECT 1 FROM w_{name} w WHERE w.a = q.a AND w.b = q.b AND w.at = k AND w.ok) AS hit
  FROM pairs_{name} q, range(1, 40) r(k) WHERE k <= greatest(length(q.a), length(q.b))) GROUP BY 1, 2)
"""
    )


def _walk_cte(name: str, start: str, peptides: str) -> str:
    """Greedy ppm walk over the pairs of ``start`` (a, b, x, y), events in (ei, ej, ok)."""
    return f"""{name} AS (SELECT a, b, x, y, 1 AS i, 1 AS j, 0 AS ei, 0 AS ej, false AS ok FROM {start} UNION ALL
 SELECT a, b, x, y, CASE WHEN g OR cy > cx THEN i + 1 ELSE i END, CASE WHEN g OR NOT cy > cx THEN j + 1 ELSE j END,
  CASE WHEN g THEN i ELSE 0 END, CASE WHEN g THEN j ELSE 0 END, g AND abs(mx - my) / my * 1e6 < 20 FROM (
  SELECT a, b, w.x, w.y, w.i, w.j, q.c AS cx, r.c AS cy, q.m AS mx, r.m AS my, abs(q.c - r.c) / r.c * 1e6 < 50 AS g
  FROM {name} w JOIN {peptides} q ON q.p = w.x AND q.i = w.i JOIN {peptides} r ON r.p = w.y AND r.i = w.j))"""


def _flag_sql(place: str, length: str) -> str:
    return (
        f"(SELECT array_to_string(list(CASE WHEN coalesce((SELECT arg_max(ok, ph) FROM ev WHERE ev.a = z.a AND "
        f"ev.b = z.b AND {place} = k), false) THEN '1' ELSE '0' END ORDER BY k), '') "
        f"FROM range(1, 40) r(k) WHERE k <= {length})"
    )


# The default mode: forward, then backward down to the first difference.
_BEST_SQL = (
    "WITH RECURSIVE "
    + _WALK_SQL.format(peptides="pl", a="gt_peptide", b="peptide")
    + ", st AS (SELECT a, b, a AS x, b AS y FROM pairs), "
    + _walk_cte("w0", "st", "pm")
    + """, stop AS (SELECT a, b, min(k) AS s FROM pairs, range(1, 40) r(k) WHERE k <= greatest(length(a), length(b))
  AND NOT EXISTS (SELECT 1 FROM w0 WHERE w0.a = pairs.a AND w0.b = pairs.b AND w0.ok AND greatest(ei, ej) = k) GROUP BY 1, 2),
sx AS (SELECT a, b, reverse(substr(a, s)) AS x, reverse(substr(b, s)) AS y FROM stop),
sl AS (SELECT x AS p FROM sx UNION SELECT y FROM sx),
sm AS (SELECT p, i, m, sum(m) OVER (PARTITION BY p ORDER BY i) AS c FROM (SELECT p, unnest(string_split(p, '')) AS aa,
  unnest(range(1, length(p) + 1)) AS i FROM sl WHERE p <> '') JOIN residue_mass USING (aa)), """
    + _walk_cte("w1", "sx", "sm")
    + """, ev AS (SELECT a, b, 0 AS ph, ei, ej, ok FROM w0 WHERE ei > 0
 UNION ALL SELECT a, b, 1, length(a) - ei + 1, length(b) - ej + 1, ok FROM w1 WHERE ei > 0),
fl AS (SELECT a, b, """
    + _flag_sql("greatest(ei, ej)", "greatest(length(z.a), length(z.b))")
    + " AS aa_match, "
    + _flag_sql("ei", "length(z.a)")
    + " AS gt_match, "
    + _flag_sql("ej", "length(z.b)")
    + """ AS peptide_match FROM pairs z),
al AS (SELECT j.*, aa_match, gt_match, peptide_match, NOT contains(aa_match, '0') AS pep_match
 FROM joined j JOIN fl ON fl.a = j.gt_peptide AND fl.b = j.peptide WHERE j.rank = 1)
"""
)


def _flags(c):
    return F.array_join(F.transform(c, lambda x: F.when(x, "1").otherwise("0")), "")


def _aligned(spark, sf):
    return C.aligned(V.joined(spark, sf).filter("rank = 1"))


@query(
    "C1_aa_match",
    _BEST_SQL + "SELECT run, spectrum_id, engine, rank, peptide, gt_peptide, aa_match, gt_match, peptide_match, "
    "pep_match FROM al",
)
def c1(spark, sf):
    a = F.col("aligned")
    return _aligned(spark, sf).select(
        *J.PSM_KEY, "peptide", "gt_peptide",
        _flags(a["aa_match"]).alias("aa_match"),
        _flags(a["match_1"]).alias("gt_match"),
        _flags(a["match_2"]).alias("peptide_match"),
        a["pep_match"].alias("pep_match"),
    )


@query(
    "C1_aa_match_modes",
    "WITH RECURSIVE " + _prefix_sql("fw", False) + ", " + _prefix_sql("bw", True)
    + """SELECT j.run, j.spectrum_id, j.engine, j.rank, f.flags AS forward, reverse(g.flags) AS backward
FROM joined j JOIN f_fw f ON f.a = j.gt_peptide AND f.b = j.peptide
JOIN f_bw g ON g.a = reverse(j.gt_peptide) AND g.b = reverse(j.peptide) WHERE j.rank = 1""",
)
def c1b(spark, sf):
    rows = V.joined(spark, sf).filter("rank = 1").select(*J.PSM_KEY, "peptide", "gt_peptide")
    for mode in ("forward", "backward"):
        rows = C.aligned(rows, mode=mode, name=mode)
    return rows.select(
        *J.PSM_KEY, _flags(F.col("forward")["aa_match"]).alias("forward"),
        _flags(F.col("backward")["aa_match"]).alias("backward"),
    )


@query(
    "C2_isobaric_pairs",
    _BEST_SQL + """, last AS (SELECT p.a, p.b, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS ph FROM pairs p
 LEFT JOIN stop USING (a, b)),
lab AS (SELECT ev.a, ev.b, substr(ev.a, CAST(ei AS INT), 1) AS ca, substr(ev.b, CAST(ej AS INT), 1) AS cb FROM ev JOIN last USING (a, b, ph) WHERE ok),
part AS (SELECT * FROM (VALUES ('I', 'L'), ('L', 'I'), ('M', 'F'), ('F', 'M'), ('K', 'Q'), ('Q', 'E'), ('D', 'N'),
 ('N', 'D'), ('E', 'Q')) t(ca, other))
SELECT engine, concat(lab.ca, '/', CASE WHEN lab.ca = cb THEN other ELSE cb END) AS pair, lab.ca = cb AS resolved,
 count(*) AS n FROM al JOIN lab ON lab.a = gt_peptide AND lab.b = peptide JOIN part ON part.ca = lab.ca GROUP BY ALL""",
)
def c2(spark, sf):
    pairs = C.isobaric_pairs(_aligned(spark, sf), ["engine"])
    return S.count_by(pairs, "engine", "pair", "resolved")


_PARTNER_SQL = """part AS (SELECT * FROM (VALUES ('I', 'L'), ('L', 'I'), ('M', 'F'), ('F', 'M'), ('K', 'Q'), ('Q', 'E'),
 ('D', 'N'), ('N', 'D'), ('E', 'Q')) t(ca, other))"""


def _one_way_sql(back: bool) -> str:
    """Labels of a single walk; on reversed peptides it is the backward one."""
    turn = "reverse({})" if back else "{}"
    a, b = turn.format("gt_peptide"), turn.format("peptide")
    masses = "(SELECT reverse(p) AS p FROM pl)" if back else "pl"
    return (
        "WITH RECURSIVE "
        + _WALK_SQL.format(peptides=masses, a=a, b=b)
        + ", st AS (SELECT a, b, a AS x, b AS y FROM pairs), "
        + _walk_cte("w0", "st", "pm")
        + f""", lab AS (SELECT a, b, substr(a, CAST(ei AS INT), 1) AS ca, substr(b, CAST(ej AS INT), 1) AS cb
 FROM w0 WHERE ok), {_PARTNER_SQL}
SELECT engine, concat(lab.ca, '/', CASE WHEN lab.ca = cb THEN other ELSE cb END) AS pair, lab.ca = cb AS resolved,
 count(*) AS n FROM joined j JOIN lab ON lab.a = {turn.format('j.gt_peptide')} AND lab.b = {turn.format('j.peptide')}
 JOIN part ON part.ca = lab.ca WHERE j.rank = 1 GROUP BY ALL"""
    )


def _one_way(spark, sf, mode):
    rows = C.aligned(V.joined(spark, sf).filter("rank = 1"), mode=mode)
    return S.count_by(C.isobaric_pairs(rows, ["engine"]), "engine", "pair", "resolved")


@query("C2_isobaric_pairs_forward", _one_way_sql(False))
def c2_forward(spark, sf):
    return _one_way(spark, sf, "forward")


@query("C2_isobaric_pairs_backward", _one_way_sql(True))
def c2_backward(spark, sf):
    return _one_way(spark, sf, "backward")


def _backed_sql(flags: str, peptide: str) -> str:
    return (
        f"NOT EXISTS (SELECT 1 FROM range(1, 40) r(k) WHERE k < length({peptide}) AND (spectrum_id + k) % 3 > 0 "
        f"AND substr({flags}, k, 1) = '0')"
    )


def _gap_count_sql(peptide: str) -> str:
    return f"(SELECT count(*) FROM range(1, 40) r(k) WHERE k < length({peptide}) AND (spectrum_id + k) % 3 = 0)"


@query(
    "C3_error_type",
    _BEST_SQL + f""", ms AS (SELECT p, max(c) AS mass FROM pm GROUP BY 1)
SELECT run, spectrum_id, engine, rank, peptide, gt_peptide, CASE WHEN peptide = gt_peptide THEN 'match'
 WHEN pep_match THEN 'isobaric_aa'
 WHEN abs(x.mass - y.mass) < 0.5 AND {_backed_sql("gt_match", "gt_peptide")} AND {_backed_sql("peptide_match", "peptide")}
  AND {_gap_count_sql("peptide")} = {_gap_count_sql("gt_peptide")} THEN 'isobaric_peak'
 WHEN round(score - gt_score, 3) < 0 THEN 'Lower score' ELSE 'Higher score' END AS error_type,
 round(score - gt_score, 3) AS score_diff
FROM al JOIN ms x ON x.p = al.peptide JOIN ms y ON y.p = al.gt_peptide""",
)
def c3(spark, sf):
    """Evidence flags come from the spectrum number, equal for both peptides of a spectrum."""
    flags = "transform(sequence(1, {n} - 1), i -> (spectrum_id + i) % 3 > 0)"
    rows = V.joined(spark, sf).filter("rank = 1").withColumns(
        {
            "evidence": F.expr(flags.format(n="length(peptide)")),
            "gt_evidence": F.expr(flags.format(n="length(gt_peptide)")),
        }
    )
    return _r(C.error_type(C.aligned(rows), "evidence", "gt_evidence"), "score_diff").select(
        *J.PSM_KEY, "peptide", "gt_peptide", "error_type", "score_diff"
    )


_HYPER = "round(score * 7, 0)"


def _hyper_truth(spark, sf):
    return V.gt_ok(spark, sf).selectExpr(
        "run", "spectrum_id", "translate(gt_peptide, 'I', 'L') AS gt_sequence",
        "round(gt_score * 7, 0) AS gt_hyperscore",
    )


@query(
    "C4_match_type_by_hyperscore",
    f"""
WITH h AS (SELECT *, {_HYPER} AS hyperscore, replace(peptide, 'I', 'L') AS sequence FROM psms),
t AS (SELECT run, spectrum_id, replace(gt_peptide, 'I', 'L') AS s, round(gt_score * 7, 0) AS g FROM gt_ok)
SELECT run, spectrum_id, engine, rank, CASE WHEN s IS NULL THEN 'Unpredicted' WHEN s = sequence THEN 'Match'
 WHEN hyperscore = g THEN 'Isobaric' WHEN hyperscore > g THEN 'Better' ELSE 'Worse' END AS match_type,
 hyperscore - g AS hyperscore_diff FROM h LEFT JOIN t USING (run, spectrum_id)
""",
)
def c4(spark, sf):
    rows = V.psms(spark, sf).withColumns(
        {"hyperscore": F.expr(_HYPER), "sequence": F.translate("peptide", "I", "L")}
    )
    return C.match_type_by_hyperscore(rows, _hyper_truth(spark, sf)).select(
        *J.PSM_KEY, "match_type", "hyperscore_diff"
    )


@query(
    "C5_merge_results",
    f"""
WITH t AS (SELECT run, spectrum_id, gt_peptide AS peptide, 'search' AS source, gt_score AS score,
  round(gt_score * 7, 0) AS hyperscore FROM gt WHERE NOT is_decoy AND qvalue < 0.01),
e AS (SELECT run, spectrum_id, peptide, engine AS source, CASE WHEN engine IN ('engine_0', 'engine_1')
  AND score - 0.5 < 0 THEN score + 0.5 ELSE score - 0.5 END AS score, {_HYPER} AS hyperscore FROM psms
  WHERE (run, spectrum_id) IN (SELECT (run, spectrum_id) FROM t)),
u AS (SELECT * FROM t UNION ALL SELECT * FROM e)
SELECT u.spectrum_id, replace(u.peptide, 'I', 'L') AS proforma, replace(u.peptide, 'I', 'L') AS sequence,
 CASE WHEN replace(u.peptide, 'I', 'L') = replace(t.peptide, 'I', 'L') THEN 'Match'
  WHEN u.hyperscore = t.hyperscore THEN 'Isobaric' WHEN u.hyperscore > t.hyperscore THEN 'Better' ELSE 'Worse' END
  AS match_type, u.run, u.source, round(u.score, 6) AS score, u.hyperscore,
 u.hyperscore - t.hyperscore AS hyperscore_diff
FROM u JOIN t USING (run, spectrum_id)
""",
)
def c5(spark, sf):
    from psmweave.plans.merge import merge_results

    truth = V.gt(spark, sf).selectExpr(
        "run", "spectrum_id", "gt_peptide AS peptide", "'search' AS source", "gt_score AS score",
        "round(gt_score * 7, 0) AS hyperscore", "qvalue", "is_decoy",
    )
    psms = V.psms(spark, sf).selectExpr(
        "run", "spectrum_id", "peptide", "engine AS source", "score - 0.5 AS score",
        f"{_HYPER} AS hyperscore",
    )
    engines = [psms.filter("source IN ('engine_0', 'engine_1')"), psms.filter("source NOT IN ('engine_0', 'engine_1')")]
    out = merge_results(truth, engines, penalised=["engine_0", "engine_1"])
    return _r(
        out.select(
            "spectrum_id", "proforma", "sequence", "match_type", "run", "source", "score",
            "hyperscore", "hyperscore_diff",
        ),
        "score",
    )


_MASS_LIST = ", ".join(f"'{c}': {m!r}::DOUBLE" for c, m in E.LETTER_MASS.items())
_TAG = "coalesce(list_sum(list_transform(string_split({0}, ''), lambda c: coalesce(map {{" + _MASS_LIST + "}}[c], 0.0::DOUBLE))), 0.0::DOUBLE)"


def _tag(text: str) -> str:
    """Mass of a tag; its empty spelling has the one letter '' without a mass."""
    return _TAG.format(text)


def _common_sql(a: str, b: str, side: str = "left") -> str:
    return f"list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda k: {side}({a}, k::INT) = {side}({b}, k::INT)))"


#: Edit scripts by a recursive matrix and a recursive way back, sites by gaps and islands, in both directions.
_SITES_SQL = f"""WITH RECURSIVE lp AS (
  SELECT run, spectrum_id, engine, rank, peptide, gt_peptide, replace(gt_peptide, 'L', 'I') AS s, replace(peptide, 'L', 'I') AS t
  FROM joined WHERE rank = 1 AND replace(gt_peptide, 'L', 'I') <> replace(peptide, 'L', 'I')),
pr AS (SELECT DISTINCT s, t FROM lp),
hd AS (SELECT s, t, {_common_sql("s", "t")} AS h FROM pr),
co AS (SELECT s, t, h, substr(s, h + 1, length(s) - h - e) AS x, substr(t, h + 1, length(t) - h - e) AS y FROM (
  SELECT s, t, h, {_common_sql("substr(s, h + 1)", "substr(t, h + 1)", "right")} AS e FROM hd)),
mx AS (SELECT s, t, 0::BIGINT AS i, range(0, length(y) + 1) AS d FROM co UNION ALL
  SELECT mx.s, mx.t, i + 1, list_transform(range(0, length(y) + 1), lambda j: list_min(list_transform(range(0, j + 1),
    lambda k: j - k + CASE k WHEN 0 THEN i + 1 ELSE least(d[k + 1] + 1,
      d[k] + (substr(x, (i + 1)::INT, 1) <> substr(y, k::INT, 1))::BIGINT) END)))
  FROM mx JOIN co ON mx.s = co.s AND mx.t = co.t WHERE i < length(x)),
mt AS (SELECT s, t, list(d ORDER BY i) AS m FROM mx GROUP BY s, t),
tr AS (SELECT s, t, length(x) AS i, length(y) AS j, 0 AS k, 'keep' AS action FROM co UNION ALL
  SELECT s, t, i - (act <> 'insert')::BIGINT, j - (act <> 'delete')::BIGINT, k + 1, act FROM (
    SELECT tr.s, tr.t, i, j, k, CASE WHEN i > 0 AND (j = 0 OR m[i + 1][j + 1] = m[i][j + 1] + 1) THEN 'delete'
      WHEN j > 0 AND (i = 0 OR (j > 1 AND m[i + 1][j] < m[i][j])) THEN 'insert'
      WHEN substr(x, i::INT, 1) <> substr(y, j::INT, 1) THEN 'replace' ELSE 'keep' END AS act
    FROM tr JOIN co ON tr.s = co.s AND tr.t = co.t JOIN mt ON tr.s = mt.s AND tr.t = mt.t WHERE i + j > 0)),
op AS (SELECT s, t, -k AS k, action, i + h AS i, j + h AS j FROM tr JOIN co USING (s, t) WHERE action <> 'keep'),
bo AS (SELECT 'f' AS side, s, t, s AS a, t AS b, k, action, i, j FROM op UNION ALL
  SELECT 'b', s, t, t, s, k, CASE action WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE action END, j, i FROM op),
nb AS (SELECT *, lag(j + (action <> 'delete')::BIGINT) OVER w AS pj, lag(action) OVER w AS pa FROM bo
  WINDOW w AS (PARTITION BY side, s, t ORDER BY k)),
mv AS (SELECT *, coalesce(j - pj = 1 AND action <> pa AND 'replace' NOT IN (action, pa), FALSE) AS moves FROM nb),
il AS (SELECT *, sum((NOT coalesce(moves OR j = pj, FALSE))::BIGINT) OVER (PARTITION BY side, s, t ORDER BY k) - 1 AS site_no FROM mv),
si AS (SELECT side, s, t, a, b, site_no, min(i) AS a0, max(i + (action <> 'insert')::BIGINT) AS a1, min(j) AS b0,
  max(j + (action <> 'delete')::BIGINT) AS b1, list(j - (moves AND action = 'delete')::BIGINT ORDER BY k) AS idx FROM il GROUP BY ALL),
st AS (SELECT *, substr(a, (a0 + 1)::INT, (a1 - a0)::INT) AS source, substr(b, (b0 + 1)::INT, (b1 - b0)::INT) AS target FROM si),
sd AS (SELECT *, {_tag("target")} - {_tag("source")} AS diff FROM st)
"""

#: Runs of sites by a recursion over the sites, whose state is the open run, its mass and the precursor's difference.
_MERGED_SQL = _SITES_SQL + f""", pc AS (SELECT s, t, {_tag("t")} - {_tag("s")} AS p FROM pr),
mr AS (SELECT s, t, -1::BIGINT AS k, NULL::BIGINT AS run_at, 0.0::DOUBLE AS level,
    CASE WHEN round(round(p, 2), 2) <> 0 THEN round(p, 2) END AS shift, NULL::BIGINT AS from_no FROM pc UNION ALL
  SELECT s, t, k + 1,
    CASE WHEN run_at IS NULL THEN CASE WHEN alone OR round(d, 2) = 0 THEN NULL ELSE k + 1 END
      WHEN alone THEN run_at WHEN done THEN NULL ELSE run_at END,
    CASE WHEN run_at IS NULL THEN CASE WHEN alone OR round(d, 2) = 0 THEN 0.0 ELSE d END
      WHEN alone THEN level WHEN done THEN 0.0 ELSE level + d END,
    CASE WHEN alone OR (run_at IS NOT NULL AND by_shift) THEN NULL ELSE shift END,
    CASE WHEN run_at IS NOT NULL AND NOT alone AND done THEN run_at END
  FROM (SELECT *, by_shift OR (round(level + d, 2) = 0 AND round(d, 2) <> 0) AS done FROM (
    SELECT mr.*, sd.diff AS d, shift IS NOT NULL AND round(sd.diff - shift, 2) = 0 AS alone,
      shift IS NOT NULL AND round(sd.diff + level - shift, 2) = 0 AS by_shift
    FROM mr JOIN sd ON sd.side = 'f' AND sd.s = mr.s AND sd.t = mr.t AND sd.site_no = mr.k + 1))),
rn AS (SELECT s, t, from_no, k AS to_no FROM mr WHERE from_no IS NOT NULL),
sg AS (SELECT sd.*, coalesce(rn.from_no, sd.site_no) AS first_no, rn.from_no IS NOT NULL AS in_run FROM sd
  LEFT JOIN rn ON rn.s = sd.s AND rn.t = sd.t AND sd.site_no BETWEEN rn.from_no AND rn.to_no WHERE side = 'f'),
jo AS (SELECT s, t, first_no, in_run, substr(any_value(a), (min(a0) + 1)::INT, (max(a1) - min(a0))::INT) AS so,
    substr(any_value(b), (min(b0) + 1)::INT, (max(b1) - min(b0))::INT) AS ta,
    CASE WHEN in_run THEN range(list_min(flatten(list(idx))), list_max(flatten(list(idx))) + 1) ELSE any_value(idx) END AS idx
  FROM sg GROUP BY s, t, first_no, in_run),
j1 AS (SELECT *, CASE WHEN in_run THEN {_common_sql("so", "ta")} ELSE 0 END AS hd FROM jo),
j2 AS (SELECT *, CASE WHEN in_run THEN {_common_sql("substr(so, hd + 1)", "substr(ta, hd + 1)", "right")} ELSE 0 END AS tl FROM j1),
j3 AS (SELECT s, t, row_number() OVER (PARTITION BY s, t ORDER BY first_no) - 1 AS site_no,
    substr(so, (hd + 1)::INT, (length(so) - hd - tl)::INT) AS source, substr(ta, (hd + 1)::INT, (length(ta) - hd - tl)::INT) AS target,
    idx[(hd + 1):(len(idx) - tl)] AS idx FROM j2)
"""

_SITE_COLUMNS = "run, spectrum_id, engine, rank, site_no::BIGINT AS site_no, source, target, array_to_string(idx, ',') AS indices"

_CATEGORY_SQL = _SITES_SQL + """, one AS (SELECT s, t FROM sd WHERE side = 'f' GROUP BY s, t HAVING count(*) = 1),
ec AS (SELECT engine, CASE WHEN list_sort(string_split(source, '')) = list_sort(string_split(target, '')) THEN 'reordering'
  WHEN round(abs(diff), 4) < 0.001 THEN 'isobaric_alternative' ELSE 'other' END AS category
  FROM lp JOIN one USING (s, t) JOIN sd USING (s, t) WHERE side = 'f')
"""

#: Residue r is unsure if a site without evidence lies at it or beside it.
_SUPPORT = """CASE WHEN bool_and(NOT unsure) THEN 'complete' WHEN bool_and(unsure) THEN 'absent' ELSE 'partly' END"""

_EVIDENCE_SQL = _SITES_SQL + f""", un AS (
  SELECT run, spectrum_id, engine, rank, side, lp.s, lp.t, site_no, source, target, idx, r, length(b) AS n,
    coalesce(list_bool_or(list_transform([r - 1, r, r + 1], lambda i: i BETWEEN 1 AND length(b) - 1 AND (spectrum_id + i) % 3 = 0)), FALSE) AS unsure
  FROM lp JOIN st USING (s, t), unnest(idx) u(r)),
ld AS (SELECT side, s, t, j, arg_max(action, k) AS action FROM bo GROUP BY ALL),
an AS (SELECT run, spectrum_id, engine, rank, un.side, site_no, any_value(source) AS source, any_value(target) AS target,
  {_SUPPORT} AS annotation, any_value(idx[1]) AS n_term,
  any_value(n - idx[-1] - 1 + coalesce((ld.action = 'delete')::BIGINT, 0)) AS c_term
  FROM un LEFT JOIN ld ON ld.side = un.side AND ld.s = un.s AND ld.t = un.t AND ld.j = un.idx[-1]
  GROUP BY run, spectrum_id, engine, rank, un.side, site_no),
se AS (SELECT run, spectrum_id, engine, rank, site_no, f.source, f.target, f.annotation, b.annotation AS source_annotation,
  f.n_term, f.c_term, f.annotation <> 'partly' AND f.annotation = b.annotation AS ambiguous
  FROM (FROM an WHERE side = 'f') f FULL JOIN (FROM an WHERE side = 'b') b USING (run, spectrum_id, engine, rank, site_no))
"""


def _letter_pairs(spark, sf):
    return V.joined(spark, sf).filter("rank = 1").withColumns(
        {"source": P.to_letter_string("gt_peptide"), "target": P.to_letter_string("peptide")}
    )


@query(
    "C6_edit_distances",
    """
WITH p AS (SELECT run, spectrum_id, engine, rank, replace(gt_peptide, 'L', 'I') AS s, replace(peptide, 'L', 'I') AS t
  FROM joined WHERE rank = 1)
SELECT run, spectrum_id, engine, rank, levenshtein(s, t) AS levenshtein, damerau_levenshtein(s, t) AS damerau,
 round(levenshtein(s, t) / greatest(length(s), length(t)), 6) AS l_norm,
 round(damerau_levenshtein(s, t) / greatest(length(s), length(t)), 6) AS dl_norm,
 levenshtein(s, t) - damerau_levenshtein(s, t) AS transpositions FROM p
""",
)
def c6(spark, sf):
    out = C.edit_distances(_letter_pairs(spark, sf))
    ints = ["levenshtein", "damerau", "transpositions"]
    return out.select(
        *J.PSM_KEY, *[F.col(c).cast("long").alias(c) for c in ints],
        F.round("l_norm", 6).alias("l_norm"), F.round("dl_norm", 6).alias("dl_norm"),
    )


def _compared(spark, sf):
    return C.sequence_comparison(_letter_pairs(spark, sf).filter("source <> target"))


@query(
    "C7_edit_sites",
    _SITES_SQL + f"SELECT {_SITE_COLUMNS}, round(diff, 4) AS mass_difference FROM lp JOIN sd USING (s, t) WHERE side = 'f'",
)
def c7(spark, sf):
    out = C.site_rows(_compared(spark, sf), J.PSM_KEY)
    return out.select(
        *J.PSM_KEY, "site_no", "source", "target", F.array_join("indices", ",").alias("indices"),
        F.round("mass_difference", 4).alias("mass_difference"),
    )


def _site_evidence(spark, sf, merged=False):
    flags = "transform(sequence(1, length({p}) - 1), i -> (spectrum_id + i) % 3 > 0)"
    rows = _compared(spark, sf).withColumns(
        {
            "source_evidence": F.expr(flags.format(p="gt_peptide")),
            "target_evidence": F.expr(flags.format(p="peptide")),
        }
    )
    return C.site_evidence(
        rows, J.PSM_KEY, merged, source_peptide="gt_peptide", target_peptide="peptide"
    )


@query("C8_site_evidence", _EVIDENCE_SQL + "SELECT * FROM se")
def c8(spark, sf):
    return _site_evidence(spark, sf).drop("mass_difference")


@query(
    "C9_merge_mass_neutral_sites",
    _MERGED_SQL + f"SELECT {_SITE_COLUMNS}, round({_tag('target')} - {_tag('source')}, 4) AS mass_difference "
    "FROM lp JOIN j3 USING (s, t)",
)
def c9(spark, sf):
    out = C.site_rows(_compared(spark, sf), J.PSM_KEY, "forward_merged")
    return out.select(
        *J.PSM_KEY, "site_no", "source", "target", F.array_join("indices", ",").alias("indices"),
        F.round("mass_difference", 4).alias("mass_difference"),
    )


@query(
    "C10_novor_match",
    _NOVOR_SQL + "SELECT run, spectrum_id, engine, rank, peptide, gt_peptide, hits AS n_match FROM joined "
    "JOIN nv ON nv.a = gt_peptide AND nv.b = peptide WHERE rank = 1",
)
def c10(spark, sf):
    rows = V.joined(spark, sf).filter("rank = 1").repartition("run", "spectrum_id")
    return rows.select(
        *J.PSM_KEY, "peptide", "gt_peptide",
        A.novor_match(F.col("gt_peptide"), F.col("peptide")).alias("n_match"),
    )


@query(
    "C11_refinement_outcome",
    "WITH " + _REF_EVAL_SQL + _OUTCOME_SQL
    + "SELECT engine, refiner, outcome, count(*) AS n FROM oc GROUP BY ALL",
)
def c11(spark, sf):
    return S.count_by(_outcomes(spark, sf), "engine", "refiner", "outcome")


@query("C12_error_category", _CATEGORY_SQL + "SELECT engine, category, count(*) AS n FROM ec GROUP BY ALL")
def c12(spark, sf):
    sites = C.site_rows(_compared(spark, sf), J.PSM_KEY)
    return S.count_by(C.error_category(sites, J.PSM_KEY), "engine", "category")


@query(
    "A5_aa_pep_precision_recall",
    _BEST_SQL + """, h AS (SELECT *, length(replace(aa_match, '0', '')) AS hits FROM al)
SELECT engine, round(sum(hits) / (sum(length(peptide)) + 1e-8), 6) AS aa_precision,
 round(sum(hits) / (sum(length(gt_peptide)) + 1e-8), 6) AS aa_recall,
 round(count(*) FILTER (WHERE pep_match) / (count(*) + 1e-8), 6) AS pep_precision FROM h GROUP BY 1""",
)
def a5(spark, sf):
    out = C.aa_pep_precision_recall(_aligned(spark, sf), ["engine"])
    return _r(out, "aa_precision", "aa_recall", "pep_precision")


def _aa_rows(spark, sf):
    """Residue scores: the PSM score damped by position, one value per residue."""
    rows = _aligned(spark, sf).withColumns(
        {
            "aa_match": F.col("aligned")["match_2"],
            "aa_scores": F.expr("transform(sequence(1, length(peptide)), i -> round(score * (1 - i / 100), 6))"),
        }
    )
    return U.aa_score_rows(rows, J.PSM_KEY)


def _aa_totals(spark, sf):
    return V.joined(spark, sf).filter("rank = 1").groupBy("engine").agg(
        F.sum(F.size(P.tokens("gt_peptide"))).alias("n_total")
    )


_AA_SQL = _BEST_SQL + """, aa AS (SELECT engine, round(score * (1 - k / 100), 6) AS score,
  substr(peptide_match, CAST(k AS INT), 1) = '1' AS correct FROM al, range(1, 40) r(k) WHERE k <= length(peptide)),
tt AS (SELECT engine, sum(length(gt_peptide)) AS n_total FROM al GROUP BY 1)
"""


@query(
    "A6_aa_precision_recall_at",
    _AA_SQL + """SELECT engine, round(count(*) FILTER (WHERE score > 0.6 AND correct) / count(*) FILTER (WHERE score > 0.6), 6)
 AS aa_precision, round(count(*) FILTER (WHERE score > 0.6 AND correct) / any_value(n_total), 6) AS aa_recall
FROM aa JOIN tt USING (engine) GROUP BY 1""",
)
def a6(spark, sf):
    out = C.aa_precision_recall_at(_aa_rows(spark, sf), _aa_totals(spark, sf), 0.6)
    return _r(out, "aa_precision", "aa_recall")


@query(
    "A7_peptide_pr_at_threshold",
    _NOVOR_SQL + """, u AS (SELECT engine, length(gt_peptide) AS t, length(peptide) AS p, hits, score >= 0.6 AS used
 FROM joined JOIN nv ON nv.a = gt_peptide AND nv.b = peptide WHERE rank = 1)
SELECT engine, round(sum(hits) FILTER (WHERE used) / sum(p) FILTER (WHERE used), 6) AS aa_precision,
 round(sum(hits) FILTER (WHERE used) / sum(t), 6) AS aa_recall,
 round(count(*) FILTER (WHERE used AND t = p AND hits = t) / count(*), 6) AS pep_recall,
 round(count(*) FILTER (WHERE used AND t = p AND hits = t) / count(*) FILTER (WHERE used), 6) AS pep_precision
FROM u GROUP BY 1""",
)
def a7(spark, sf):
    out = C.peptide_pr_at_threshold(V.joined(spark, sf).filter("rank = 1"), 0.6)
    return _r(out, "aa_precision", "aa_recall", "pep_recall", "pep_precision")


@query(
    "A8_aa_error_rate",
    "SELECT engine, round(sum(levenshtein(replace(gt_peptide, 'L', 'I'), replace(peptide, 'L', 'I'))) / "
    "sum(length(gt_peptide)), 6) AS aa_error_rate FROM joined WHERE rank = 1 GROUP BY 1",
)
def a8(spark, sf):
    return _r(C.aa_error_rate(V.joined(spark, sf).filter("rank = 1")), "aa_error_rate")


@query(
    "A15_aa_curve",
    _AA_SQL + """, lv AS (SELECT engine, score, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM aa GROUP BY 1, 2),
sn AS (SELECT engine, max(score) AS hi, min(score) AS lo FROM lv GROUP BY 1),
th AS (SELECT engine, k, CASE WHEN k = 999 THEN lo ELSE hi + k * ((lo - hi) / 999) END AS threshold FROM sn, range(1000) r(k)),
x AS (SELECT th.engine, k, threshold, coalesce(sum(n), 0) AS ci, coalesce(sum(c), 0) AS cc FROM th LEFT JOIN lv
  ON lv.engine = th.engine AND lv.score > th.threshold GROUP BY 1, 2, 3)
SELECT engine, k, round(threshold, 6) AS threshold, round(CASE WHEN ci > 0 THEN cc / ci END, 6) AS precision,
 round(cc / n_total, 6) AS recall, round(ci / n_total, 6) AS coverage FROM x JOIN tt USING (engine)""",
)
def a15(spark, sf):
    totals = _aa_totals(spark, sf).withColumnRenamed("n_total", "n_predicted")
    out = U.prc_linspace(_aa_rows(spark, sf), totals)
    return _r(out, "threshold", "precision", "recall", "coverage")


@query(
    "A23_substitution_counts",
    _SITES_SQL + """, su AS (SELECT engine, concat(source, ' -> ', target) AS substitution, count(*) AS n
  FROM lp JOIN sd USING (s, t) WHERE side = 'f' GROUP BY ALL)
SELECT engine, substitution, n, round(n / sum(n) OVER (PARTITION BY engine), 6) AS share FROM su""",
)
def a23(spark, sf):
    return _r(S.substitution_counts(C.site_rows(_compared(spark, sf), J.PSM_KEY)), "share")


@query(
    "A23_top_substitutions",
    _SITES_SQL + """, su AS (SELECT concat(source, ' -> ', target) AS substitution, count(*) AS n
  FROM lp JOIN sd USING (s, t) WHERE side = 'f' GROUP BY ALL)
SELECT substitution, n, round(n / sum(n) OVER (), 6) AS share FROM su ORDER BY n DESC, substitution LIMIT 10""",
)
def a23b(spark, sf):
    counts = S.substitution_counts(C.site_rows(_compared(spark, sf), J.PSM_KEY), [])
    return _r(counts, "share").orderBy(F.desc("n"), "substitution").limit(10)


@query(
    "A24_site_number_counts",
    _SITES_SQL + """, nu AS (SELECT s, t, count(*) AS n_sites FROM sd WHERE side = 'f' GROUP BY ALL),
co2 AS (SELECT engine, n_sites, count(*) AS n FROM lp JOIN nu USING (s, t) GROUP BY ALL)
SELECT engine, n_sites, n, round(n / sum(n) OVER (PARTITION BY engine), 6) AS share FROM co2""",
)
def a24(spark, sf):
    rows = _compared(spark, sf).withColumn("n_sites", F.size(F.col("comparison")["forward"]))
    return _r(W.share_in_group(S.count_by(rows, "engine", "n_sites"), ["engine"]), "share")


@query(
    "A25_terminus_counts",
    _EVIDENCE_SQL + """SELECT engine, CASE WHEN n_term < c_term THEN 'N' ELSE 'C' END AS terminus,
  least(n_term, c_term) AS distance, count(*) AS n, round(avg(ambiguous::DOUBLE), 6) AS share_ambiguous FROM se GROUP BY ALL""",
)
def a25(spark, sf):
    near = S.nearest_terminus(_site_evidence(spark, sf))
    counts = near.groupBy("engine", "terminus", "distance").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ambiguous").cast("double")).alias("share_ambiguous")
    )
    return _r(counts, "share_ambiguous")


