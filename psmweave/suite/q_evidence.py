"""Queries for containment, tolerance joins, fragment evidence and features (J16-J21, F, C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.operators import containment as N
from psmweave.operators import fragments as G
from psmweave.suite import views as V
from psmweave.suite.registry import query

_S = ["spectrum_id"]


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "J16_contained_in_proteome",
    """
SELECT item_id, EXISTS (SELECT 1 FROM proteins p
  WHERE contains(replace(p.sequence, 'L', 'I'), replace(x.peptide, 'L', 'I'))) AS in_fasta
FROM (SELECT item_id, peptide FROM peptides
 UNION ALL SELECT item_id + 1000000, reverse(peptide) FROM peptides
 UNION ALL SELECT item_id + 2000000, concat(peptide, 'XQ') FROM peptides) x
""",
)
def j16(spark, sf):
    p = V.peptides(spark, sf)
    rows = p.unionByName(
        p.selectExpr("item_id + 1000000 AS item_id", "reverse(peptide) AS peptide")
    ).unionByName(p.selectExpr("item_id + 2000000 AS item_id", "concat(peptide, 'XQ') AS peptide"))
    return N.contained_in_proteome(rows, V.proteins(spark, sf)).select("item_id", "in_fasta")


@query(
    "J16_kmer_contains_join",
    """
SELECT x.peptide, p.protein_id FROM (SELECT DISTINCT peptide FROM peptides) x
JOIN proteins p ON contains(replace(p.sequence, 'L', 'I'), replace(x.peptide, 'L', 'I'))
""",
)
def j16b(spark, sf):
    return N.kmer_contains_join(V.peptides(spark, sf), V.proteins(spark, sf))


_J17 = (
    "CASE item_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'Higher score' WHEN 2 THEN 'Lower score' "
    "ELSE 'isobaric_aa' END AS error_type"
)


@query(
    "J17_reannotate_errors",
    f"""
WITH e AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN reverse(peptide) ELSE peptide END AS peptide,
  {_J17} FROM peptides)
SELECT item_id, CASE WHEN error_type NOT IN ('Higher score', 'Lower score') THEN error_type
 WHEN EXISTS (SELECT 1 FROM proteins p WHERE contains(replace(p.sequence, 'L', 'I'),
   replace(e.peptide, 'L', 'I'))) THEN 'No match - In FASTA' ELSE 'No match - Not in FASTA' END AS error_type,
 CASE WHEN error_type IN ('Higher score', 'Lower score') THEN error_type END AS prev_error_type FROM e
""",
)
def j17(spark, sf):
    rows = V.peptides(spark, sf).selectExpr(
        "item_id", "CASE WHEN item_id % 3 = 0 THEN reverse(peptide) ELSE peptide END AS peptide", _J17
    )
    out = N.reannotate_errors(
        rows, V.proteins(spark, sf), ["match", "Higher score", "Lower score"]
    )
    return out.select("item_id", "error_type", "prev_error_type")


@query(
    "J19_fragment_match",
    "SELECT spectrum_id, neutral_loss, ion_type, ion_index, peak_no, round(theo_mz, 4) AS theo_mz, "
    "round(delta, 4) AS delta FROM matched",
)
def j19(spark, sf):
    return _r(
        V.matched(spark, sf).select(
            "spectrum_id", "neutral_loss", "ion_type",
            F.col("ion_index").cast("long").alias("ion_index"), "peak_no", "theo_mz", "delta",
        ),
        "theo_mz", "delta", places=4,
    )


@query(
    "J19_fragment_match_ppm",
    """
SELECT f.spectrum_id, count(*) AS n, round(sum(p.intensity), 3) AS intensity
FROM frag f JOIN peaks p ON p.spectrum_id = f.spectrum_id AND abs(p.mz - f.theo_mz) / f.theo_mz * 1e6 < 900
GROUP BY 1
""",
)
def j19b(spark, sf):
    out = G.fragment_match(V.fragments(spark, sf), V.peaks(spark, sf), _S, 900, "ppm")
    return out.groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 3).alias("intensity")
    )


_PLAIN = "neutral_loss = '' AND ion_type IN ('b1', 'b2', 'y1', 'y2')"

_ISO_SQL = """
mono AS (SELECT spectrum_id, ion_type, ion_index, max({'i': intensity, 'mz': exp_mz, 'z': charge}) AS m
  FROM matched WHERE neutral_loss = '' GROUP BY 1, 2, 3),
want AS (SELECT spectrum_id, ion_type, ion_index, k, m.mz + k * 10.0::DOUBLE / m.z AS w FROM mono, range(1, 5) r(k)),
hit AS (SELECT w.spectrum_id, ion_type, ion_index, k, max({'i': p.intensity, 'mz': p.mz}) AS p FROM want w
  JOIN peaks p ON p.spectrum_id = w.spectrum_id AND abs(p.mz - w.w) < 0.1 GROUP BY 1, 2, 3, 4),
chain AS (SELECT spectrum_id, ion_type, ion_index, 0 AS isotope_no, m.i AS intensity FROM mono
 UNION ALL SELECT spectrum_id, ion_type, ion_index, k, p.i FROM (SELECT *, row_number() OVER (
   PARTITION BY spectrum_id, ion_type, ion_index ORDER BY k) AS rn FROM hit) WHERE rn = k)
"""


def _isotopes(spark, sf):
    m = V.matched(spark, sf).filter("neutral_loss = ''")
    return G.isotope_peaks(
        m, V.peaks(spark, sf), _S, ["spectrum_id", "ion_type", "ion_index"], spacing=10.0, tolerance=0.1
    )


@query(
    "J20_isotope_peaks",
    "WITH " + _ISO_SQL + "SELECT spectrum_id, ion_type, ion_index, CAST(isotope_no AS BIGINT) AS isotope_no, "
    "round(intensity, 4) AS intensity FROM chain",
)
def j20(spark, sf):
    return _isotopes(spark, sf).select(
        "spectrum_id",
        "ion_type",
        F.col("ion_index").cast("long").alias("ion_index"),
        F.col("isotope_no").cast("long").alias("isotope_no"),
        F.round("intensity", 4).alias("intensity"),
    )


@query(
    "F1_fragment_table",
    "SELECT spectrum_id, neutral_loss, ion_type, ion_index, round(exp_mz, 4) AS exp_mz, "
    "round(intensity, 3) AS intensity FROM matched WHERE neutral_loss IN ('', '-H2O') AND ion_type IN ('b1', 'y1')",
)
def f1(spark, sf):
    out = G.fragment_table(V.matched(spark, sf), ["b1", "y1"], ["", "-H2O"])
    return out.select(
        "spectrum_id", "neutral_loss", "ion_type", F.col("ion_index").cast("long").alias("ion_index"),
        F.round("exp_mz", 4).alias("exp_mz"), F.round("intensity", 3).alias("intensity"),
    )


def _lengths(spark, sf):
    return V.spectrum_psms(spark, sf).select("spectrum_id", F.length("peptide").alias("n_residues"))


@query(
    "F2_ion_vectors",
    """
WITH b AS (SELECT spectrum_id, neutral_loss, ion_type, site, max(intensity) AS v FROM matched GROUP BY ALL),
g AS (SELECT DISTINCT spectrum_id, neutral_loss, ion_type FROM b)
SELECT g.spectrum_id, g.neutral_loss, g.ion_type, array_to_string(list(CAST(CAST(round(coalesce(v, 0)) AS BIGINT)
 AS VARCHAR) ORDER BY s), ',') AS vector
FROM g CROSS JOIN range(1, 8) r(s) LEFT JOIN b ON b.spectrum_id = g.spectrum_id AND
 b.neutral_loss = g.neutral_loss AND b.ion_type = g.ion_type AND b.site = r.s GROUP BY 1, 2, 3
""",
)
def f2(spark, sf):
    out = G.ion_vectors(V.matched(spark, sf), _lengths(spark, sf), _S)
    text = F.transform("vector", lambda v: F.round(v).cast("long").cast("string"))
    return out.select("spectrum_id", "neutral_loss", "ion_type", F.array_join(text, ",").alias("vector"))


@query(
    "F3_choose_annotation",
    """
SELECT spectrum_id, peak_no, neutral_loss, ion_type, ion_index FROM (SELECT *, row_number() OVER (
 PARTITION BY spectrum_id, peak_no ORDER BY neutral_loss <> '', round(abs(delta), 6), ion_type, ion_index, neutral_loss) AS rn
 FROM matched) WHERE rn = 1
""",
)
def f3(spark, sf):
    order = [
        F.col("neutral_loss") != "", F.round(F.abs("delta"), 6), F.col("ion_type"),
        F.col("ion_index"), F.col("neutral_loss"),
    ]
    out = G.choose_annotation(V.matched(spark, sf), ["spectrum_id", "peak_no"], order)
    return out.select(
        "spectrum_id", "peak_no", "neutral_loss", "ion_type", F.col("ion_index").cast("long").alias("ion_index")
    )


def _ev_sql(cond=_PLAIN):
    return f"""
seen AS (SELECT DISTINCT spectrum_id, site FROM matched WHERE {cond} AND intensity > 0),
ev AS (SELECT s.spectrum_id, s.peptide, r.k AS site, seen.site IS NOT NULL AS e FROM spectrum_psms s
  CROSS JOIN range(1, 8) r(k) LEFT JOIN seen ON seen.spectrum_id = s.spectrum_id AND seen.site = r.k),
gaps AS (SELECT spectrum_id, peptide, min(site) - 1 AS s, max(site) + 1 AS t FROM (SELECT *, site -
  row_number() OVER (PARTITION BY spectrum_id ORDER BY site) AS g FROM ev WHERE NOT e) GROUP BY 1, 2, g)
"""


def _evidence(spark, sf):
    return G.cleavage_evidence(V.spectrum_psms(spark, sf), V.matched(spark, sf), _S)


@query(
    "F4_cleavage_evidence",
    "WITH " + _ev_sql() + "SELECT spectrum_id, array_to_string(list(CASE WHEN e THEN 'T' ELSE 'F' END "
    "ORDER BY site), '') AS evidence FROM ev GROUP BY 1",
)
def f4(spark, sf):
    text = F.transform("evidence", lambda e: F.when(e, "T").otherwise("F"))
    return _evidence(spark, sf).select("spectrum_id", F.array_join(text, "").alias("evidence"))


@query(
    "F5_ambiguous_tags",
    "WITH " + _ev_sql() + 'SELECT spectrum_id, s AS start, t AS "end", substr(peptide, CAST(s + 1 AS INT), CAST(t - s AS INT)) '
    "AS tag FROM gaps",
)
def f5(spark, sf):
    out = G.ambiguous_tags(_evidence(spark, sf))
    return out.select("spectrum_id", F.inline(F.arrays_zip("tag_ranges", "tags"))).selectExpr(
        "spectrum_id",
        "CAST(tag_ranges.start AS BIGINT) AS start",
        "CAST(tag_ranges.end AS BIGINT) AS end",
        "tags AS tag",
    )


def _missing_sql(prefix=""):
    return f"""
SELECT ev.spectrum_id, count(*) FILTER (WHERE NOT e) AS {prefix}missing_frag_sites,
 round(count(*) FILTER (WHERE NOT e) / count(*) * 100, 6) AS {prefix}missing_frag_pct,
 coalesce(any_value(g.n), 0) AS {prefix}missing_frag_count,
 coalesce(any_value(g.longest), 0) AS {prefix}missing_frag_longest_sequence,
 coalesce(min(site) FILTER (WHERE e) - 1, 0) AS {prefix}missing_frag_from_n,
 coalesce(7 - max(site) FILTER (WHERE e), 0) AS {prefix}missing_frag_from_c
FROM ev LEFT JOIN (SELECT spectrum_id, count(*) AS n, max(t - s - 1) AS longest FROM gaps GROUP BY 1) g
 USING (spectrum_id) GROUP BY 1
"""


_MISSING = ["sites", "count", "longest_sequence", "from_n", "from_c"]


def _missing_cols(df, prefix=""):
    return df.select(
        "spectrum_id",
        *[F.col(f"{prefix}missing_frag_{c}").cast("long").alias(f"{prefix}missing_frag_{c}") for c in _MISSING],
        F.round(f"{prefix}missing_frag_pct", 6).alias(f"{prefix}missing_frag_pct"),
    )


@query("F6_missing_frag_features", "WITH " + _ev_sql() + _missing_sql())
def f6(spark, sf):
    return _missing_cols(G.missing_frag_features(_evidence(spark, sf)))


@query(
    "F7_peak_features",
    "SELECT spectrum_id, round(sum(intensity), 3) AS tic, count(*) AS peak_count FROM peaks GROUP BY 1",
)
def f7(spark, sf):
    return _r(G.peak_features(V.peaks(spark, sf), _S), "tic", places=3)


_HYPER_SQL = """
hs AS (SELECT spectrum_id, lgamma(count(*) FILTER (WHERE ion_type LIKE 'y%') + 1)
  + lgamma(count(*) FILTER (WHERE ion_type LIKE 'b%') + 1)
  + ln(coalesce(sum(intensity) FILTER (WHERE ion_type LIKE 'y%'), 1)
     + coalesce(sum(intensity) FILTER (WHERE ion_type LIKE 'b%'), 1)) AS hyperscore
 FROM matched WHERE neutral_loss = '' GROUP BY 1)
"""


@query("F8_hyperscore", "WITH " + _HYPER_SQL + "SELECT spectrum_id, round(hyperscore, 5) AS hyperscore FROM hs")
def f8(spark, sf):
    return _r(G.hyperscore(V.matched(spark, sf), _S), "hyperscore", places=5)


@query(
    "F9_explained_intensity",
    """
WITH seen AS (SELECT spectrum_id, neutral_loss, ion_type, ion_index, max(intensity) AS i FROM matched
  WHERE neutral_loss IN ('', '-H2O') GROUP BY ALL),
th AS (SELECT *, round(theo_mz, 6) AS m6, CASE ion_type WHEN 'y1' THEN 0 WHEN 'b1' THEN 1 WHEN 'y2' THEN 2 ELSE 3 END
  + CASE neutral_loss WHEN '' THEN 0 ELSE 4 END AS pref FROM frag WHERE neutral_loss IN ('', '-H2O')),
ka AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, m6 ORDER BY pref, ion_index) AS rn FROM th)
  WHERE rn = 1),
kb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, m6 ORDER BY pref, ion_index) AS rn FROM th
  WHERE neutral_loss = '') WHERE rn = 1),
a AS (SELECT spectrum_id, sum(i) AS v FROM ka JOIN seen USING (spectrum_id, neutral_loss, ion_type, ion_index) GROUP BY 1),
b AS (SELECT spectrum_id, sum(i) AS v FROM kb JOIN seen USING (spectrum_id, neutral_loss, ion_type, ion_index) GROUP BY 1),
s AS (SELECT spectrum_id, sum(i) FILTER (WHERE ion_type LIKE 'y%') AS y, sum(i) FILTER (WHERE ion_type LIKE 'b%') AS b
  FROM seen WHERE neutral_loss = '' GROUP BY 1),
t AS (SELECT spectrum_id, sum(intensity) AS tic FROM peaks GROUP BY 1)
SELECT spectrum_id, round(coalesce(s.y, 0) / tic, 5) AS explained_y_pct, round(coalesce(s.b, 0) / tic, 5) AS explained_b_pct,
 round(coalesce(b.v, 0) / tic, 5) AS explained_by_pct,
 round((coalesce(a.v, 0) - coalesce(b.v, 0)) / tic, 5) AS explained_nl_pct, round(coalesce(a.v, 0) / tic, 5) AS explained_all_pct
FROM t LEFT JOIN s USING (spectrum_id) LEFT JOIN a USING (spectrum_id) LEFT JOIN b USING (spectrum_id)
""",
)
def f9(spark, sf):
    theo = V.fragments(spark, sf).withColumn("theo_mz", F.round("theo_mz", 6))
    tic = G.peak_features(V.peaks(spark, sf), _S)
    out = G.explained_intensity(theo, V.matched(spark, sf), tic, _S)
    return _r(out, *[c for c in out.columns if c != "spectrum_id"], places=5)


_PROTON = f"{K.PROTON_MASS!r}::DOUBLE"
_NEUTRON = f"{K.NEUTRON_MASS!r}::DOUBLE"
_MZ = f"(total + {K.WATER_MASS!r}::DOUBLE) / 2 + {_PROTON}"


@query(
    "F10_ppm_features",
    f"""
WITH b AS (SELECT spectrum_id, ion_type, ion_index, max({{'i': intensity, 't': theo_mz, 'e': exp_mz}}) AS p FROM matched
  WHERE neutral_loss = '' GROUP BY 1, 2, 3),
q AS (SELECT *, (p.t - p.e) / p.t * 1e6 AS ppm FROM b),
t AS (SELECT DISTINCT spectrum_id, {_MZ} AS mz FROM prefixes)
SELECT s.spectrum_id, round(coalesce(abs(avg(ppm) FILTER (WHERE ion_type LIKE 'y%')), -1), 3) AS ppm_mean_y,
 round(coalesce(abs(avg(ppm) FILTER (WHERE ion_type LIKE 'b%')), -1), 3) AS ppm_mean_b,
 round(coalesce(abs(avg(ppm)), -1), 3) AS ppm_mean_all,
 round(any_value(least(50.0::DOUBLE, {", ".join(
     f"abs((precursor_mz - (mz + {i} * {_NEUTRON} / 2)) / (mz + {i} * {_NEUTRON} / 2)) * 1e6" for i in (-1, 0, 1, 2)
 )})), 3) AS ppm_precursor
FROM spectrum_psms s JOIN t USING (spectrum_id) LEFT JOIN q USING (spectrum_id) GROUP BY 1
""",
)
def f10(spark, sf):
    out = G.ppm_features(V.spectrum_psms(spark, sf), V.matched(spark, sf), _S)
    return _r(out, *[c for c in out.columns if c != "spectrum_id"], places=3)


@query(
    "F11_isotope_intensity_features",
    "WITH " + _ISO_SQL + f""", a AS (SELECT spectrum_id, coalesce(sum(intensity) FILTER (WHERE ion_type LIKE 'y%'), 0) AS y,
  coalesce(sum(intensity) FILTER (WHERE ion_type LIKE 'b%'), 0) AS b, count(*) AS n FROM chain GROUP BY 1),
t AS (SELECT spectrum_id, sum(intensity) AS tic, count(*) AS pc FROM peaks GROUP BY 1),
z AS (SELECT DISTINCT spectrum_id, {_MZ} AS mz FROM prefixes)
SELECT s.spectrum_id, round(coalesce(y, 0) / tic, 5) AS y_pct, round(coalesce(b, 0) / tic, 5) AS b_pct,
 0.0::DOUBLE AS p_pct, CASE WHEN y + b > 0 THEN 1.0::DOUBLE END AS fragmented_pct,
 round(coalesce(n, 0) / pc, 5) AS pct_peaks_annotated, false AS precursor_peak_present,
 round((mz - precursor_mz) / precursor_mz * 1e6, 2) AS precursor_err_ppm, round(mz - precursor_mz, 4) AS precursor_err_da
FROM spectrum_psms s JOIN t USING (spectrum_id) JOIN z USING (spectrum_id) LEFT JOIN a USING (spectrum_id)""",
)
def f11(spark, sf):
    totals = G.peak_features(V.peaks(spark, sf), _S)
    out = G.isotope_intensity_features(V.spectrum_psms(spark, sf), _isotopes(spark, sf), totals, _S)
    out = _r(out, "y_pct", "b_pct", "pct_peaks_annotated", places=5)
    return _r(_r(out, "precursor_err_ppm", places=2), "precursor_err_da", places=4)


@query(
    "F12_neutral_loss_evidence",
    "WITH " + _ev_sql("ion_type IN ('b1', 'b2', 'y1', 'y2')") + _missing_sql("NL_"),
)
def f12(spark, sf):
    out = G.neutral_loss_evidence(V.spectrum_psms(spark, sf), V.matched(spark, sf), _S)
    return _missing_cols(out, "NL_")


_FEATURE_SQL = (
    "WITH " + _HYPER_SQL + ", " + _ev_sql() + """,
t AS (SELECT spectrum_id, sum(intensity) AS tic, count(*) AS peak_count FROM peaks GROUP BY 1),
ms AS (SELECT spectrum_id, count(*) FILTER (WHERE NOT e) AS missing_frag_sites FROM ev GROUP BY 1)
SELECT spectrum_id, peptide, round(tic, 3) AS tic, peak_count, missing_frag_sites, round(hyperscore, 5) AS hyperscore
FROM spectrum_psms JOIN t USING (spectrum_id) JOIN ms USING (spectrum_id) JOIN hs USING (spectrum_id)
"""
)


def _annotated(spark, sf):
    return G.Annotated(
        V.spectrum_psms(spark, sf), V.peaks(spark, sf), V.fragments(spark, sf), V.matched(spark, sf),
        _isotopes(spark, sf), _S,
    )


def _shown(features):
    out = features.select(
        "spectrum_id", "peptide", "tic", "peak_count", F.col("missing_frag_sites").cast("long").alias("missing_frag_sites"),
        "hyperscore",
    )
    return _r(_r(out, "tic", places=3), "hyperscore", places=5)


@query("F13_feature_table", _FEATURE_SQL)
def f13(spark, sf):
    """Generators run by name."""
    return _shown(G.generate_features(_annotated(spark, sf), ["peaks", "missing_fragmentation", "hyperscore"]))


@query("F13_regenerate", _FEATURE_SQL)
def f13_regenerate(spark, sf):
    """One generator's outdated columns are computed anew, the others stay."""
    x = _annotated(spark, sf)
    old = G.generate_features(x, ["peaks", "missing_fragmentation", "hyperscore"]).withColumn("hyperscore", F.lit(-1.0))
    return _shown(G.regenerate(old, G.GENERATORS["hyperscore"](x), _S))


@query("F13_all_generators")
def f13_all(spark, sf):
    return G.generate_features(_annotated(spark, sf), sorted(G.GENERATORS)).select(
        "spectrum_id", "missing_frag_sites", "NL_missing_frag_sites", "tic", "hyperscore", "ppm_mean_all", "pct_peaks_annotated"
    )


@query(
    "F14_ion_counts",
    "SELECT spectrum_id, ion_type, count(DISTINCT ion_index) AS n_ions, round(count(DISTINCT ion_index) / 7, 6) AS share "
    "FROM matched WHERE neutral_loss = '' GROUP BY 1, 2",
)
def f14(spark, sf):
    m = V.matched(spark, sf).filter("neutral_loss = ''")
    return _r(G.ion_counts(m, _lengths(spark, sf), _S), "share")


