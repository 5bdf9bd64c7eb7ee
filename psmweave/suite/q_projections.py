"""Queries for projections, filters and peptide normalisation (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from psmweave.functions import peptide as P
from psmweave.operators import filters as X
from psmweave.operators import joins as J
from psmweave.suite import views as V
from psmweave.suite.registry import query

_ID = ["run", "spectrum_id", "psm_no", "part"]


def _mods_sql(expr: str) -> str:
    return f"SELECT run, spectrum_id, psm_no, part, {expr} FROM mod_rows"


_N_TERM = ["+43.006-17.027", "+42.011", "+43.006", "-17.027"]
_NORM_SQL = """
SELECT run, spectrum_id, psm_no, part,
  CASE WHEN raw_peptide LIKE '%+42.011K%' THEN NULL ELSE proforma END AS peptide
FROM mod_rows
"""


@query("P1_normalise_peptide", _NORM_SQL)
def p1(spark, sf):
    return V.mod_rows(spark, sf).select(
        *_ID, P.normalise_peptide("raw_peptide", "casanovo").alias("peptide")
    )


@query(
    "P2_valid_peptide",
    """
SELECT run, spectrum_id, psm_no, part, proforma AS peptide FROM mod_rows
WHERE raw_peptide NOT LIKE '%+42.011K%' AND CAST(split_part(proforma, '/', 2) AS INT) <= 6
""",
)
def p2(spark, sf):
    rows = V.mod_rows(spark, sf).select(
        *_ID, P.normalise_peptide("raw_peptide", "casanovo").alias("peptide")
    )
    return rows.filter(P.is_valid_peptide("peptide"))


@query("P3_equate_leu_ile", _mods_sql("replace(proforma, 'L', 'I') AS peptide"))
def p3(spark, sf):
    return V.mod_rows(spark, sf).select(*_ID, P.equate_leu_ile("proforma").alias("peptide"))


@query(
    "P4_equate_deamidation",
    _mods_sql(
        "replace(replace(regexp_replace(proforma, 'I([^M]|$)', 'L\\1', 'g'), 'N[UNIMOD:7]', 'D'), "
        "'Q[UNIMOD:7]', 'E') AS peptide"
    ),
)
def p4(spark, sf):
    return V.mod_rows(spark, sf).select(*_ID, P.equate_deamidation("proforma").alias("peptide"))


@query("P5_drop_charge", _mods_sql("split_part(proforma, '/', 1) AS peptide"))
def p5(spark, sf):
    return V.mod_rows(spark, sf).select(*_ID, P.drop_charge("proforma").alias("peptide"))


_LETTER_SQL = "proforma"
for _old, _new in [
    ("[+25.980265]-", "b"), ("[UNIMOD:1]-", "z"), ("[UNIMOD:5]-", "d"), ("[UNIMOD:385]-", "e"),
    ("Q[UNIMOD:7]", "q"), ("N[UNIMOD:7]", "n"), ("C[UNIMOD:4]", "c"), ("M[UNIMOD:35]", "v"),
    ("L", "I"),
]:
    _LETTER_SQL = f"replace({_LETTER_SQL}, '{_old}', '{_new}')"


@query("P6_to_letter_string", _mods_sql(f"split_part({_LETTER_SQL}, '/', 1) AS letters"))
def p6(spark, sf):
    return V.mod_rows(spark, sf).select(*_ID, P.to_letter_string("proforma").alias("letters"))


_SOURCES = (
    "CASE CAST(substr(engine, 8) AS INT) WHEN 0 THEN 'Casanovo4.2.0' WHEN 1 THEN 'NovoB' "
    "WHEN 2 THEN 'pihelixnovo' WHEN 3 THEN NULL ELSE engine END"
)


@query(
    "P7_engine_label",
    f"""
SELECT run, engine, CASE s WHEN 'Casanovo4.2.0' THEN 'casanovo' WHEN 'NovoB' THEN 'novob'
  WHEN 'pihelixnovo' THEN 'pi-HelixNovo' ELSE coalesce(s, 'Unspecified') END AS label,
  count(*) AS n
FROM (SELECT run, engine, {_SOURCES} AS s FROM psms) GROUP BY ALL
""",
)
def p7(spark, sf):
    return (
        V.psms(spark, sf)
        .withColumn("source", F.expr(_SOURCES))
        .withColumn("label", P.engine_label("source"))
        .groupBy("run", "engine", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "P8_to_engine_format",
    _mods_sql(
        "CASE WHEN proforma LIKE '[UNIMOD%' OR proforma LIKE '[+25%' OR proforma LIKE '%Q[UN%' "
        "OR proforma LIKE '%N[UN%' THEN NULL "
        "ELSE split_part(replace(replace(proforma, 'C[UNIMOD:4]', 'C(1)'), 'M[UNIMOD:35]', 'M(0)'), "
        "'/', 1) END AS sequence"
    ),
)
def p8(spark, sf):
    return V.mod_rows(spark, sf).select(
        *_ID, P.to_engine_format("proforma", "casanovo", "novor").alias("sequence")
    )


@query(
    "P9_drop_unsupported_mods",
    """
SELECT run, spectrum_id, psm_no, part, split_part(proforma, '/', 1) AS sequence,
  replace(replace(replace(replace(replace(replace(split_part(proforma, '/', 1), '[UNIMOD:1]-', ''),
  '[UNIMOD:5]-', ''), '[UNIMOD:385]-', ''), 'Q[UNIMOD:7]', 'E'), 'N[UNIMOD:7]', 'D'),
  'C[UNIMOD:4]', 'C') AS spectralis
FROM mod_rows WHERE proforma NOT LIKE '[+25%'
""",
)
def p9(spark, sf):
    return (
        V.mod_rows(spark, sf)
        .select(
            *_ID,
            P.drop_unsupported_mods("proforma").alias("sequence"),
            P.to_spectralis("proforma").alias("spectralis"),
        )
        .filter("sequence IS NOT NULL")
    )


@query(
    "P10_tokenise",
    """
SELECT run, spectrum_id, psm_no, part, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT *, regexp_extract_all(split_part(proforma, '/', 1),
  '\\[UNIMOD:\\d+\\]|[A-Z](?:\\[UNIMOD:\\d+\\])?') AS t FROM mod_rows WHERE proforma NOT LIKE '[+25%')
""",
)
def p10(spark, sf):
    return (
        V.mod_rows(spark, sf)
        .withColumn("sequence", P.drop_unsupported_mods("proforma"))
        .filter("sequence IS NOT NULL")
        .withColumn("t", P.refiner_tokens("sequence"))
        .select(
            *_ID,
            F.size("t").cast("long").alias("n_tokens"),
            F.array_join("t", " ").alias("tokens"),
        )
    )


@query(
    "P11_collapse_mass_penalty",
    """
SELECT run, spectrum_id, engine, rank,
  round(CASE WHEN engine IN ('engine_0', 'engine_1') AND score - 0.5 < 0 THEN score + 0.5
        ELSE score - 0.5 END, 6) AS score FROM psms
""",
)
def p11(spark, sf):
    rows = V.psms(spark, sf).withColumn("score", F.col("score") - 0.5)
    return X.collapse_mass_penalty(rows, ["engine_0", "engine_1"]).select(
        "run", "spectrum_id", "engine", "rank", F.round("score", 6).alias("score")
    )


_P12_COLS = [
    "l_orderkey AS spectrum_id",
    "l_linenumber AS psm_no",
    "l_partkey AS part",
    "l_quantity AS probability_forward",
    "CAST(1 + (l_partkey % 50) AS DOUBLE) AS probability_reverse",
    "CAST(l_suppkey % 7 - 3 AS DOUBLE) AS mass_forward",
    "CAST(l_orderkey % 7 - 3 AS DOUBLE) AS mass_reverse",
]


@query(
    "P12_best_of_two",
    f"""
SELECT spectrum_id, psm_no, part,
  CASE WHEN probability_forward > probability_reverse THEN 'forward'
       WHEN probability_forward < probability_reverse THEN 'reverse'
       WHEN abs(mass_forward) < abs(mass_reverse) THEN 'forward' ELSE 'reverse' END AS direction,
  greatest(probability_forward, probability_reverse) AS score
FROM (SELECT {", ".join(_P12_COLS)} FROM lineitem)
""",
)
def p12(spark, sf):
    rows = V.table(spark, sf, "lineitem").selectExpr(*_P12_COLS)
    return X.best_of_two(rows, ["probability", "mass"]).selectExpr(
        "spectrum_id", "psm_no", "part", "direction", "probability AS score"
    )


@query(
    "P13_decoy_status",
    "SELECT run, spectrum_id, engine, rank, protein LIKE 'rev%' AS is_decoy FROM psms",
)
def p13(spark, sf):
    rows = V.psms(spark, sf).withColumn("protein_list", F.array("protein"))
    return rows.select(
        "run", "spectrum_id", "engine", "rank", X.decoy_status("protein_list").alias("is_decoy")
    )


@query(
    "P14_psm_type",
    """
SELECT run, spectrum_id,
  CASE WHEN is_decoy THEN 'decoy' WHEN qvalue < 0.01 THEN 'target_accepted'
  ELSE 'target_rejected' END AS psm_type,
  CASE WHEN is_decoy THEN 'decoy' WHEN qvalue <= 0.01 THEN 'target_accepted'
  ELSE 'target_rejected' END AS psm_type_inclusive FROM gt
""",
)
def p14(spark, sf):
    return V.gt(spark, sf).select(
        "run",
        "spectrum_id",
        X.psm_type("is_decoy", "qvalue").alias("psm_type"),
        X.psm_type("is_decoy", "qvalue", inclusive=True).alias("psm_type_inclusive"),
    )


_SPEC_COLS = [
    "vec_id AS spectrum_id",
    "CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 10 AS INT) END AS charge",
    "slice(embedding, 1, CAST(10 + vec_id % 20 AS INT)) AS mz",
]


@query(
    "P15_reformat_spectra",
    """
SELECT spectrum_id, n_peaks, charge, reason FROM (
 SELECT vec_id AS spectrum_id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE vec_id % 10 END AS charge,
  10 + vec_id % 20 AS n_peaks,
  CASE WHEN vec_id % 13 = 0 THEN 'not_listed' WHEN 10 + vec_id % 20 < 15 THEN 'few_peaks'
   WHEN vec_id % 11 = 0 OR vec_id % 10 = 0 THEN 'no_charge' WHEN vec_id % 10 > 8 THEN 'high_charge'
   ELSE 'kept' END AS reason
 FROM embeddings)
""",
)
def p15(spark, sf):
    emb = V.table(spark, sf, "embeddings")
    spectra = emb.selectExpr(*_SPEC_COLS)
    listed = emb.filter("vec_id % 13 <> 0").selectExpr("vec_id AS spectrum_id")
    out = X.reformat_spectra(spectra, ids=listed, on=["spectrum_id"])
    return out.select(
        "spectrum_id",
        F.size("mz").cast("long").alias("n_peaks"),
        F.col("charge").cast("long").alias("charge"),
        "reason",
    )


@query(
    "P16_filter_charge",
    "SELECT vec_id AS spectrum_id, CAST(vec_id % 10 AS INT) AS charge FROM embeddings "
    "WHERE vec_id % 11 <> 0 AND vec_id % 10 <= 4",
)
def p16(spark, sf):
    spectra = V.table(spark, sf, "embeddings").selectExpr(*_SPEC_COLS)
    return X.filter_charge(spectra, 4).select("spectrum_id", "charge")


@query(
    "P17_spectrum_qc",
    """
, k1 AS (SELECT *, CAST(200 + spectrum_id % 300 AS DOUBLE) AS pmz FROM peaks),
k2 AS (SELECT * FROM k1 WHERE mz >= 150 AND mz <= 650 AND abs(mz - pmz) > 2),
k3 AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM k2),
k4 AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mz) AS rn
       FROM k3 WHERE intensity >= 0.05 * top),
k5 AS (SELECT *, sqrt(intensity) AS s FROM k4 WHERE rn <= 20)
SELECT spectrum_id, count(*) AS n_peaks, round(sum(mz), 4) AS sum_mz,
  round(sum(s) / sqrt(sum(s * s)), 5) AS sum_intensity,
  round(max(s) / sqrt(sum(s * s)), 5) AS max_intensity FROM k5 GROUP BY 1
""".replace(", k1", "WITH k1", 1),
)
def p17(spark, sf):
    spectra = V.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS spectrum_id",
        "CAST(200 + vec_id % 300 AS DOUBLE) AS precursor_mz",
        "transform(embedding, (x, i) -> 100 + 10 * i + CAST(x AS DOUBLE)) AS mz",
        "transform(embedding, x -> abs(CAST(x AS DOUBLE)) * 1000) AS intensity",
    )
    out = X.spectrum_qc(
        spectra, min_mz=150, max_mz=650, min_intensity=0.05, n_peaks=20
    )
    total = "aggregate({0}, CAST(0 AS DOUBLE), (a, x) -> a + x)"
    return out.selectExpr(
        "spectrum_id",
        "CAST(size(mz) AS BIGINT) AS n_peaks",
        f"round({total.format('mz')}, 4) AS sum_mz",
        f"round({total.format('intensity')}, 5) AS sum_intensity",
        "round(array_max(intensity), 5) AS max_intensity",
    )


@query(
    "P18_min_length",
    "SELECT run, spectrum_id, engine, rank, peptide FROM psms WHERE length(peptide) >= 7",
)
def p18(spark, sf):
    return X.min_length(V.psms(spark, sf), 7).select(
        "run", "spectrum_id", "engine", "rank", "peptide"
    )


@query(
    "P19_modification_list",
    """
SELECT run, spectrum_id, psm_no, part, array_to_string(list_sort(m), ',') AS modifications,
  list_contains(m, 'UNIMOD:35') AS oxidised
FROM (SELECT *, list_distinct(regexp_extract_all(proforma, '\\[([^\\]]*)\\]', 1)) AS m FROM mod_rows)
""",
)
def p19(spark, sf):
    return V.mod_rows(spark, sf).select(
        *_ID,
        F.array_join(P.modifications("proforma"), ",").alias("modifications"),
        F.array_contains(P.modifications("proforma"), "UNIMOD:35").alias("oxidised"),
    )


@query(
    "P19_modifications_per_run",
    """
SELECT run, m AS modification, count(*) AS n FROM (
 SELECT run, unnest(list_distinct(regexp_extract_all(proforma, '\\[([^\\]]*)\\]', 1))) AS m
 FROM mod_rows) GROUP BY ALL
""",
)
def p19b(spark, sf):
    return X.modifications_per_run(V.mod_rows(spark, sf), "proforma")


@query(
    "P20_noise_cutoff",
    """
SELECT spectrum_id, round(min(intensity) * 5, 6) AS lod_5, round(min(intensity) * 10, 6) AS lod_10,
  round(pow(2, median(log2(intensity)) + stddev_pop(log2(intensity))), 3) AS std_cutoff
FROM peaks WHERE intensity > 0 GROUP BY 1
""",
)
def p20(spark, sf):
    noise = V.peaks(spark, sf).filter("intensity > 0")
    out = X.noise_cutoff(noise, ["spectrum_id"])
    return out.select(
        "spectrum_id",
        F.round("lod_5", 6).alias("lod_5"),
        F.round("lod_10", 6).alias("lod_10"),
        F.round("std_cutoff", 3).alias("std_cutoff"),
    )


_MASS_VALUES = ", ".join(f"('{a}', {m!r}::DOUBLE)" for a, m in P.K.RESIDUE_MASS.items())
_MASS_SQL = f"""
WITH mass AS (SELECT * FROM (VALUES {_MASS_VALUES}) AS t(aa, m)),
pep AS (SELECT DISTINCT peptide FROM psms),
w AS (SELECT peptide, sum(m) + {P.K.WATER_MASS!r}::DOUBLE AS neutral
      FROM (SELECT peptide, unnest(string_split(peptide, '')) AS aa FROM pep) JOIN mass USING (aa)
      GROUP BY 1)
"""


@query(
    "P21_peptide_mass",
    _MASS_SQL
    + f"""SELECT run, spectrum_id, engine, rank, round(neutral, 4) AS mass,
  round(neutral / 2 + {P.K.PROTON_MASS!r}::DOUBLE, 4) AS mz FROM psms JOIN w USING (peptide)""",
)
def p21(spark, sf):
    return V.psms(spark, sf).select(
        "run",
        "spectrum_id",
        "engine",
        "rank",
        F.round(P.peptide_mass("peptide"), 4).alias("mass"),
        F.round(P.peptide_mz("peptide", F.lit(2)), 4).alias("mz"),
    )


_NEUTRON = repr(P.K.NEUTRON_MASS) + "::DOUBLE"
_ISO_SQL = ", ".join(
    f"abs((a - (b + {i} * {_NEUTRON} / 2)) / (b + {i} * {_NEUTRON} / 2)) * 1e6" for i in (-1, 0, 1, 2)
)


@query(
    "P22_mass_error",
    _MASS_SQL.replace("FROM psms)", "FROM psms UNION SELECT DISTINCT gt_peptide FROM gt)")
    + f""", pairs AS (SELECT p.run, p.spectrum_id, p.engine, p.rank,
   x.neutral / 2 + {P.K.PROTON_MASS!r}::DOUBLE AS a, y.neutral / 2 + {P.K.PROTON_MASS!r}::DOUBLE AS b
   FROM joined p JOIN w x ON x.peptide = p.peptide JOIN w y ON y.peptide = p.gt_peptide)
SELECT run, spectrum_id, engine, rank, round(a - b, 4) AS error_da,
 round((a - b) / b * 1e6, 2) AS error_ppm, round(least(50.0::DOUBLE, {_ISO_SQL}), 2) AS ppm FROM pairs""",
)
def p22(spark, sf):
    rows = V.joined(spark, sf).select(
        "run",
        "spectrum_id",
        "engine",
        "rank",
        P.peptide_mz("peptide", F.lit(2)).alias("a"),
        P.peptide_mz("gt_peptide", F.lit(2)).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "run",
        "spectrum_id",
        "engine",
        "rank",
        F.round(P.mass_difference(a, b), 4).alias("error_da"),
        F.round(P.mass_difference(a, b, "ppm"), 2).alias("error_ppm"),
        F.round(P.precursor_ppm(a, b, F.lit(2)), 2).alias("ppm"),
    )


@query(
    "P23_spectralis_score_column",
    "SELECT run, spectrum_id, engine, rank, CASE WHEN psm_no % 2 = 0 THEN score END "
    "AS spectralis_score FROM psms",
)
def p23(spark, sf):
    rows = V.psms(spark, sf).withColumn(
        "features",
        F.when(
            F.col("psm_no") % 2 == 0, F.create_map(F.lit("spectralis_score"), F.col("score"))
        ).otherwise(F.create_map(F.lit("hyperscore"), F.col("score"))),
    )
    return rows.select(
        "run", "spectrum_id", "engine", "rank",
        X.feature("features", "spectralis_score").alias("spectralis_score"),
    )


@query(
    "P24_evaluate_exact",
    """
SELECT p.run, p.spectrum_id, p.engine, p.rank, p.peptide = g.gt_peptide AS correct_prediction
FROM psms p LEFT JOIN gt_ok g USING (run, spectrum_id)
""",
)
def p24(spark, sf):
    return J.evaluate_exact(V.psms(spark, sf), V.gt_ok(spark, sf)).select(
        "run", "spectrum_id", "engine", "rank", "correct_prediction"
    )
