"""Adapter views: the driver's tables shaped like PSMs, spectra and proteins.

Each view exists twice: as a DataFrame and as SQL text for the oracle.  Row
expressions are shared strings that read the same in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.operators.running import rank_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a task after :func:`_spread`: PSMs are aggregated and sorted there, spectra become 64 or 84 rows each.
PSM_ROWS = 400_000
SPECTRUM_ROWS = 8_000


def _spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` shuffled by ``key`` into parts of about ``rows`` rows, by the counts in the files' footers.

    Rows that compress well or are multiplied afterwards would else be put into few tasks by their shuffled bytes.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), key)


_GOOD = "l_quantity >= 25 + l_partkey % 25"
# Peptide and protein are small numbers until the rows are unique, text afterwards.
_PSM_CODE = (
    f"(CASE WHEN {_GOOD} THEN l_orderkey ELSE l_partkey END % 15) * 3 + "
    f"CASE WHEN {_GOOD} OR l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 1 ELSE 2 END"
)
_PSM_ROW_COLS = [
    "l_orderkey AS spectrum_id",
    "l_suppkey % 8 AS engine_no",
    "l_linenumber AS psm_no",
    "l_quantity / 50 AS score",
    f"{_PSM_CODE} AS code",
    "l_partkey % 200 AS protein_no",
]
_STEM = "CAST((code - code % 3) / 3 AS BIGINT)"
_PSM_COLS = [
    "concat('run_', CAST(spectrum_id % 4 AS STRING)) AS run",
    "spectrum_id",
    "concat('engine_', CAST(engine_no AS STRING)) AS engine",
    "psm_no",
    "score",
    f"concat(translate(CAST({_STEM} % 5 AS STRING), '01234', 'GASPV'), "
    f"translate(CAST({_STEM} % 3 AS STRING), '012', 'LIK'), "
    "CASE code % 3 WHEN 0 THEN 'TDEK' WHEN 1 THEN 'DTEK' ELSE 'NGGEK' END) AS peptide",
    "CASE WHEN protein_no % 4 = 0 THEN concat('rev_', CAST(protein_no % 50 AS STRING)) "
    "ELSE CAST(protein_no % 50 AS STRING) END AS protein",
]

_GT_COLS = [
    "concat('run_', CAST(o_orderkey % 4 AS STRING)) AS run",
    "o_orderkey AS spectrum_id",
    "concat(translate(CAST(o_orderkey % 5 AS STRING), '01234', 'GASPV'), "
    "translate(CAST(o_orderkey % 3 AS STRING), '012', 'ILK'), 'TDEK') AS gt_peptide",
    "CAST(o_orderkey % 100 AS DOUBLE) / 9000 AS qvalue",
    "o_orderkey % 10 = 9 AS is_decoy",
    "CAST(o_custkey % 50 AS DOUBLE) / 50 AS gt_score",
]

_MOD_COLS = [
    "concat('run_', CAST(l_orderkey % 4 AS STRING)) AS run",
    "l_orderkey AS spectrum_id",
    "l_linenumber AS psm_no",
    "l_partkey AS part",
    "concat(CASE l_partkey % 9 WHEN 0 THEN '+42.011' WHEN 1 THEN '-17.027' "
    "WHEN 2 THEN '+43.006-17.027' WHEN 3 THEN '+43.006' ELSE '' END, "
    "CASE l_partkey % 5 WHEN 0 THEN 'M+15.995' WHEN 1 THEN 'N+0.984' WHEN 2 THEN 'Q+0.984' "
    "WHEN 3 THEN 'C+57.021' ELSE 'L' END, "
    "translate(CAST(l_suppkey % 10 AS STRING), '0123456789', 'GASPVTLINK'), "
    "CASE WHEN l_linenumber = 7 THEN '+42.011K' ELSE 'DEK' END, "
    "'/', CAST(1 + l_orderkey % 8 AS STRING)) AS raw_peptide",
    "concat(CASE l_partkey % 9 WHEN 0 THEN '[UNIMOD:1]-' WHEN 1 THEN '[UNIMOD:385]-' "
    "WHEN 2 THEN '[+25.980265]-' WHEN 3 THEN '[UNIMOD:5]-' ELSE '' END, "
    "CASE l_partkey % 5 WHEN 0 THEN 'M[UNIMOD:35]' WHEN 1 THEN 'N[UNIMOD:7]' "
    "WHEN 2 THEN 'Q[UNIMOD:7]' WHEN 3 THEN 'C[UNIMOD:4]' ELSE 'L' END, "
    "translate(CAST(l_suppkey % 10 AS STRING), '0123456789', 'GASPVTLINK'), 'DEK', "
    "'/', CAST(1 + l_orderkey % 8 AS STRING)) AS proforma",
]

_SCORED_COLS = [
    "event_type AS engine",
    "event_id AS spectrum_id",
    "value AS score",
    "event_id % 100 < value * 3 AS correct",
    "event_id % 100 < value * 4 AS lenient",
    "concat('run_', CAST(user_id % 3 AS STRING)) AS run",
]

_SPECTRUM_COLS = [
    "vec_id AS spectrum_id",
    "concat("
    + ", ".join(
        f"translate(CAST((vec_id * {m} + label) % 10 AS STRING), '0123456789', 'GASPVTLNDQ')"
        for m in (1, 3, 7, 9, 11, 13, 17)
    )
    + ", 'K') AS peptide",
    "CAST(2 AS INT) AS charge",
    "300.5 + CAST(vec_id % 200 AS DOUBLE) AS precursor_mz",
]

_MASS_ROWS = ", ".join(f"('{a}', {m!r}::DOUBLE)" for a, m in K.RESIDUE_MASS.items())

VIEW_SQL: dict[str, str] = {
    "residue_mass": f"SELECT * FROM (VALUES {_MASS_ROWS}) AS t(aa, m)",
    "spectrum_psms": "SELECT " + ", ".join(_SPECTRUM_COLS).replace("300.5", "300.5::DOUBLE")
    + " FROM embeddings",
    "prefixes": "SELECT spectrum_id, i AS site, length(peptide) AS n, "
    "sum(m) OVER (PARTITION BY spectrum_id ORDER BY i) AS prefix, "
    "sum(m) OVER (PARTITION BY spectrum_id) AS total FROM (SELECT spectrum_id, peptide, "
    "unnest(string_split(peptide, '')) AS aa, unnest(range(1, length(peptide) + 1)) AS i "
    "FROM spectrum_psms) JOIN residue_mass USING (aa)",
    "frag": "SELECT spectrum_id, nl AS neutral_loss, concat(s, CAST(z AS VARCHAR)) AS ion_type, "
    "CASE WHEN s = 'y' THEN n - site ELSE site END AS ion_index, z AS charge, site, "
    f"(CASE WHEN s = 'y' THEN total - prefix + {K.WATER_MASS!r}::DOUBLE ELSE prefix END "
    f"- CASE nl WHEN '' THEN 0 WHEN '-H2O' THEN {K.WATER_MASS!r}::DOUBLE "
    f"ELSE {K.AMMONIA_MASS!r}::DOUBLE END) / z + {K.PROTON_MASS!r}::DOUBLE AS theo_mz "
    "FROM prefixes, (SELECT unnest(['b', 'y']) AS s), (SELECT unnest([1, 2]) AS z), "
    "(SELECT unnest(['', '-H2O', '-NH3']) AS nl) WHERE site < n",
    "matched": "SELECT f.*, p.mz AS exp_mz, p.intensity, p.peak_no, p.mz - f.theo_mz AS delta "
    "FROM frag f JOIN peaks p ON p.spectrum_id = f.spectrum_id AND abs(p.mz - f.theo_mz) < 0.5",
    "psm_rows": "SELECT " + ", ".join(_PSM_ROW_COLS) + " FROM lineitem",
    "psm_unique": "SELECT spectrum_id, engine_no, psm_no, max(score) AS score, min(code) AS code, "
    "min(protein_no) AS protein_no FROM psm_rows GROUP BY spectrum_id, engine_no, psm_no",
    "psms": "SELECT *, row_number() OVER (PARTITION BY run, spectrum_id, engine "
    "ORDER BY score DESC, psm_no) AS rank FROM (SELECT " + ", ".join(_PSM_COLS) + " FROM psm_unique)",
    "top_psms": "SELECT * FROM psms WHERE rank = 1",
    "gt": "SELECT " + ", ".join(_GT_COLS) + " FROM orders",
    "gt_ok": "SELECT * FROM gt WHERE NOT is_decoy AND qvalue <= 0.01",
    "joined": "SELECT p.*, g.gt_peptide, g.gt_score, "
    "replace(p.peptide, 'L', 'I') = replace(g.gt_peptide, 'L', 'I') AS correct "
    "FROM psms p JOIN gt_ok g USING (run, spectrum_id)",
    "evaluated": "SELECT *, CASE WHEN peptide = gt_peptide THEN 'match' "
    "WHEN correct THEN 'isobaric_aa' WHEN score > gt_score THEN 'Higher score' "
    "WHEN score < gt_score THEN 'Lower score' ELSE 'Different' END AS error_type FROM joined",
    "top_eval": "SELECT * FROM evaluated WHERE rank = 1",
    "refinements": "SELECT run, CASE WHEN (spectrum_id + psm_no) % 5 = 0 THEN -1 - spectrum_id "
    "ELSE spectrum_id END AS spectrum_id, engine, rank, "
    "concat('refiner_', CAST(psm_no % 2 AS STRING)) AS refiner, "
    "CASE WHEN psm_no % 3 = 0 THEN peptide ELSE concat(translate(CAST(spectrum_id % 5 AS STRING), "
    "'01234', 'GASPV'), 'ITDEK') END AS refined_peptide, "
    "score / 2 + 0.25 AS refined_score FROM psms",
    "mod_rows": "SELECT " + ", ".join(_MOD_COLS) + " FROM lineitem",
    "scored": "SELECT " + ", ".join(_SCORED_COLS) + " FROM events",
    "proteins": "SELECT doc_id AS protein_id, lang AS organism, source, "
    "upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS sequence FROM documents",
    "peptides": "SELECT item_id, unnest(list_filter(list_transform(string_split(text, '.'), "
    "lambda x: upper(regexp_replace(x, '[^a-zA-Z]', '', 'g'))), lambda x: x <> '')) AS peptide FROM benchmark",
    "peaks": "SELECT vec_id AS spectrum_id, i - 1 AS peak_no, "
    "100 + 10 * (i - 1) + CAST(x AS DOUBLE) AS mz, abs(CAST(x AS DOUBLE)) * 1000 AS intensity "
    "FROM (SELECT vec_id, unnest(embedding) AS x, "
    "generate_subscripts(embedding, 1) AS i FROM embeddings)",
}


def psms(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (run, spectrum_id, engine, rank)."""
    rows = _spread(table(spark, sf, "lineitem").selectExpr(*_PSM_ROW_COLS), "spectrum_id", PSM_ROWS)
    unique = (
        rows.groupBy("spectrum_id", "engine_no", "psm_no")
        .agg(
            F.max("score").alias("score"),
            F.min("code").alias("code"),
            F.min("protein_no").alias("protein_no"),
        )
        .selectExpr(*_PSM_COLS)
    )
    return rank_rows(
        unique, ["run", "spectrum_id", "engine"], [("score", False), ("psm_no", True)], "first"
    )


def top_psms(spark: SparkSession, sf: str) -> DataFrame:
    return psms(spark, sf).filter("rank = 1")


def gt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_GT_COLS)


def gt_ok(spark: SparkSession, sf: str) -> DataFrame:
    return gt(spark, sf).filter("NOT is_decoy AND qvalue <= 0.01")


def joined(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` are the PSMs where a query has them already."""
    from psmweave.operators.joins import attach_ground_truth

    rows = psms(spark, sf) if rows is None else rows
    return attach_ground_truth(rows, gt(spark, sf)).drop("qvalue", "is_decoy")


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return joined(spark, sf).withColumn(
        "error_type",
        F.expr(
            "CASE WHEN peptide = gt_peptide THEN 'match' WHEN correct THEN 'isobaric_aa' "
            "WHEN score > gt_score THEN 'Higher score' WHEN score < gt_score THEN 'Lower score' "
            "ELSE 'Different' END"
        ),
    )


def top_eval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).filter("rank = 1")


def refinements(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """A refinement of every PSM; a fifth stands under spectra that no PSM has."""
    return (
        (psms(spark, sf) if rows is None else rows)
        .selectExpr(
            "run",
            "CASE WHEN (spectrum_id + psm_no) % 5 = 0 THEN -1 - spectrum_id ELSE spectrum_id END AS spectrum_id",
            "engine",
            "rank",
            "concat('refiner_', CAST(psm_no % 2 AS STRING)) AS refiner",
            "CASE WHEN psm_no % 3 = 0 THEN peptide ELSE concat(translate("
            "CAST(spectrum_id % 5 AS STRING), '01234', 'GASPV'), 'ITDEK') END AS refined_peptide",
            "score / 2 + 0.25 AS refined_score",
        )
    )


def mod_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").repartition("l_orderkey").selectExpr(*_MOD_COLS)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*_SCORED_COLS)


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").repartition("doc_id").selectExpr(
        "doc_id AS protein_id",
        "lang AS organism",
        "source",
        "upper(regexp_replace(text, '[^a-zA-Z]', '')) AS sequence",
    )


def peptides(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every item, whole."""
    return table(spark, sf, "benchmark").selectExpr(
        "item_id",
        "explode(filter(transform(split(text, '[.]'), x -> upper(regexp_replace(x, '[^a-zA-Z]', ''))), "
        "x -> x <> '')) AS peptide",
    )


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _spread(table(spark, sf, "embeddings"), "vec_id", SPECTRUM_ROWS)
        .select(F.col("vec_id").alias("spectrum_id"), F.posexplode("embedding"))
        .selectExpr(
            "spectrum_id",
            "CAST(pos AS BIGINT) AS peak_no",
            "100 + 10 * pos + CAST(col AS DOUBLE) AS mz",
            "abs(CAST(col AS DOUBLE)) * 1000 AS intensity",
        )
    )


def spectrum_psms(spark: SparkSession, sf: str) -> DataFrame:
    """One PSM per embedding spectrum."""
    return _spread(table(spark, sf, "embeddings"), "vec_id", SPECTRUM_ROWS).selectExpr(*_SPECTRUM_COLS)


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    from psmweave.operators.fragments import theoretical_fragments

    return theoretical_fragments(
        spectrum_psms(spark, sf), ["spectrum_id"], losses=("", "-H2O", "-NH3")
    )


def matched(spark: SparkSession, sf: str) -> DataFrame:
    from psmweave.operators.fragments import fragment_match

    return fragment_match(fragments(spark, sf), peaks(spark, sf), ["spectrum_id"], 0.5)
