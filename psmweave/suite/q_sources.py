"""Queries for sources and sinks (S): files derived from the tables are written and read back."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import functions as F

from psmweave.operators import joins as J
from psmweave.operators import summary as S
from psmweave.operators.running import rank_rows
from psmweave.runtime import scratch_path
from psmweave.sources import fasta, results, spectra, tables
from psmweave.suite import views as V
from psmweave.suite.registry import query

_TITLE = "concat('controllerType=0 controllerNumber=1 scan=', CAST({} AS STRING))"

# -- spectra -----------------------------------------------------------------------

_SPEC_SQL = """
sp AS (SELECT concat('run_', CAST(vec_id % 3 AS VARCHAR)) AS run, vec_id,
  concat('controllerType=0 controllerNumber=1 scan=', CAST(vec_id AS VARCHAR)) AS spectrum_id,
  row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) - 1 AS ordinal,
  300.25 + vec_id % 500 AS precursor_mz, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 1 + vec_id % 5 END AS charge,
  (vec_id % 900) / 10 AS retention_time FROM embeddings)
"""


def _spectra(spark, sf):
    df = V.table(spark, sf, "embeddings").selectExpr(
        "concat('run_', CAST(vec_id % 3 AS STRING)) AS run",
        "vec_id",
        _TITLE.format("vec_id") + " AS spectrum_id",
        "CAST(vec_id AS STRING) AS scans",
        "CAST(300.25 + vec_id % 500 AS DOUBLE) AS precursor_mz",
        "CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(1 + vec_id % 5 AS INT) END AS charge",
        "(vec_id % 900) / 10 AS retention_time",
        "CAST(NULL AS DOUBLE) AS ion_mobility",
        "transform(embedding, (x, i) -> round(100 + 10 * i + CAST(x AS DOUBLE), 4)) AS mz",
        "transform(embedding, x -> round(abs(CAST(x AS DOUBLE)) * 1000, 2)) AS intensity",
    )
    ranked = rank_rows(df, ["run"], [("vec_id", True)], "first", "ordinal")
    return ranked.withColumn("ordinal", (F.col("ordinal") - 1).cast("long"))


def _sum(c):
    return f"aggregate({c}, CAST(0 AS DOUBLE), (a, x) -> a + x)"


_PEAK_SQL = """
pk AS (SELECT spectrum_id AS vec_id, count(*) AS n_peaks, sum(round(mz, 4)) AS sum_mz FROM peaks GROUP BY 1)
"""


@query(
    "S1_read_mgf",
    "WITH " + _SPEC_SQL + "," + _PEAK_SQL + """SELECT run, spectrum_id, ordinal, CAST(vec_id AS VARCHAR) AS scans,
 CAST(precursor_mz AS DOUBLE) AS precursor_mz, charge, round(retention_time, 4) AS retention_time, n_peaks,
 round(sum_mz, 2) AS sum_mz FROM sp JOIN pk USING (vec_id)""",
)
def s1(spark, sf):
    path = scratch_path(spark, "mgf")
    spectra.write_mgf(_spectra(spark, sf), path)
    out = spectra.read_mgf(spark, path)
    return out.selectExpr(
        "run", "spectrum_id", "ordinal", "scans", "precursor_mz", "CAST(charge AS BIGINT) AS charge",
        "round(retention_time, 4) AS retention_time", "CAST(size(mz) AS BIGINT) AS n_peaks",
        f"round({_sum('mz')}, 2) AS sum_mz",
    )


_MZML_HEAD = '<mzML><run id="r"><spectrumList>'
_MZML_TAIL = "</spectrumList></run></mzML>"


def _mzml_lines(df):
    """Spectra as mzML text with 64-bit arrays; encoded in Arrow batches."""
    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: base64.b64encode(struct.pack(f"<{len(v)}d", *v)).decode())

    def param(name, value="", extra=""):
        return F.concat(F.lit(f'<cvParam name="{name}" value="'), value if not isinstance(value, str) else F.lit(value), F.lit(f'"{extra}/>'))

    def array(kind, col):
        return F.concat(
            F.lit("<binaryDataArray>"), param("64-bit float"), param("no compression"), param(kind),
            F.lit("<binary>"), encode(col), F.lit("</binary></binaryDataArray>"),
        )

    charge = F.coalesce(param("charge state", F.col("charge").cast("string")), F.lit(""))
    return df.select(
        "run",
        "ordinal",
        F.concat(
            F.lit('<spectrum index="'), F.col("ordinal").cast("string"), F.lit('" id="'), "spectrum_id", F.lit('">'),
            param("ms level", "2"),
            F.lit("<scanList><scan>"),
            param("scan start time", F.col("retention_time").cast("string"), ' unitName="minute"'),
            F.lit("</scan></scanList><precursorList><precursor><selectedIonList><selectedIon>"),
            param("selected ion m/z", F.col("precursor_mz").cast("string")), charge,
            F.lit("</selectedIon></selectedIonList></precursor></precursorList><binaryDataArrayList>"),
            array("m/z array", F.col("mz")), array("intensity array", F.col("intensity")),
            F.lit("</binaryDataArrayList></spectrum>"),
        ).alias("value"),
    )


@query(
    "S2_read_mzml",
    "WITH " + _SPEC_SQL + "," + _PEAK_SQL + """SELECT run, spectrum_id, CAST(vec_id AS VARCHAR) AS scans,
 CAST(precursor_mz AS DOUBLE) AS precursor_mz, charge, round(retention_time, 4) AS retention_time, n_peaks,
 round(sum_mz, 2) AS sum_mz FROM sp JOIN pk USING (vec_id)""",
)
def s2(spark, sf):
    path = scratch_path(spark, "mzml")
    body = _mzml_lines(_spectra(spark, sf))
    runs = body.select("run").distinct()
    for place, text in ((-1, _MZML_HEAD), (2**40, _MZML_TAIL)):
        body = body.unionByName(
            runs.select("run", F.lit(place).cast("long").alias("ordinal"), F.lit(text).alias("value"))
        )
    # An mzML file is one document, so each run is one file.
    body.repartition("run").sortWithinPartitions("run", "ordinal").select("run", "value").write.partitionBy(
        "run"
    ).text(path)
    out = spectra.read_mzml(spark, path).filter("ms_level = 2")
    return out.selectExpr(
        "run", "spectrum_id", "scans", "precursor_mz", "CAST(charge AS BIGINT) AS charge",
        "round(retention_time, 4) AS retention_time", "CAST(size(mz) AS BIGINT) AS n_peaks",
        f"round({_sum('mz')}, 2) AS sum_mz",
    )


@query(
    "S27_write_spectra",
    "WITH " + _SPEC_SQL + """SELECT run AS experiment_name, CAST(row_number() OVER (PARTITION BY run ORDER BY vec_id) AS INT)
 AS evidence_index, CAST(ordinal + 1 AS INT) AS scan_number, CAST(precursor_mz AS DOUBLE) AS precursor_mz,
 CAST(charge AS INT) AS precursor_charge FROM sp WHERE charge <= 4""",
)
def s27(spark, sf):
    path = scratch_path(spark, "columnar")
    spectra.write_spectra(_spectra(spark, sf), path, max_charge=4)
    return spark.read.parquet(path).select(
        "experiment_name", "evidence_index", "scan_number", "precursor_mz", "precursor_charge"
    )


# -- engine results -------------------------------------------------------------------

_CORE = (
    "concat(translate(CAST(part % 5 AS STRING), '01234', 'GASPV'), "
    "translate(CAST(part % 3 AS STRING), '012', 'LIK'), 'TDEK')"
)
_PRED_SQL = f"""
pr AS (SELECT concat('run_', CAST(l_orderkey % 4 AS VARCHAR)) AS run, l_orderkey AS id, min(l_partkey) AS part,
  max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2),
px AS (SELECT *, concat('controllerType=0 controllerNumber=1 scan=', CAST(id AS VARCHAR)) AS spectrum_id,
  concat(CASE part % 4 WHEN 0 THEN 'C[UNIMOD:4]' WHEN 1 THEN 'M[UNIMOD:35]' ELSE '' END, {_CORE}) AS body,
  CASE WHEN part % 4 IN (0, 1) THEN 1 ELSE 0 END AS modified, 1 + id % 3 AS charge FROM pr)
"""


def _preds(spark, sf):
    return (
        V.table(spark, sf, "lineitem")
        .groupBy(
            F.expr("concat('run_', CAST(l_orderkey % 4 AS STRING))").alias("run"),
            F.col("l_orderkey").alias("id"),
        )
        .agg(F.min("l_partkey").alias("part"), (F.max("l_quantity") / 50).alias("score"))
        .withColumns(
            {
                "title": F.expr(_TITLE.format("id")),
                "core": F.expr(_CORE),
                "z": F.expr("1 + id % 3"),
            }
        )
    )


def _pred_spectra(preds):
    ranked = rank_rows(preds, ["run"], [("id", True)], "first", "ordinal")
    return ranked.select(
        "run",
        "id",
        F.col("title").alias("spectrum_id"),
        (F.col("ordinal") - 1).cast("long").alias("ordinal"),
        F.col("id").cast("string").alias("scans"),
        (F.lit(300.25) + F.col("id") % 500).cast("double").alias("precursor_mz"),
        F.col("z").cast("int").alias("charge"),
        (F.col("id") % 900 / 10).alias("retention_time"),
        F.lit(None).cast("double").alias("ion_mobility"),
    )


def _notation(cys: str, met: str, core: str = "core"):
    return F.expr(f"concat(CASE part % 4 WHEN 0 THEN '{cys}' WHEN 1 THEN '{met}' ELSE '' END, {core})")


def _write_lines(rows, path, order):
    """Lines per run in order; a header is the line with the smallest order."""
    rows.repartitionByRange("run", order).sortWithinPartitions("run", order).select("run", "value").write.partitionBy(
        "run"
    ).text(path)


def _load(spark, sf, engine, peptide, line, header=None, extra=()):
    """Write one line per prediction in the engine's layout, then load the files."""
    preds = _preds(spark, sf)
    side = _pred_spectra(preds)
    ordinals = side.select("run", "id", "ordinal")
    rows = preds.join(ordinals, ["run", "id"]).withColumn("p", peptide)
    body = rows.select("run", "ordinal", line.alias("value"))
    if header is not None:
        top = preds.select("run").distinct()
        for i, text in enumerate(reversed(header)):
            body = body.unionByName(
                top.select("run", F.lit(-1 - i).cast("long").alias("ordinal"), F.lit(text).alias("value"))
            )
    path = scratch_path(spark, engine)
    _write_lines(body, path, "ordinal")
    out = results.load_psms(spark, engine, path, side)
    return out.select(
        "run", "spectrum_id", "engine", F.col("rank").cast("int").alias("rank"), "peptide",
        F.round("score", 6).alias("score"), F.round("precursor_mz", 4).alias("precursor_mz"),
        F.round("retention_time", 4).alias("retention_time"), *extra,
    )


def _oracle(source, extra="", peptide="concat(body, '/', CAST(charge AS VARCHAR))", where=""):
    return (
        "WITH " + _PRED_SQL + f"""SELECT run, spectrum_id, '{source}' AS engine, CAST(1 AS INT) AS rank,
 {peptide} AS peptide, round(score, 6) AS score, CAST(300.25 + id % 500 AS DOUBLE) AS precursor_mz,
 round(id % 900 / 10, 4) AS retention_time{extra} FROM px {where}"""
    )


def _tab(*cols):
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])


def _csv_line(*cols):
    return F.concat_ws(",", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols])


_PSH = "\t".join(
    ["PSH", "sequence", "PSM_ID", "search_engine", "search_engine_score[1]", "charge",
     "calc_mass_to_charge", "spectra_ref", "opt_ms_run[1]_aa_scores"]
)


def _mztab(ref):
    return F.concat(
        F.lit("PSM\t"),
        _tab("p", "ordinal", F.lit("[MS, MS:1003281, Casanovo, 4.2.0]"), "score", "z", F.lit("500.5"), ref, F.lit("0.5,0.25")),
    )


def _index_ref():
    return F.concat(F.lit("ms_run[1]:index="), F.col("ordinal").cast("string"))


@query(
    "S3_read_mztab_psm",
    "WITH " + _PRED_SQL + "SELECT run, row_number() OVER (PARTITION BY run ORDER BY id) - 1 AS reference, "
    "replace(replace(body, 'C[UNIMOD:4]', 'C+57.021'), 'M[UNIMOD:35]', 'M+15.995') AS sequence, "
    "round(score, 6) AS score FROM px",
)
def s3(spark, sf):
    preds = _preds(spark, sf)
    rows = preds.join(_pred_spectra(preds).select("run", "id", "ordinal"), ["run", "id"])
    rows = rows.withColumn("p", _notation("C+57.021", "M+15.995"))
    body = rows.select("run", "ordinal", _mztab(_index_ref()).alias("value"))
    head = preds.select("run").distinct().select("run", F.lit(-1).cast("long").alias("ordinal"), F.lit(_PSH).alias("value"))
    path = scratch_path(spark, "mztab")
    _write_lines(body.unionByName(head), path, "ordinal")
    return results.read_mztab_psm(spark, path).select(
        "run", "reference", "sequence", F.round("score", 6).alias("score")
    )


@query("S4_load_casanovo", _oracle("Casanovo4.2.0", ", CAST(0.75 AS DOUBLE) AS aa_total"))
def s4(spark, sf):
    total = F.aggregate("aa_scores", F.lit(0.0), lambda a, x: a + x).alias("aa_total")
    return _load(
        spark, sf, "casanovo", _notation("C+57.021", "M+15.995"), _mztab(_index_ref()), ["MTD\tmzTab-version\t1.0.0", _PSH],
        [total],
    )


@query("S5_load_adanovo", _oracle("AdaNovo"))
def s5(spark, sf):
    return _load(spark, sf, "adanovo", _notation("C(+57.02)", "M(+15.99)"), _mztab(_index_ref()), [_PSH])


@query("S6_load_contranovo", _oracle("ContraNovo"))
def s6(spark, sf):
    return _load(
        spark, sf, "contranovo", _notation("C+57.021", "M+15.995"), _mztab(F.col("title")), [_PSH]
    )


@query("S7_load_instanovo", _oracle("InstaNovo"))
def s7(spark, sf):
    line = _csv_line("p", "z", "score", F.lit('"[-0.1, -0.2]"'), "id")
    return _load_csv(
        spark, sf, "instanovo", _notation("C(+57.02)", "M(ox)"), line,
        "predictions,precursor_charge,log_probabilities,token_log_probabilities,scan_number",
    )


@query("S7_load_instanovo_legacy", _oracle("InstaNovo"))
def s7b(spark, sf):
    line = _csv_line("p", "score")
    return _load_csv(spark, sf, "instanovo_legacy", _notation("C(+57.02)", "M(+15.99)"), line, "preds,log_probs")


def _load_csv(spark, sf, engine, peptide, line, header, extra=()):
    """Lines of a run in several files, in order; the writer puts the header line on top of each."""
    preds = _preds(spark, sf)
    side = _pred_spectra(preds)
    rows = preds.join(side.select("run", "id", "ordinal"), ["run", "id"]).withColumn("p", peptide)
    body = rows.select("run", "ordinal", line.alias("value"))
    path = scratch_path(spark, engine)
    ordered = body.repartitionByRange("run", "ordinal").sortWithinPartitions("run", "ordinal")
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "escapeQuotes": False}
    ordered.select("run", F.col("value").alias(header)).write.partitionBy("run").options(**plain).csv(path)
    out = results.load_psms(spark, engine, path, side)
    return out.select(
        "run", "spectrum_id", "engine", F.col("rank").cast("int").alias("rank"), "peptide",
        F.round("score", 6).alias("score"), F.round("precursor_mz", 4).alias("precursor_mz"),
        F.round("retention_time", 4).alias("retention_time"), *extra,
    )


_PLUS = "concat(replace(body, 'C[UNIMOD:4]', 'C'), '/', CAST(charge AS VARCHAR))"


@query(
    "S8_load_instanovoplus",
    _oracle("InstaNovo+", ", 'casanovo' AS base_engine", _PLUS).replace("CAST(1 AS INT) AS rank", "CAST(1 + id % 2 AS INT) AS rank"),
)
def s8(spark, sf):
    line = _csv_line("title", "p", "score", "core", "z", F.expr("CAST(1 + id % 2 AS STRING)"), F.lit("casanovo"))
    return _load_csv(
        spark, sf, "instanovoplus", _notation("C(+57.02)", "M(ox)"), line,
        "specid,diffusion_predictions,diffusion_log_probabilities,transformer_predictions,precursor_charge,rank,source",
        ["base_engine"],
    )


@query("S8_load_instanovoplus_legacy", _oracle("InstaNovo+", ", 'novob' AS base_engine", _PLUS))
def s8b(spark, sf):
    line = _csv_line(F.concat("title", F.lit("||novob")), "p", "score")
    return _load_csv(
        spark, sf, "instanovoplus_legacy", _notation("C(+57.02)", "M(ox)"), line,
        "spectrum_id,predictions,log_probabilities", ["base_engine"],
    )


@query("S9_load_novob", _oracle("NovoB"))
def s9(spark, sf):
    def listed(c):
        return F.concat(F.lit("['"), c, F.lit("']"))

    line = _tab(
        F.lit("1"), "z", F.lit("800.5"), listed(F.col("p")), F.lit("0.5"), "score",
        listed(F.lit("GGGGK")), F.lit("0.1"), F.expr("CAST(score - 0.01 AS STRING)"),
        F.concat(F.lit("b'"), F.col("id").cast("string"), F.lit("'")),
    )
    return _load(spark, sf, "novob", _notation("C", "m"), line)


@query("S10_load_novor", _oracle("Novor"))
def s10(spark, sf):
    line = F.concat_ws(
        ", ", (F.col("ordinal") + 1).cast("string"), F.col("id").cast("string"), F.lit("1.0"), F.lit("500.1"),
        F.col("z").cast("string"), F.lit("999.9"), F.lit("0.01"), F.lit("1.5"), F.col("score").cast("string"),
        "p", F.lit("90-80-70,"),
    )
    head = "# id, scanNum, RT, mz(data), z, pepMass(denovo), err(data-denovo), ppm(1e6*err/(mz*z)), score, peptide, aaScore,"
    return _load(spark, sf, "novor", _notation("C(1)", "M(0)"), line, ["# preamble"] * 3 + [head])


@query("S11_load_pepnet", _oracle("PepNet"))
def s11(spark, sf):
    line = _tab("title", "p", "score", F.lit("[0.5, 0.6]"), F.lit("1.5"))
    return _load_csv(
        spark, sf, "pepnet", _notation("C", "Z"), line, "TITLE\tDENOVO\tScore\tPositional Score\tPPM Difference"
    )


@query("S12_load_pepnovo", _oracle("PepNovo+", where="WHERE id % 5 <> 0"))
def s12(spark, sf):
    """Every fifth block has no table and is dropped."""
    head = F.concat(F.lit(">> 0 "), F.col("ordinal").cast("string"), F.lit(" "), "title", F.lit(" (SQS 0.523)\n"))
    table = F.concat(
        F.lit("#Index\tRnkScr\tPnvScr\tN-Gap\tC-Gap\t[M+H]\tCharge\tSequence\n0\t"),
        _tab("score", F.lit("12.5"), F.lit("0.0"), F.lit("1.0"), F.lit("900.4"), "z", "p"),
        F.lit("\n1\t0.001\t1.0\t0.0\t0.0\t900.4\t2\tGGGGG\n"),
    )
    line = F.concat(head, F.when(F.col("id") % 5 == 0, F.lit("# No solutions found.\n")).otherwise(table))
    return _load(spark, sf, "pepnovo", _notation("C", "M+16"), line)


@query("S13_load_pihelixnovo", _oracle("pi-HelixNovo"))
def s13(spark, sf):
    return _load(spark, sf, "pihelixnovo", _notation("C+57.021", "M+15.995"), _tab("title", "p", "score"))


@query("S14_load_piprimenovo", _oracle("pi-PrimeNovo"))
def s14(spark, sf):
    return _load_csv(
        spark, sf, "piprimenovo", _notation("C[+57.021]", "M[+15.995]"), _tab("title", "p", "z", "score"),
        "label\tprediction\tcharge\tscore",
    )


@query("S15_load_deepnovo", _oracle("DeepNovo", where="WHERE id % 7 <> 0"))
def s15(spark, sf):
    p = _notation("Cmod,", "Mmod,", "concat_ws(',', split(core, ''))")
    line = _tab("id", F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.col("p")), "score")
    return _load_csv(spark, sf, "deepnovo", p, line, "scan\toutput_seq\toutput_score")


@query(
    "S16_load_spectralis",
    _oracle("Spectralis", ", 'PepNet' AS base_engine, concat(" + _CORE + ", '/', CAST(charge AS VARCHAR)) AS base_peptide, "
            "round(score / 2, 6) AS init_score"),
)
def s16(spark, sf):
    line = _csv_line(F.concat("title", F.lit("||PepNet")), "core", F.expr("CAST(score / 2 AS STRING)"), "p", "score")
    return _load_csv(
        spark, sf, "spectralis", _notation("C[UNIMOD:4]", "M[UNIMOD:35]"), line,
        "scans,peptide_init,score_init,peptide_spectralis-ea,score_spectralis-ea",
        ["base_engine", "base_peptide", F.round("init_score", 6).alias("init_score")],
    )


@query(
    "S17_load_spectralis_rescoring",
    "SELECT run, engine, CAST(rank AS INT) AS rank, count(*) AS n, round(sum(score), 3) AS total FROM psms GROUP BY 1, 2, 3",
)
def s17(spark, sf):
    path = scratch_path(spark, "rescoring")
    rows = V.psms(spark, sf).select(
        "run", "rank",
        F.concat(F.expr(_TITLE.format("spectrum_id")), F.lit("||"), "engine").alias("scans"),
        F.col("score").alias("Spectralis_score"),
    )
    rows.write.partitionBy("run", "rank").option("header", True).csv(path)
    out = results.load_spectralis_rescoring(spark, path)
    return out.groupBy("run", "engine", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total")
    )


def _db_sql(engine):
    return (
        "WITH " + _PRED_SQL + f"""SELECT run, spectrum_id, '{engine}' AS engine, body AS peptide,
 round(score, 6) AS score, 0.001::DOUBLE AS qvalue, id % 10 = 9 AS is_decoy, CAST(2 AS BIGINT) AS n_proteins,
 CAST(300.25 + id % 500 AS DOUBLE) AS precursor_mz FROM px"""
    )


def _db_loaded(spark, path, preds, engine):
    return results.load_db_search(spark, path, _pred_spectra(preds), engine).select(
        "run", "spectrum_id", "engine", "peptide", F.round("score", 6).alias("score"), "qvalue", "is_decoy",
        F.size("protein_list").cast("long").alias("n_proteins"), "precursor_mz",
    )


@query("S18_load_db_search", _db_sql("sage"))
def s18(spark, sf):
    """Sage's columns; the run stands in the file name column."""
    preds = _preds(spark, sf)
    path = scratch_path(spark, "sage")
    preds.withColumn("p", _notation("C[+57.0215]", "M[+15.9949]")).select(
        F.col("id").alias("psm_id"), F.col("p").alias("peptide"), F.lit("sp|P1|A;sp|P2|B").alias("proteins"),
        F.lit(2).alias("num_proteins"), F.concat("run", F.lit(".mgf")).alias("filename"), F.col("title").alias("scannr"),
        F.lit(1).alias("rank"), F.expr("CASE WHEN id % 10 = 9 THEN -1 ELSE 1 END").alias("label"), F.col("z").alias("charge"),
        F.col("score").alias("sage_discriminant_score"), F.lit(0.001).alias("spectrum_q"),
    ).write.option("header", True).option("sep", "\t").csv(path)
    return _db_loaded(spark, path, preds, "sage")


@query("S18_load_db_search_percolator", _db_sql("percolator"))
def s18_percolator(spark, sf):
    """Percolator's lines: decoys in files of their own, a field for each protein."""
    preds = _preds(spark, sf).withColumn("p", _notation("C[57.02147]", "M[15.99492]"))
    root = scratch_path(spark, "percolator")
    line = _tab("title", "score", F.lit("0.001"), F.lit("0.5"), F.concat(F.lit("K."), "p", F.lit(".-")), F.lit("P1"), F.lit("P2"))
    head = _tab(*[F.lit(x) for x in ("PSMId", "score", "q-value", "posterior_error_prob", "peptide", "proteinIds")])
    for decoy, kind in ((False, "targets"), (True, "decoys")):
        rows = preds.filter((F.col("id") % 10 == 9) == decoy).select("run", line.alias("value"))
        heads = preds.select("run").distinct().select("run", head.alias("value"))
        rows.unionByName(heads).write.partitionBy("run").text(f"{root}/{kind}")
    return _db_loaded(spark, f"{root}/targets", preds, "percolator").unionByName(
        _db_loaded(spark, f"{root}/decoys", preds, "percolator")
    )


# -- stored tables ----------------------------------------------------------------------


@query(
    "S20_read_psm_table",
    "SELECT run, spectrum_id, engine, rank, round(score, 6) AS score, true AS flag, CAST(2 AS BIGINT) AS n_scores FROM psms",
)
def s20(spark, sf):
    path = scratch_path(spark, "psms")
    psms = V.psms(spark, sf).withColumn(
        "metadata",
        F.create_map(
            F.lit("aa_scores"), F.lit("[0.5, 0.25]"), F.lit("PE_evidence"), F.lit("[True, False]"),
        ),
    )
    tables.write_psm_table(psms, path)
    out = tables.read_psm_table(spark, path, {"aa_scores": "array<double>", "PE_evidence": "array<boolean>"})
    return out.select(
        *J.PSM_KEY, F.round("score", 6).alias("score"), F.element_at("PE_evidence", 1).alias("flag"),
        F.size("aa_scores").cast("long").alias("n_scores"),
    )


@query(
    "S21_read_features",
    "SELECT run, spectrum_id, engine, rank, CAST(length(peptide) AS DOUBLE) AS n_residues, round(score * score, 6) AS squared FROM psms",
)
def s21(spark, sf):
    path = scratch_path(spark, "features")
    psms = V.psms(spark, sf).select(
        *J.PSM_KEY,
        F.create_map(
            F.lit("n_residues"), F.length("peptide").cast("double"), F.lit("squared"), F.round(F.col("score") * F.col("score"), 6),
            F.lit("unused"), F.lit(1.0),
        ).alias("rescoring_features"),
    )
    tables.write_features(psms, path)
    return tables.read_features(spark, path, ["n_residues", "squared"])


_PSM_ROWS = ["run", "spectrum_id", "engine", "psm_no", "peptide", "score", "rank"]
_PSM_ROWS_SQL = "SELECT run, spectrum_id, engine, psm_no, peptide, round(score, 6) AS score, rank FROM psms"


def _psm_rows(df):
    return df.select(*_PSM_ROWS).withColumn("score", F.round("score", 6))


@query("S22_read_partitions", _PSM_ROWS_SQL)
def s22(spark, sf):
    path, target = scratch_path(spark, "parts"), scratch_path(spark, "collapsed")
    V.psms(spark, sf).repartition(5).write.parquet(path)
    return _psm_rows(tables.read_partitions(spark, path, target, file_bytes=64 << 10))


@query("S23_write_psm_table", _PSM_ROWS_SQL)
def s23(spark, sf):
    path = scratch_path(spark, "psms")
    tables.write_psm_table(V.psms(spark, sf), path)
    return _psm_rows(spark.read.parquet(path))


_PROT_SQL = "SELECT protein_id, organism, sequence FROM proteins WHERE sequence <> ''"


def _fasta_proteins(spark, sf):
    return V.proteins(spark, sf).filter("sequence <> ''").select(
        F.concat(F.lit("sp|P"), F.col("protein_id").cast("string"), F.lit("|ENTRY_"), F.upper("organism")).alias("protein_id_full"),
        F.concat(F.lit("Protein number "), F.col("protein_id").cast("string")).alias("protein_description"),
        "organism",
        F.lit("GENE").alias("gene_name"),
        F.lit("1").alias("protein_existence"),
        F.lit("2").alias("sequence_version"),
        "sequence",
    )


@query(
    "S24_read_fasta",
    f"""
SELECT 'SwissProt' AS name, concat('P', CAST(protein_id AS VARCHAR)) AS protein_id,
 concat('sp|P', CAST(protein_id AS VARCHAR), '|ENTRY_', upper(organism)) AS protein_id_full,
 concat('Protein number ', CAST(protein_id AS VARCHAR)) AS protein_description, organism, 'GENE' AS gene_name,
 '1' AS protein_existence, '2' AS sequence_version, sequence FROM ({_PROT_SQL})
""",
)
def s24(spark, sf):
    path = scratch_path(spark, "fasta")
    fasta.write_fasta(_fasta_proteins(spark, sf), path)
    return fasta.read_fasta(spark, path)


@query(
    "S25_write_fasta",
    f"""
SELECT 'Other' AS kind, count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS letters FROM (
 SELECT * FROM ({_PROT_SQL}) WHERE organism = 'en')
UNION ALL SELECT 'DeNovo', count(*), CAST(sum(length(peptide)) AS BIGINT) FROM top_psms
""",
)
def s25(spark, sf):
    path = scratch_path(spark, "fasta")
    some = _fasta_proteins(spark, sf).filter("organism = 'en'")
    fasta.write_fasta(some, path, V.top_psms(spark, sf))
    back = fasta.read_fasta(spark, path)
    kind = F.when(F.col("name") == "DeNovo", "DeNovo").otherwise("Other").alias("kind")
    return back.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("letters"))


def _with_peaks(spark, sf):
    """Ground-truth spectra with two peaks each."""
    preds = _preds(spark, sf)
    return _pred_spectra(preds).withColumns(
        {
            "mz": F.expr("array(CAST(100.5 AS DOUBLE), CAST(200.25 AS DOUBLE))"),
            "intensity": F.expr("array(CAST(10 AS DOUBLE), CAST(id % 7 AS DOUBLE))"),
        }
    )


def _titled(psms):
    return psms.withColumn("spectrum_id", F.expr(_TITLE.format("spectrum_id")))


@query(
    "S26_write_annotated_mgf",
    """
SELECT run, concat('controllerType=0 controllerNumber=1 scan=', CAST(spectrum_id AS VARCHAR)) AS spectrum_id,
 concat('controllerType=0 controllerNumber=1 scan=', CAST(spectrum_id AS VARCHAR), '||',
  array_to_string(list(engine ORDER BY engine), '|')) AS scans, peptide AS seq FROM psms
GROUP BY run, psms.spectrum_id, peptide
""",
)
def s26(spark, sf):
    path = scratch_path(spark, "annotated")
    grouped = S.group_engines(_titled(V.psms(spark, sf)))
    tables.write_annotated_mgf(_with_peaks(spark, sf), grouped, path, compression="gzip")  # the text is larger than the tables
    return spectra.read_mgf(spark, path).select("run", "spectrum_id", "scans", "seq")


@query(
    "S28_write_refiner_input",
    """
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY concat('controllerType=0 controllerNumber=1 scan=',
  CAST(spectrum_id AS VARCHAR)), rank) - 1 AS INT) AS scan_number,
 concat('controllerType=0 controllerNumber=1 scan=', CAST(spectrum_id AS VARCHAR), '||engine_0') AS title,
 peptide AS sequence, array_to_string(string_split(peptide, ''), ' ') AS tokens,
 CAST(2 AS INT) AS precursor_charge FROM psms WHERE engine = 'engine_0'
""",
)
def s28(spark, sf):
    path = scratch_path(spark, "refiner")
    psms = _titled(V.psms(spark, sf).filter("engine = 'engine_0'")).withColumn(
        "peptide", F.concat("peptide", F.lit("/2"))
    )
    tables.write_refiner_input(tables.refiner_input(psms, _with_peaks(spark, sf), "engine_0"), path)
    return spark.read.parquet(path).select(
        "run", "scan_number", "title", "sequence",
        F.array_join("predictions_tokenised", " ").alias("tokens"), "precursor_charge",
    )


@query(
    "S28_write_refiner_input_merged",
    """
SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY engine, concat('controllerType=0 controllerNumber=1 scan=',
  CAST(spectrum_id AS VARCHAR)), rank) - 1 AS INT) AS index,
 concat('controllerType=0 controllerNumber=1 scan=', CAST(spectrum_id AS VARCHAR), '||', engine) AS title,
 peptide AS sequence, peptide AS modified_sequence FROM psms
""",
)
def s28b(spark, sf):
    psms = _titled(V.psms(spark, sf)).withColumn("peptide", F.concat("peptide", F.lit("/2")))
    out = tables.refiner_input_merged(psms, _with_peaks(spark, sf))
    return out.select("run", "index", "title", "sequence", "modified_sequence")


@query(
    "S29_write_refiner_mgf_by_rank",
    """
SELECT run, CAST(rank AS INT) AS rank, concat('controllerType=0 controllerNumber=1 scan=', CAST(spectrum_id AS VARCHAR),
 '||', engine) AS scans, peptide AS seq FROM psms
""",
)
def s29(spark, sf):
    path = scratch_path(spark, "by_rank")
    tables.write_by_rank(_with_peaks(spark, sf), _titled(V.psms(spark, sf)), path)
    out = spectra.blocks(spark, path, "END IONS").filter(F.col("value").contains("BEGIN IONS"))
    return out.select(
        "run", F.regexp_extract(F.col("_place.file"), r"rank=(\d+)", 1).cast("int").alias("rank"),
        F.regexp_extract("value", r"(?m)^SCANS=(.*)$", 1).alias("scans"),
        F.regexp_extract("value", r"(?m)^SEQ=(.*)$", 1).alias("seq"),
    )


@query(
    "S30_write_pin",
    "SELECT concat(run, '_', CAST(spectrum_id AS VARCHAR), '_', engine, '_', CAST(rank AS VARCHAR)) AS \"SpecId\", "
    "CASE WHEN protein LIKE 'rev%' THEN -1 ELSE 1 END AS \"Label\", spectrum_id AS \"ScanNr\", round(score, 6) AS score, "
    "peptide AS \"Peptide\", protein AS \"Proteins\" FROM psms",
)
def s30(spark, sf):
    path = scratch_path(spark, "pin")
    psms = V.psms(spark, sf).withColumns(
        {"is_decoy": F.col("protein").startswith("rev"), "protein_list": F.array("protein")}
    )
    tables.write_pin(psms, path, ["score"])
    schema = "SpecId string, Label int, ScanNr long, score double, Peptide string, Proteins string"
    out = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    return out.withColumn("score", F.round("score", 6))


@query(
    "S31_run_manifest",
    """
SELECT concat('f', CAST(o_custkey AS VARCHAR)) AS run, arg_min(p, length(p) * 1e9 + o_orderkey) FILTER (WHERE s) AS spectrum_path,
 arg_min(p, length(p) * 1e9 + o_orderkey) FILTER (WHERE NOT s) AS result_path FROM (
 SELECT o_custkey, o_orderkey, o_orderkey % 3 = 0 AS s, concat('/data/f', CAST(o_custkey AS VARCHAR), '.x',
  lpad(CAST(o_orderkey AS VARCHAR), 8 + CAST(o_orderkey % 2 AS INT), '0'), CASE WHEN o_orderkey % 3 = 0 THEN '.mgf' ELSE '.csv' END) AS p
 FROM orders) GROUP BY 1 HAVING count(*) FILTER (WHERE s) > 0 AND count(*) FILTER (WHERE NOT s) > 0
""",
)
def s31(spark, sf):
    files = V.table(spark, sf, "orders").selectExpr(
        "concat('/data/f', CAST(o_custkey AS STRING), '.x', lpad(CAST(o_orderkey AS STRING), 8 + CAST(o_orderkey % 2 AS INT), '0'), "
        "CASE WHEN o_orderkey % 3 = 0 THEN '.mgf' ELSE '.csv' END) AS path"
    )
    return tables.run_manifest(files)


_REGISTERED = ["casanovo", "instanovo", "novor", "pepnet", "pepnovo", "spectralis"]


@query(
    "S19_engine_registry",
    """
SELECT run, engine, source, concat('/results/', engine, '/', run, '.', engine, ext) AS path, n_spectra
FROM (SELECT run, count(*) AS n_spectra FROM gt GROUP BY 1), (VALUES ('casanovo', 'Casanovo4.2.0', '.mztab'),
 ('instanovo', 'InstaNovo', '.csv'), ('novor', 'Novor', '.csv'), ('pepnet', 'PepNet', '.tsv'),
 ('pepnovo', 'PepNovo+', '.mgf.out'), ('spectralis', 'Spectralis', '.csv')) t(engine, source, ext)
""",
)
def s19(spark, sf):
    """Expected result file of every run for each registered engine."""
    runs = V.gt(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n_spectra"))
    paths = tables.result_paths(runs, "/results", _REGISTERED)
    sources = F.create_map(
        *[F.lit(x) for e in _REGISTERED for x in (e, results.engine_spec(e).source)]
    )
    return paths.join(runs, "run").withColumn("source", F.element_at(sources, F.col("engine")))
