"""Result files of the sequencing engines, read by one specification per engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave import constants as K
from psmweave.functions import peptide as P
from psmweave.operators.filters import best_of_two
from psmweave.operators.joins import infer_rank, join_by_key, zip_positional
from psmweave.operators.windows import rank_in_spectrum
from psmweave.sources.files import blocks, lines, locate, number, run_of, with_ordinal


@dataclass
class EngineSpec:
    """How one engine's file becomes PSMs.

    ``columns`` maps result expressions to ``peptide, score, charge, aa_scores, ...``;
    a missing ``charge`` is taken from the spectrum.  ``key`` joins with the spectra.
    """

    source: str
    read: Callable[[SparkSession, str], DataFrame]
    columns: dict[str, str]
    key: str = "spectrum_id"
    mapping: str = ""
    rank: str = "dense"  # dense by score, file order, given, or one
    require_all: bool = False
    extras: list[str] = field(default_factory=list)


def _csv(header: bool = True, sep: str = ","):
    def read(spark: SparkSession, path: str) -> DataFrame:
        reader = spark.read.option("header", header).option("sep", sep).option("escape", '"')
        return locate(reader.csv(path))

    return read


#: Result files up to which their header lines, one each, are sent to every executor.
MAX_SENT_HEADERS = 10_000


def _table_with_header(rows: DataFrame, header: DataFrame, sep: str) -> DataFrame:
    """Rows of delimited text as a map, named by the header line of their own run.

    There are no more headers than files, whose number is known without reading them; with few files
    the headers go to the rows, so that no row moves to its run's header.
    """
    names = header.groupBy("run").agg(F.min("value").alias("_h"))
    if len(header.inputFiles()) <= MAX_SENT_HEADERS:
        names = F.broadcast(names)
    split = lambda c: F.transform(F.split(c, sep), lambda x: F.trim(x))
    zipped = F.zip_with(split(F.col("_h")), split(F.col("value")), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    named = F.filter(zipped, lambda e: e["k"].isNotNull() & (e["k"] != "") & e["v"].isNotNull())
    return rows.join(names, "run").withColumn("f", F.map_from_entries(named))


def read_mztab_psm(spark: SparkSession, path: str) -> DataFrame:
    """PSM section of mzTab files, one map of columns per PSM (S3)."""
    text = lines(spark, path).filter(F.substring("value", 1, 3).isin("PSH", "PSM"))
    header = text.filter(F.col("value").startswith("PSH")).select("run", "value")
    rows = text.filter(F.col("value").startswith("PSM"))
    out = _table_with_header(rows, header, "\t")
    return out.select(
        "run",
        "_place",
        F.col("f")["PSM_ID"].alias("psm_id"),
        F.col("f")["sequence"].alias("sequence"),
        number(F.col("f")["charge"]).cast("int").alias("charge"),
        number(F.col("f")["search_engine_score[1]"]).alias("score"),
        F.col("f")["search_engine"].alias("search_engine"),
        F.col("f")["spectra_ref"].alias("spectra_ref"),
        number(F.col("f")["calc_mass_to_charge"]).alias("calc_mass_to_charge"),
        F.col("f")["opt_ms_run[1]_aa_scores"].alias("aa_scores"),
        F.element_at(F.split("spectra_ref", "="), -1).try_cast("long").alias("reference"),
    ).withColumn("ordinal", F.col("reference"))


def _read_novob(spark: SparkSession, path: str) -> DataFrame:
    names = [
        "mcount", "charge", "peptide_mass", "sequence_forward", "mass_forward", "probability_forward",
        "sequence_reverse", "mass_reverse", "probability_reverse", "scans",
    ]
    rows = locate(
        spark.read.option("sep", "\t").option("quote", "").schema(", ".join(f"{n} string" for n in names)).csv(path)
    )
    numeric = {n: number(F.col(n)) for n in names if n.startswith(("mass", "prob"))}
    text = {
        f"sequence_{d}": F.regexp_extract(f"sequence_{d}", r"['\"]([^'\"]*)['\"]", 1)
        for d in ("forward", "reverse")
    }
    plain = rows.withColumns({**numeric, **text}).withColumn(
        "scans", F.regexp_replace("scans", r"^b['\"](.*)['\"]$", "$1")
    )
    return best_of_two(plain, ["sequence", "mass", "probability"])


def _read_novor(spark: SparkSession, path: str) -> DataFrame:
    text = lines(spark, path)
    header = text.filter(F.col("value").startswith("# id")).select("run", "value")
    rows = text.filter(F.col("value").rlike(r"^\d+\s*,"))
    out = _table_with_header(rows, header, ",")
    f = F.col("f")
    return out.select(
        "run",
        "_place",
        (number(f["# id"], "long") - 1).alias("ordinal"),
        f["scanNum"].alias("scans"),
        number(f["z"]).cast("int").alias("z"),
        f["peptide"].alias("peptide"),
        number(f["score"]).alias("score"),
        number(f["err(data-denovo)"]).alias("err"),
        number(f["ppm(1e6*err/(mz*z))"]).alias("ppm_error"),
        f["aaScore"].alias("aaScore"),
    )


def _read_pepnovo(spark: SparkSession, path: str) -> DataFrame:
    """First candidate of every block that has a table."""
    rows = blocks(spark, path, ">>")
    part = F.split(F.trim(F.col("value")), r"\r?\n")
    head = F.get(part, F.lit(0))
    # A head is "file scan title", and perhaps "(SQS quality)" behind it.
    words = F.split(F.trim(head), r"\s+", 3)
    titled = F.get(words, F.lit(2))
    rated = F.split(titled, r"\s+\((?=SQS )")
    table = rows.filter(F.get(part, F.lit(1)).startswith("#Index") & (F.size(part) > 2))
    cells = F.split(F.trim(F.get(part, F.lit(2))), "\t")
    return table.select(
        "run",
        "_place",
        rated[0].alias("spectrum_id"),
        F.get(words, F.lit(1)).alias("scan_in_head"),
        F.coalesce(F.rtrim(F.get(rated, F.lit(1)), F.lit(")")), F.lit("")).alias("sqs"),
        number(F.get(cells, F.lit(1))).alias("score"),
        F.get(cells, F.lit(2)).alias("score_pepnovo"),
        number(F.get(cells, F.lit(3))).alias("n_shift"),
        number(F.get(cells, F.lit(4))).alias("c_shift"),
        number(F.get(cells, F.lit(6))).cast("int").alias("charge"),
        F.get(cells, F.lit(7)).alias("peptide"),
    )


def _read_headless(names: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        return locate(spark.read.option("sep", "\t").schema(names).csv(path))

    return read


def _title_engine(read, column: str):
    def run(spark: SparkSession, path: str) -> DataFrame:
        rows = read(spark, path)
        parts = F.split(column, r"\|\|")
        return rows.withColumns(
            {"spectrum_id": F.get(parts, F.lit(0)), "base_engine": F.get(parts, F.lit(1))}
        )

    return run


def _instanovo(spark: SparkSession, path: str) -> DataFrame:
    return with_ordinal(_csv()(spark, path))


# The label of a result file selects its specification.
ENGINES: dict[str, EngineSpec] = {
    "casanovo": EngineSpec(
        "Casanovo4.2.0", read_mztab_psm,
        {"peptide": "sequence", "score": "score", "charge": "charge", "aa_scores": "aa_scores"},
        key="ordinal", mapping="casanovo",
    ),
    "adanovo": EngineSpec(
        "AdaNovo", read_mztab_psm,
        {"peptide": "sequence", "score": "score", "charge": "charge", "aa_scores": "aa_scores"},
        key="ordinal", mapping="adanovo",
    ),
    "contranovo": EngineSpec(
        "ContraNovo",
        lambda spark, path: read_mztab_psm(spark, path).withColumn("spectrum_id", F.col("spectra_ref")),
        {"peptide": "sequence", "score": "score", "charge": "charge", "aa_scores": "aa_scores"},
        mapping="contranovo", require_all=True,
    ),
    "instanovo": EngineSpec(
        "InstaNovo", _instanovo,
        {"peptide": "predictions", "score": "log_probabilities", "charge": "precursor_charge",
         "aa_scores": "token_log_probabilities"},
        key="position", mapping="instanovo",
    ),
    "instanovo_legacy": EngineSpec(
        "InstaNovo", _instanovo, {"peptide": "preds", "score": "log_probs"},
        key="position", mapping="instanovo",
    ),
    "instanovoplus": EngineSpec(
        "InstaNovo+",
        lambda spark, path: _csv()(spark, path).withColumn("spectrum_id", F.col("specid")),
        {"peptide": "diffusion_predictions", "score": "diffusion_log_probabilities",
         "charge": "precursor_charge", "rank": "rank", "base_engine": "source",
         "base_peptide": "concat(transformer_predictions, '/', CAST(precursor_charge AS INT))"},
        mapping="instanovoplus", rank="given", require_all=True,
        extras=["base_engine", "base_peptide"],
    ),
    "instanovoplus_legacy": EngineSpec(
        "InstaNovo+", _title_engine(_csv(), "spectrum_id"),
        {"peptide": "predictions", "score": "log_probabilities", "base_engine": "base_engine"},
        mapping="instanovoplus", rank="file", require_all=True, extras=["base_engine"],
    ),
    "novob": EngineSpec(
        "NovoB", _read_novob,
        {"peptide": "sequence", "score": "probability", "charge": "charge", "ppm_error": "mass"},
        key="scans", mapping="novob", rank="one", require_all=True, extras=["ppm_error"],
    ),
    "novor": EngineSpec(
        "Novor", _read_novor,
        {"peptide": "peptide", "score": "score", "charge": "z", "aa_scores": "aaScore",
         "ppm_error": "ppm_error"},
        key="ordinal", mapping="novor", rank="one", require_all=True, extras=["ppm_error"],
    ),
    "pepnet": EngineSpec(
        "PepNet",
        lambda spark, path: _csv(sep="\t")(spark, path).withColumn("spectrum_id", F.col("TITLE")),
        {"peptide": "DENOVO", "score": "Score", "aa_scores": "`Positional Score`",
         "ppm_error": "CAST(`PPM Difference` AS DOUBLE)"},
        mapping="pepnet", require_all=True, extras=["ppm_error"],
    ),
    "pepnovo": EngineSpec(
        "PepNovo+", _read_pepnovo,
        {"peptide": "peptide", "score": "score", "charge": "charge", "aa_scores": "score_pepnovo",
         "n_shift": "n_shift", "c_shift": "c_shift"},
        mapping="pepnovo", rank="one", require_all=True, extras=["n_shift", "c_shift"],
    ),
    "pihelixnovo": EngineSpec(
        "pi-HelixNovo", _read_headless("spectrum_id string, prediction string, score string"),
        {"peptide": "prediction", "score": "score"}, mapping="pihelixnovo",
    ),
    "piprimenovo": EngineSpec(
        "pi-PrimeNovo",
        lambda spark, path: _csv(sep="\t")(spark, path).withColumn("spectrum_id", F.col("label")),
        {"peptide": "prediction", "score": "score", "charge": "charge"}, mapping="piprimenovo",
    ),
    "deepnovo": EngineSpec(
        "DeepNovo",
        lambda spark, path: _csv(sep="\t")(spark, path)
        .filter("output_seq IS NOT NULL")
        .withColumn("scans", F.col("scan")),
        {"peptide": "replace(output_seq, ',', '')", "score": "output_score"},
        key="scans", mapping="deepnovo",
    ),
    "spectralis": EngineSpec(
        "Spectralis", _title_engine(_csv(), "scans"),
        {"peptide": "`peptide_spectralis-ea`", "score": "`score_spectralis-ea`",
         "base_engine": "base_engine", "base_peptide": "peptide_init",
         "init_score": "CAST(score_init AS DOUBLE)"},
        mapping="spectralis", rank="file", require_all=True,
        extras=["base_engine", "base_peptide", "init_score"],
    ),
}

PSM_COLUMNS = [
    "run", "spectrum_id", "engine", "rank", "peptide", "charge", "score", "aa_scores",
    "precursor_mz", "retention_time", "ion_mobility",
]


def engine_spec(label: str) -> EngineSpec:
    """Specification of an engine label; an unknown label is an error."""
    try:
        return ENGINES[label]
    except KeyError:
        raise ValueError(f"unknown engine {label!r}; known: {', '.join(sorted(ENGINES))}") from None


def parse_scores(text: Column) -> Column:
    """Residue scores from list text such as ``[0.1, 0.2]``, ``0.1,0.2`` or ``90-80``."""
    clean = F.regexp_replace(text.cast("string"), r"[\[\]\s]", "")
    numbers = F.regexp_extract_all(clean, F.lit(r"(-?\d+\.?\d*(?:[eE][+-]?\d+)?)"), F.lit(1))
    # Integers joined by dashes are separate scores, not signs.
    dashed = F.split(clean, "-").cast("array<double>")
    return F.when(clean.rlike(r"^\d+(-\d+)+$"), dashed).otherwise(numbers.cast("array<double>"))


def load_psms(
    spark: SparkSession,
    engine: str,
    path: str,
    spectra: DataFrame,
    max_length: int = 30,
    max_charge: int = 6,
) -> DataFrame:
    """Result files of one engine as PSMs.

    Read, join with the spectra, normalise and validate the peptide, rank.  ``spectra``
    has the columns of ``read_mgf``; ``path`` may be a folder of many runs.
    """
    spec = engine_spec(engine)
    raw = spec.read(spark, path)
    cols = {name: F.expr(expr) for name, expr in spec.columns.items()}
    key = "ordinal" if spec.key == "position" else spec.key
    results = raw.select("run", "_place", F.col(key), *[c.alias(f"r_{n}") for n, c in cols.items()])
    info = ["run", "spectrum_id", "ordinal", "scans", "precursor_mz", "charge", "retention_time", "ion_mobility"]
    side = spectra.select(*info)
    if spec.key == "position":
        joined = zip_positional(results, side)
    else:
        joined = join_by_key(results, side, ["run", key], spec.require_all)
    charge = (
        F.coalesce(F.col("r_charge").cast("double").cast("int")) if "charge" in cols else F.col("charge")
    )

    def proforma(name: str) -> Column:
        text = F.concat(F.coalesce(F.col(name), F.lit("nan")), F.lit("/"), charge.cast("string"))
        return P.normalise_peptide(text, spec.mapping)

    rows = joined.withColumn("peptide", proforma("r_peptide"))
    rows = rows.filter(P.is_valid_peptide("peptide", max_length, max_charge))
    rows = rows.withColumns(
        {
            "score": F.col("r_score").cast("double"),
            "charge": charge,
            "engine": F.lit(spec.source),
            "aa_scores": parse_scores(F.col("r_aa_scores")) if "aa_scores" in cols else F.lit(None).cast("array<double>"),
        }
    )
    if spec.rank == "dense":
        rows = rank_in_spectrum(rows)
    elif spec.rank == "file":
        rows = infer_rank(rows, "_place")
    elif spec.rank == "given":
        rows = rows.withColumn("rank", F.col("r_rank").cast("double").cast("int"))
    else:
        rows = rows.withColumn("rank", F.lit(1))
    if engine == "spectralis":
        rows = rows.withColumn("r_base_peptide", proforma("r_base_peptide"))
    return rows.select(*PSM_COLUMNS, *[F.col(f"r_{e}").alias(e) for e in spec.extras])


def load_spectralis_rescoring(spark: SparkSession, pattern: str) -> DataFrame:
    """Rescored candidates, one file ``<run>_<rank>.*.csv`` per rank.

    Folders ``run=<run>/rank=<rank>`` are understood as well.
    """
    raw = spark.read.option("header", True).csv(pattern)
    rows = locate(raw)
    file = F.col("_place.file")
    folder = F.regexp_extract(file, r"/rank=(\d+)/", 1)
    named = r"([^/]+)_(\d+)\.[^/]*$"
    parts = F.split("scans", r"\|\|")
    return rows.select(
        F.when(folder != "", F.col("run")).otherwise(F.regexp_extract(file, named, 1)).alias("run"),
        F.get(parts, F.lit(0)).alias("spectrum_id"),
        F.get(parts, F.lit(1)).alias("engine"),
        F.when(folder != "", folder).otherwise(F.regexp_extract(file, named, 2)).cast("int").alias("rank"),
        F.col("Spectralis_score").cast("double").alias("score"),
    )


def _read_sage(spark: SparkSession, path: str) -> DataFrame:
    """Sage's results: the run is in ``filename``, decoys have label -1."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.select(
        run_of(F.concat(F.lit("/"), F.col("filename"))).alias("run"),
        F.col("scannr").alias("spectrum_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("peptide").alias("peptidoform"),
        number(F.col("sage_discriminant_score")).alias("score"),
        number(F.col("spectrum_q")).alias("qvalue"),
        (F.col("label") == "-1").alias("is_decoy"),
        F.split("proteins", ";").alias("protein_list"),
    )


def _read_percolator(spark: SparkSession, path: str) -> DataFrame:
    """Percolator's results: every field behind the peptide is a protein; decoys have files, or folders
    of files, of their own with ``decoy`` in the name.

    Peptides stand between the residues that flank them in the protein.
    """
    text = lines(spark, path).filter(~F.col("value").startswith("PSMId\t") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    file = F.regexp_extract("_place.file", r"[^/]*decoy[^/]*(/run=[^/]*)?(/part-[^/]*)?$", 0)
    return text.select(
        "run",
        f[0].alias("spectrum_id"),
        F.lit(1).alias("rank"),
        F.regexp_replace(f[4], r"^[A-Z-]\.|\.[A-Z-]$", "").alias("peptidoform"),
        number(f[1]).alias("score"),
        number(f[2]).alias("qvalue"),
        (file != "").alias("is_decoy"),
        F.slice(f, F.lit(6), F.greatest(F.size(f) - 5, F.lit(0))).alias("protein_list"),
    )


def _read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A table of this library: spectrum_id, peptidoform, score, qvalue, is_decoy, protein_list, rank."""
    return spark.read.parquet(path)


DB_SEARCHES = {"sage": _read_sage, "percolator": _read_percolator, "parquet": _read_stored}


def load_db_search(
    spark: SparkSession, path: str, spectra: DataFrame, label: str = "sage", max_length: int = 30
) -> DataFrame:
    """Results of a database search with the spectra's precursor (S18); ``label`` names the layout."""
    if label not in DB_SEARCHES:
        raise ValueError(f"unknown database search {label}; known: {', '.join(DB_SEARCHES)}")
    typed = (
        DB_SEARCHES[label](spark, path)
        .select(
            "run", "spectrum_id", F.lit(label).alias("engine"), F.col("rank").cast("int").alias("rank"),
            P.replace_all("peptidoform", K.ENGINE_MODIFICATIONS.get(label, [])).alias("peptide"),
            "score", "qvalue", "is_decoy", "protein_list",
        )
        .filter(F.length(P.letters("peptide")) <= max_length)
    )
    return join_by_key(
        typed, spectra.select("run", "spectrum_id", "precursor_mz", "retention_time"), ["run", "spectrum_id"], True
    )
