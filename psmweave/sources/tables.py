"""Stored PSM and feature tables, sinks for downstream tools, run manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave.constants import RESULT_EXTENSION
from psmweave.functions import peptide as P
from psmweave.sources.spectra import write_mgf


def write_psm_table(psms: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """PSMs as parquet, partitioned by run and engine."""
    psms.write.mode(mode).partitionBy("run", "engine").parquet(path)


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features as typed columns, so that a reader touches only the ones it needs."""
    features.write.mode(mode).partitionBy("run", "engine").parquet(path)


def read_psm_table(
    spark: SparkSession, path: str, metadata: dict[str, str] | None = None
) -> DataFrame:
    """Stored PSMs; listed entries of a legacy string map become typed columns.

    ``metadata`` maps an entry to its Spark type, read as JSON where it is not a scalar.
    """
    df = spark.read.parquet(path)
    for name, kind in (metadata or {}).items():
        text = F.element_at("metadata", name)
        if kind.startswith(("array", "map", "struct")):
            # Legacy lists are Python text: True/False and quotes differ from JSON.
            json = F.regexp_replace(F.regexp_replace(text, "True|true", "true"), "False|false", "false")
            value = F.from_json(F.translate(json, "'", '"'), kind)
        else:
            value = text.try_cast(kind)
        df = df.withColumn(name, value)
    return df.drop("metadata") if metadata and "metadata" in df.columns else df


def read_features(
    spark: SparkSession, path: str, names: Sequence[str], key: Sequence[str] = ("run", "spectrum_id", "engine", "rank")
) -> DataFrame:
    """Declared features per PSM; legacy maps are unpacked, columns are pruned."""
    df = spark.read.parquet(path)
    if "rescoring_features" in df.columns:
        return df.select(*key, *[F.element_at("rescoring_features", n).alias(n) for n in names])
    return df.select(*key, *names)


#: Size that rewritten files should have.
FILE_BYTES = 256 << 20


def read_partitions(
    spark: SparkSession, pattern: str, target: str | None = None, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Many partition files as one table, optionally rewritten as files of about ``file_bytes``.

    The number of files follows from the sizes of those there are; whole ones are put together by as many
    tasks, without a shuffle. Files larger than that are left to Spark's own splits.
    """
    df = spark.read.option("mergeSchema", True).parquet(pattern)
    if target is None:
        return df
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    size = listed.load(pattern).agg(F.sum("length")).first()[0] or 0  # lists the files, reads none
    df.coalesce(max(1, -(-size // file_bytes))).write.parquet(target)
    return spark.read.parquet(target)


def write_pin(
    psms: DataFrame, path: str, features: Sequence[str], key: Sequence[str] = ("run", "spectrum_id", "engine", "rank")
) -> None:
    """Percolator input: id, label, scan, features, peptide, proteins."""
    proteins = F.array_join("protein_list", "\t") if "protein_list" in psms.columns else F.lit("")
    psms.select(
        F.concat_ws("_", *[F.col(k).cast("string") for k in key]).alias("SpecId"),
        F.when(F.col("is_decoy"), -1).otherwise(1).alias("Label"),
        F.coalesce(
            F.regexp_extract(F.col("spectrum_id").cast("string"), r"scan=(\d+)", 1).try_cast("long"),
            F.col("spectrum_id").try_cast("long"),
        ).alias("ScanNr"),
        *features,
        F.col("peptide").alias("Peptide"),
        proteins.alias("Proteins"),
    ).write.option("sep", "\t").option("header", True).csv(path)


def annotated_spectra(spectra: DataFrame, grouped: DataFrame) -> DataFrame:
    """Spectra repeated per grouped prediction, scans = composite title, with the refiner's
    peptide in ``seq`` (S26).  ``grouped`` comes from ``group_engines``.
    """
    preds = grouped.select("run", "spectrum_id", "title", P.to_spectralis("peptide").alias("seq"))
    return (
        spectra.drop("seq", "scans")
        .join(preds, ["run", "spectrum_id"])
        .withColumnRenamed("title", "scans")
    )


def write_annotated_mgf(spectra: DataFrame, grouped: DataFrame, path: str, compression: str | None = None) -> None:
    """Annotated spectra as MGF."""
    write_mgf(annotated_spectra(spectra, grouped), path, seq=F.col("seq"), compression=compression)


def refiner_input(psms: DataFrame, spectra: DataFrame, engine: str) -> DataFrame:
    """Spectra with initial predictions for the diffusion refiner.

    Peptides with unsupported modifications are dropped; ``scan_number`` numbers the rows
    of a run.  Titles carry the engine behind two bars.
    """
    from psmweave.operators.running import rank_rows

    rows = (
        psms.withColumn("sequence", P.drop_unsupported_mods("peptide"))
        .withColumn("precursor_charge", P.charge_of("peptide"))
        .filter("sequence IS NOT NULL")
        .drop("precursor_mz")
        .join(spectra.select("run", "spectrum_id", "precursor_mz", "mz", "intensity"), ["run", "spectrum_id"])
    )
    numbered = rank_rows(rows, ["run"], [("spectrum_id", True), ("rank", True)], "first", "scan_number")
    return numbered.select(
        "run",
        (F.col("scan_number") - 1).alias("scan_number"),
        F.col("spectrum_id").cast("string").alias("specid"),
        F.concat(F.col("spectrum_id").cast("string"), F.lit(f"||{engine}")).alias("title"),
        "rank",
        "sequence",
        F.transform(P.refiner_tokens("sequence"), lambda t: t).alias("predictions_tokenised"),
        "precursor_mz",
        "precursor_charge",
        F.col("mz").alias("mz_array"),
        F.col("intensity").alias("intensity_array"),
    )


def refiner_input_merged(psms: DataFrame, spectra: DataFrame) -> DataFrame:
    """Older layout: several engines in one table, index to title map in the same rows."""
    parts = (
        psms.withColumn("modified_sequence", P.to_refiner_notation("peptide"))
        .filter("modified_sequence IS NOT NULL")
        .drop("precursor_mz")
        .join(spectra.select("run", "spectrum_id", "precursor_mz", "mz", "intensity"), ["run", "spectrum_id"])
    )
    from psmweave.operators.running import rank_rows

    order = [("engine", True), ("spectrum_id", True), ("rank", True)]
    numbered = rank_rows(parts, ["run"], order, "first", "index")
    return numbered.select(
        "run",
        (F.col("index") - 1).alias("index"),
        F.concat(F.col("spectrum_id").cast("string"), F.lit("||"), F.col("engine")).alias("title"),
        P.letters("peptide").alias("sequence"),
        "modified_sequence",
        "precursor_mz",
        P.charge_of("peptide").alias("precursor_charge"),
        F.col("mz").alias("mz_array"),
        F.col("intensity").alias("intensity_array"),
    )


def write_refiner_input(table: DataFrame, path: str) -> None:
    table.write.partitionBy("run").parquet(path)


def write_by_rank(spectra: DataFrame, psms: DataFrame, path: str) -> None:
    """One folder of annotated spectra per run and rank."""
    from psmweave.sources.spectra import mgf_text

    rows = spectra.drop("seq", "scans").join(
        psms.select(
            "run", "spectrum_id", "rank",
            F.concat(F.col("spectrum_id").cast("string"), F.lit("||"), F.col("engine")).alias("scans"),
            P.to_spectralis("peptide").alias("seq"),
        ),
        ["run", "spectrum_id"],
    )
    rows.select("run", "rank", mgf_text(F.col("seq")).alias("value")).write.partitionBy("run", "rank").text(path)


def run_manifest(files: DataFrame, spectrum_extension: str = "mgf") -> DataFrame:
    """Spectrum and result file per run; incomplete pairs are left out.

    ``files`` has ``path``.  Of several matches the shortest name wins.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    base = F.substring_index(name, ".", 1)
    is_spectrum: Column = name.endswith("." + spectrum_extension)
    shortest = F.struct(F.length("path").alias("n"), F.col("path").alias("path"))
    return (
        files.groupBy(base.alias("run"))
        .agg(
            F.min(F.when(is_spectrum, shortest))["path"].alias("spectrum_path"),
            F.min(F.when(~is_spectrum, shortest))["path"].alias("result_path"),
        )
        .filter("spectrum_path IS NOT NULL AND result_path IS NOT NULL")
    )


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths only; file contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")


def result_paths(runs: DataFrame, root: str, engines: Sequence[str]) -> DataFrame:
    """Expected result path per run and engine."""
    known = F.array(
        *[F.struct(F.lit(e).alias("engine"), F.lit(RESULT_EXTENSION[e]).alias("ext")) for e in engines]
    )
    return runs.select("run", F.inline(known)).select(
        "run", "engine", F.concat(F.lit(root + "/"), "engine", F.lit("/"), "run", F.lit("."), "engine", "ext").alias("path")
    )
