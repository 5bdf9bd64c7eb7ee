"""Spectrum files: MGF text and mzML."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psmweave import constants as K
from psmweave.functions import peptide as P
from psmweave.sources.files import blocks, locate, number, with_ordinal

_PEAK = r"(?m)^\s*(\d[\d.eE+-]*)[ \t]+(\d[\d.eE+-]*)"


def _field(name: str) -> Column:
    text = F.regexp_extract("value", rf"(?mi)^{name}=([^\r\n]*)", 1)
    return F.when(text != "", F.trim(text))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF entries as a spectra table.

    Retention time is in minutes; a missing charge stays null.
    """
    entries = blocks(spark, path, "END IONS").filter(F.col("value").contains("BEGIN IONS"))
    mass = F.split(_field("PEPMASS"), r"\s+")
    parsed = with_ordinal(entries).select(
        "run",
        "ordinal",
        _field("TITLE").alias("spectrum_id"),
        _field("SCANS").alias("scans"),
        number(F.get(mass, F.lit(0))).alias("precursor_mz"),
        number(F.try_element_at(mass, F.lit(2))).alias("precursor_intensity"),
        F.regexp_extract(_field("CHARGE"), r"(\d+)", 1).try_cast("int").alias("charge"),
        (number(_field("RTINSECONDS")) / 60).alias("retention_time"),
        number(_field("ION_MOBILITY")).alias("ion_mobility"),
        _field("SEQ").alias("seq"),
        F.regexp_extract_all("value", F.lit(_PEAK), F.lit(1)).cast("array<double>").alias("mz"),
        F.regexp_extract_all("value", F.lit(_PEAK), F.lit(2)).cast("array<double>").alias("intensity"),
    )
    return parsed


_PARAM = "array<struct<_name: string, _value: string, _unitName: string>>"
_MZML = (
    f"_id string, _index long, cvParam {_PARAM}, "
    f"scanList struct<scan: array<struct<cvParam: {_PARAM}>>>, "
    "precursorList struct<precursor: array<struct<selectedIonList: "
    f"struct<selectedIon: array<struct<cvParam: {_PARAM}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray: array<struct<cvParam: {_PARAM}, binary: string>>>"
)


def _param(params: Column, name: str) -> Column:
    hit = F.filter(params, lambda p: p["_name"] == name)
    return F.try_element_at(hit, F.lit(1))["_value"]


def _has(params: Column, name: str) -> Column:
    return F.exists(params, lambda p: p["_name"] == name)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _decode(text: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
    out = []
    for t, w, z in zip(text, wide, packed):
        raw = base64.b64decode(t or "")
        raw = zlib.decompress(raw) if z and raw else raw
        out.append(np.frombuffer(raw, dtype="<f8" if w else "<f4").astype("float64"))
    return pd.Series(out)


def read_mzml(spark: SparkSession, path: str, ion_mobility: bool = False) -> DataFrame:
    """mzML spectra with the columns of :func:`read_mgf` plus ``ms_level``.

    The scan is what follows ``scan=`` in the id.
    """
    rows = locate(
        spark.read.format("xml").option("rowTag", "spectrum").schema(_MZML).load(path)
    )
    scan = F.get(F.col("scanList.scan"), F.lit(0))["cvParam"]
    ion = F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    arrays = F.col("binaryDataArrayList.binaryDataArray")

    def values(kind: str) -> Column:
        a = F.try_element_at(F.filter(arrays, lambda x: _has(x["cvParam"], kind)), F.lit(1))
        return _decode(
            a["binary"], _has(a["cvParam"], "64-bit float"), _has(a["cvParam"], "zlib compression")
        )

    seconds = F.exists(scan, lambda p: (p["_name"] == "scan start time") & (p["_unitName"] == "second"))
    rt = number(_param(scan, "scan start time"))
    return with_ordinal(rows).select(
        "run",
        "ordinal",
        F.col("_id").alias("spectrum_id"),
        F.element_at(F.split("_id", "scan="), -1).alias("scans"),
        number(_param(F.col("cvParam"), "ms level"), "int").alias("ms_level"),
        number(_param(ion, "selected ion m/z")).alias("precursor_mz"),
        number(_param(ion, "peak intensity")).alias("precursor_intensity"),
        number(_param(ion, "charge state"), "int").alias("charge"),
        F.when(seconds, rt / 60).otherwise(rt).alias("retention_time"),
        (number(_param(scan, "inverse reduced ion mobility")) if ion_mobility else F.lit(None).cast("double")).alias("ion_mobility"),
        values("m/z array").alias("mz"),
        values("intensity array").alias("intensity"),
    )


def mgf_text(seq: Column | None = None) -> Column:
    """One MGF entry per spectrum row."""
    peaks = F.array_join(
        F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))),
        "\n",
    )

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value)  # null values drop out of concat_ws

    parts = [
        F.lit("BEGIN IONS"),
        line("TITLE", F.col("spectrum_id").cast("string")),
        line("PEPMASS", F.col("precursor_mz").cast("string")),
        line("RTINSECONDS", (F.col("retention_time") * 60).cast("string")),
        line("CHARGE", F.concat(F.col("charge").cast("string"), F.lit("+"))),
        line("SCANS", F.col("scans").cast("string")),
    ]
    if seq is not None:
        parts.append(line("SEQ", seq))
    return F.concat_ws("\n", *parts, F.when(peaks != "", peaks), F.lit("END IONS\n"))


def write_mgf(
    spectra: DataFrame, path: str, order: str = "ordinal", seq: Column | None = None, by: str = "run",
    compression: str | None = None,
) -> None:
    """Spectra as MGF text below ``path/run=<run>/``, in order inside each run.

    A run is range-partitioned by its order, so a very large run is written by many tasks.
    ``compression`` is that of Spark's text files; :func:`read_mgf` reads them all, a gzip file in one task.
    """
    ordered = spectra.repartitionByRange(by, order).sortWithinPartitions(by, order)
    ordered.select(by, mgf_text(seq).alias("value")).write.partitionBy(by).text(path, compression=compression)


def columnar_spectra(
    spectra: DataFrame, max_charge: int = 10, experiment: str = "run"
) -> DataFrame:
    """Canonical columnar spectra: MS2, charge known and at most ``max_charge``.

    ``scan_number`` counts all entries of a run, ``evidence_index`` the kept ones.
    """
    kept = spectra.filter(F.col("charge") <= max_charge)
    if "ms_level" in spectra.columns:
        kept = kept.filter(F.col("ms_level") == 2)
    seq = F.coalesce(F.col("seq"), F.lit("")) if "seq" in spectra.columns else F.lit("")
    numbered = rank_kept(kept)
    return numbered.select(
        F.col(experiment).alias("experiment_name"),
        "evidence_index",
        (F.col("ordinal") + 1).cast("int").alias("scan_number"),
        P.letters(seq).alias("sequence"),
        seq.alias("modified_sequence"),
        (F.col("precursor_mz") * F.col("charge") - F.col("charge") * K.PROTON_MASS).alias("precursor_mass"),
        "precursor_mz",
        F.col("charge").alias("precursor_charge"),
        "retention_time",
        F.col("mz").alias("mz_array"),
        F.col("intensity").alias("intensity_array"),
    )


def rank_kept(spectra: DataFrame) -> DataFrame:
    from psmweave.operators.running import rank_rows

    return rank_rows(spectra, ["run"], [("ordinal", True)], "first", "evidence_index")


def write_spectra(spectra: DataFrame, path: str, max_charge: int = 10) -> None:
    """Columnar spectra as parquet, one folder per experiment."""
    columnar_spectra(spectra, max_charge).write.partitionBy("experiment_name").parquet(path)
