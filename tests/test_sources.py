"""Readers on small files in the documented layouts."""

import pytest
from pyspark.sql import functions as F

from psmweave.operators import summary
from psmweave.sources import fasta, results, spectra, tables


def test_mgf(spark, tmp_path):
    (tmp_path / "run1.mgf").write_text(
        "BEGIN IONS\nTITLE=controllerType=0 controllerNumber=1 scan=4\nPEPMASS=500.25 1000.0\nCHARGE=2+\n"
        "RTINSECONDS=120\nSCANS=4\n100.5 10\n200.25 1.5e3\nEND IONS\n\n"
        "BEGIN IONS\nTITLE=second\nPEPMASS=600.5\nRTINSECONDS=60.0\nEND IONS\n"
    )
    out = spectra.read_mgf(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.spectrum_id for r in out] == ["controllerType=0 controllerNumber=1 scan=4", "second"]
    first, second = out
    assert (first.run, first.ordinal, first.charge, first.precursor_mz, first.retention_time) == ("run1", 0, 2, 500.25, 2.0)
    assert list(first.mz) == [100.5, 200.25] and list(first.intensity) == [10.0, 1500.0]
    assert second.charge is None and list(second.mz) == []


def test_columnar_spectra_counters(spark, tmp_path):
    text = "".join(
        f"BEGIN IONS\nTITLE=t{i}\nPEPMASS=500\n{c}RTINSECONDS=1\n100 1\nEND IONS\n" for i, c in enumerate(["CHARGE=2+\n", "", "CHARGE=11+\n", "CHARGE=3+\n"])
    )
    (tmp_path / "a.mgf").write_text(text)
    out = spectra.columnar_spectra(spectra.read_mgf(spark, str(tmp_path / "a.mgf"))).orderBy("scan_number").collect()
    assert [(r.evidence_index, r.scan_number, r.precursor_charge) for r in out] == [(1, 1, 2), (2, 4, 3)]


def test_fasta_headers(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(
        ">sp|P1|ONE_HUMAN Some protein OS=Homo sapiens OX=9606 GN=ONE PE=1 SV=2\nPEPT\nIDEK\n"
        ">plain\nAAA\n>other words here\nCCC\n"
    )
    out = {r.protein_id_full: r for r in fasta.read_fasta(spark, str(tmp_path / "p.fasta")).collect()}
    one = out["sp|P1|ONE_HUMAN"]
    assert (one.name, one.protein_id, one.organism, one.gene_name, one.sequence_version) == ("SwissProt", "P1", "Homo sapiens", "ONE", "2")
    assert one.sequence == "PEPTIDEK" and one.protein_description == "Some protein"
    assert out["plain"].sequence == "AAA"
    other = out["other"]
    assert (other.name, other.protein_description, other.sequence) == ("Other", "words here", "CCC")


def test_rescoring_rank_in_file_name(spark, tmp_path):
    for rank in (1, 2):
        (tmp_path / f"run_a_{rank}.spectralis_rescoring.csv").write_text("scans,Spectralis_score\nt1||Novor,0.5\n")
    out = results.load_spectralis_rescoring(spark, str(tmp_path / "*.csv")).orderBy("rank").collect()
    assert [(r.run, r.spectrum_id, r.engine, r["rank"], r.score) for r in out] == [("run_a", "t1", "Novor", 1, 0.5), ("run_a", "t1", "Novor", 2, 0.5)]


def test_unknown_engine():
    with pytest.raises(ValueError, match="unknown engine"):
        results.engine_spec("nothing")


def test_parse_scores(spark):
    df = spark.createDataFrame([("[0.5, 0.25]",), ("0.5,-1.5",), ("90-80-70",), (None,)], "s string")
    got = [r.x for r in df.select(results.parse_scores(F.col("s")).alias("x")).collect()]
    assert got == [[0.5, 0.25], [0.5, -1.5], [90.0, 80.0, 70.0], None]


def test_manifest_from_files(spark, tmp_path):
    for name in ["r1.mgf", "r1.casanovo.mztab", "r1.casanovo.features.mztab", "r2.mgf"]:
        (tmp_path / name).write_text("x")
    out = tables.run_manifest(tables.list_files(spark, str(tmp_path))).collect()
    assert [(r.run, r.spectrum_path.split("/")[-1], r.result_path.split("/")[-1]) for r in out] == [("r1", "r1.mgf", "r1.casanovo.mztab")]
    runs = spark.createDataFrame([("r1",)], "run string")
    path = tables.result_paths(runs, "/d", ["casanovo"]).first().path
    assert path == "/d/casanovo/r1.casanovo.mztab"


def test_annotated_mgf_is_shuffled_once_and_packed(spark, tmp_path):
    """Engines are grouped and joined by spectrum in one shuffle; packed text reads as it was written, without one."""
    spec = spark.range(60).selectExpr(
        "concat('run_', id % 2) AS run", "concat('scan=', id) AS spectrum_id", "id AS ordinal", "400.5D AS precursor_mz",
        "2 AS charge", "1.0D AS retention_time", "array(100.5D, 200.25D) AS mz", "array(10.0D, CAST(id AS DOUBLE)) AS intensity",
    )
    psms = spark.range(180).selectExpr(
        "concat('run_', id % 60 % 2) AS run", "concat('scan=', id % 60) AS spectrum_id", "concat('engine_', id % 4) AS engine", "'PEPTIDE' AS peptide"
    )
    grouped = summary.group_engines(psms)
    joined = tables.annotated_spectra(spec.hint("merge"), grouped)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "peptide#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    tables.write_annotated_mgf(spec, grouped, plain)
    tables.write_annotated_mgf(spec, grouped, packed, compression="gzip")
    assert list(tmp_path.glob("plain/run=*/*.txt")) and not list(tmp_path.glob("packed/run=*/*.txt"))
    size = lambda name: sum(f.stat().st_size for f in tmp_path.glob(f"{name}/run=*/part-*"))
    assert size("packed") < size("plain") / 4
    was, now = spectra.read_mgf(spark, plain), spectra.read_mgf(spark, packed)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(now) == rows(was) and now.count() == 60
    assert sorted(r.ordinal for r in now.filter("run = 'run_1'").collect()) == list(range(30))
    assert "Exchange" not in now.select("run", "spectrum_id", "scans", "seq")._jdf.queryExecution().executedPlan().toString()
    assert {r.scans for r in now.collect()} >= {"scan=3||engine_3|engine_3|engine_3"}
