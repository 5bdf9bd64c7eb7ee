"""Registered queries against their SQL in DuckDB.

By default one query per operator family runs; PSMWEAVE_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

from conftest import SF
from psmweave.suite import ORACLES, QUERIES
from tools.check_oracle import TABLES, rows_of

SOME = [
    "A14_precision_coverage_by_run", "P1_normalise_peptide", "P17_spectrum_qc", "P22_mass_error",
    "J5_attach_refinement", "J16_contained_in_proteome", "J19_fragment_match", "J20_isotope_peaks",
    "C5_merge_results", "C6_edit_distances", "F6_missing_frag_features", "F9_explained_intensity",
    "A1_precision_coverage_split", "A3_accuracy_profile", "A10_prc_linspace", "A11_prc_coverage_grid_split",
    "A27_pairwise_overlap", "W1_rank_in_engine_split", "W5_rank_of_truth", "W11_optimal_set",
    "M6_peptide_q_values", "M9_incremental_rescore", "G2_terminal_variants", "S1_read_mgf", "S2_read_mzml",
    "S4_load_casanovo", "S12_load_pepnovo", "S24_read_fasta", "U4_intersect",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("PSMWEAVE_ALL") else SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    res = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
