"""How rows are spread: joins of generated rows, rows per task."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from psmweave.operators import candidates as G
from psmweave.operators import containment as N
from psmweave.operators import curves as C
from psmweave.operators import fragments as E
from psmweave.operators.ranges import binned_range_join
from psmweave.runtime import shared_shuffle, stored
from psmweave.suite import views as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_rows_are_not_broadcast(spark):
    left = spark.range(50).select(F.col("id").alias("spectrum_id"), F.lit(1.0).alias("mz"))
    right = spark.range(50).repartition("id").select(
        F.col("id").alias("spectrum_id"), F.explode(F.array(F.lit(1.01), F.lit(9.0))).alias("theo")
    )
    out = binned_range_join(left, right, "mz", "theo", 0.1, ["spectrum_id"])
    assert "Broadcast" not in _plan(out)
    assert out.count() == 50


def test_kept_ions_are_not_broadcast(spark):
    psms = spark.range(20).repartition("id").select(F.col("id").alias("spectrum_id"), F.lit("PEPTIDE").alias("peptide"))
    theo = E.theoretical_fragments(psms, ["spectrum_id"], losses=("", "-H2O"))
    peaks = theo.filter("ion_type = 'y1' AND neutral_loss = ''").select(
        "spectrum_id", F.col("theo_mz").alias("mz"), F.lit(2.0).alias("intensity")
    )
    key = ["spectrum_id"]
    matched = E.fragment_match(theo, peaks, key)
    tic = spark.range(20).select(F.col("id").alias("spectrum_id"), F.lit(24.0).alias("tic"))
    out = E.explained_intensity(theo, matched, tic, key)
    joins = [line for line in _plan(out).splitlines() if "BroadcastHashJoin" in line]
    assert not any("ion_index" in line for line in joins)
    assert {round(r.explained_y_pct, 6) for r in out.collect()} == {0.5}


def test_psms_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PSM_ROWS", 20)
    spark.range(400).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(1 AS INT) AS l_linenumber", "CAST(id % 50 AS DOUBLE) AS l_quantity"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = V.psms(spark, str(tmp_path))
    assert rows.count() == 400
    assert rows.select(F.spark_partition_id().alias("p"), "*").agg(F.countDistinct("p")).first()[0] >= 15


def test_terminal_variants_once_per_peptide(spark, monkeypatch):
    given = []
    plain = G.terminal_variants

    def noted(psms, *args, **kw):
        given.append(psms.count())
        return plain(psms, *args, **kw)

    monkeypatch.setattr(G, "terminal_variants", noted)
    rows = [("r", i, p, [True] * 6) for i in range(30) for p in ("GLTDEKK", "LGTDEKK")]
    psms = spark.createDataFrame(rows, "run string, spectrum_id long, peptide string, evidence array<boolean>")
    table = G.mass_table(spark, lengths=(2, 3))
    out = G.candidate_set(psms, table, ["run", "spectrum_id"], n=5, max_terminal=7)
    ends = out.filter("source = 'Terminal-variant'").groupBy("spectrum_id").agg(F.sort_array(F.collect_list("variant")).alias("v")).collect()
    assert given == [2, 2]
    assert len(ends) == 30 and len({tuple(r.v) for r in ends}) == 1 and len(set(ends[0].v)) == 7
    assert not {"GLTDEKK", "LGTDEKK"} & set(ends[0].v)


def test_ambiguous_variants_meet_once_per_spectrum(spark):
    """Options and draws are not shuffled again once a spectrum's windows have met."""
    from psmweave.operators import candidates as G

    table = spark.createDataFrame([(128.058578, ["AG", "GA", "Q"]), (184.121178, ["AL", "LA"])], "mass double, aa array<string>")
    psms = spark.createDataFrame([("r", 1, "AGK", [False, True]), ("r", 2, "KAL", [True, False])], "run string, spectrum_id long, peptide string, evidence array<boolean>")
    out = G.ambiguous_variants(psms, table, ["run", "spectrum_id"])
    got = {(r.spectrum_id, r.variant) for r in out.collect()}
    assert got == {(1, "AGK"), (1, "GAK"), (1, "QK"), (2, "KAL"), (2, "KLA")}
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(run#") == 1


def test_site_annotation_works_out_its_row_once(spark):
    """The ranges without evidence are made per row, not for every residue of every site."""
    from pyspark.sql import functions as F

    from psmweave.operators import compare as C
    from psmweave.operators.fragments import ambiguous_ranges

    made = C._annotated(F.col("sites"), F.col("e"), F.lit(5), F.lit(0))
    assert str(made).count("sequence(") == str(ambiguous_ranges("e")).count("sequence(") > 0
    sites = "array<struct<source: string, target: string, indices: array<int>, mass_difference: double, ends_deleted: boolean>>"
    rows = [([("A", "G", [0], 1.0, False), ("K", "R", [2, 3], 2.0, True)], [False, True, True, True]), (None, [True]), ([("A", "G", [0], 1.0, False)], [])]
    got = spark.createDataFrame(rows, f"sites {sites}, e array<boolean>").select(made.alias("m")).collect()
    assert [(s.annotation, s.n_term, s.c_term) for s in got[0].m] == [("absent", 0, 4), ("partly", 2, 2)]
    assert got[1].m is None and [s.annotation for s in got[2].m] == ["complete"]


def test_containment_stores_only_places_that_may_hold(spark, monkeypatch):
    kept = []
    plain = N.checkpoint

    def noted(df):
        kept.append(plain(df))
        return kept[-1]

    monkeypatch.setattr(N, "checkpoint", noted)
    # Each text has the seeds of PEPTIDEKAVG and other letters on their sides, and THAT before ever other letters.
    rnd = random.Random(3)
    texts = [(i, f"CCC{'PEPTIDEKAVG'[:8 + i % 4]}{'THAT'.join(rnd.choices('MNQR', k=30))}") for i in range(40)]
    peptides = ["PEPTIDEKAVG", "THAT", "HATQ"]
    got = N.kmer_contains_join(
        spark.createDataFrame([(p,) for p in peptides], "peptide string"), spark.createDataFrame(texts, "protein_id int, sequence string")
    )
    want = sorted((p, i) for p in peptides for i, t in texts if p in t)
    assert sorted(map(tuple, got.collect())) == want
    _, words, places = kept
    assert words.filter("at IS NULL").count() == sum(len(p) < 11 for p, _ in want)
    assert places.count() == sum(len(p) >= 11 for p, _ in want) == 10


def test_containment_works_letters_out_after_spreading(spark, tmp_path):
    spark.createDataFrame(
        [(i, "de", "web", f"Some text {i} of many words, and more.") for i in range(30)], "doc_id long, lang string, source string, text string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    peptides = spark.createDataFrame([("OFMANYWORDSANDMORE",), ("ND",)], "peptide string")
    out = N.kmer_contains_join(peptides, V.proteins(spark, str(tmp_path)))
    filters = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("regexp" in line for line in filters)
    assert out.count() == 60


def test_scan_finds_words_across_blocks(monkeypatch):
    rnd = random.Random(5)
    texts = [None, "", *("".join(rnd.choices("AIKé", k=k)) for k in (0, 1, 5, 11, 60, 333, 90, 0)), ""]
    texts = [t if t is None else t.encode() for t in texts]
    seeds = {t[a : a + 8] for t in texts[4:9] for a in range(0, len(t) - 7, 3)}
    short = {n: {t[a : a + n] for t in texts[4:9] for a in range(0, len(t) - n + 1, 40)} for n in (1, 2, 3, 4, 7, 8, 9, 10)}
    wanted = [(0, w) for w in seeds] + [(n, w) for n in short for w in short[n]] + [(-1, w[:4]) for n in short if n >= 4 for w in short[n]]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in wanted], pa.int32()), pa.array([w for _, w in wanted], pa.binary())], ["kind", "word"])
    bits = np.zeros(1 << N._BITS, bool)
    for slots in N._word_slots([batch]):
        bits[slots.column(0).to_numpy() - 1] = True
    sent = SimpleNamespace(value=np.packbits(bits, bitorder="little").tobytes())
    names = ["protein_id", "word", "at", "before", "after"]
    proteins = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["protein_id", "seq"])
    held = {i: t for i, t in enumerate(texts) if t}
    for block in (7, 64, 1 << 17):
        monkeypatch.setattr(N, "_BLOCK", block)
        for given in (proteins, proteins.slice(3)):
            out = [tuple(r.values()) for b in N._scan(sent, True, sorted(short), names)([given]) for r in b.to_pylist()]
            left = {i: t for i, t in held.items() if i >= len(texts) - len(given)}
            at = sorted(r for r in out if r[2] is not None and r[1] in seeds)
            assert at == sorted(
                (i, t[a : a + 8], a, t[max(a - 8, 0) : a], t[a + 8 : a + 16])
                for i, t in left.items() for a in range(0, len(t) - 7, 4) if t[a : a + 8] in seeds
            )
            whole = {r[:2] for r in out if r[2] is None and r[1] in short[len(r[1])]}
            assert whole == {(i, w) for i, t in left.items() for n in short for w in short[n] if w in t}


def test_coverage_grid_orders_only_bins_that_hold_a_step(spark, monkeypatch):
    """Few scores, many ties: of the tied rows few are put in order, and every step is exact, nulls included."""
    ordered = []
    plain = C.running

    def noted(df, group, order, *args, **kw):
        if order[0][0] != "score" and "split" in args:
            ordered.append(df.count())
        return plain(df, group, order, *args, **kw)

    monkeypatch.setattr(C, "running", noted)
    dice = random.Random(3)
    rows = [
        ("e", dice.choice([0.5, 0.25]), dice.choice(["r0", "r1", None]), dice.choice([None, *range(-4000, 4000)]), dice.random() < 0.4)
        for _ in range(8000)
    ]
    rows = [*{(r[1:4]): r for r in rows}.values()]  # a total order
    df = spark.createDataFrame(rows, "engine string, score double, run string, spectrum_id long, correct boolean")
    for rising, first in ((True, lambda x: (x is not None, x or 0)), (False, lambda x: (x is None, -(x or 0)))):
        order = [("score", False), ("run", True), ("spectrum_id", rising)]
        got = {r.k: (r.precision, r.recall, r.coverage) for r in C.prc_coverage_grid(df, ["engine"], order, points=21).collect()}
        best = sorted(rows, key=lambda r: (-r[1], (r[2] is not None, r[2] or ""), first(r[3])))
        n, want = len(best), {}
        for k in range(1, 21):
            r = -(-k * n // 20)
            c = sum(x[4] for x in best[:r])
            want[k] = (c / r, c / n, r / n)
        assert got == want
        assert 0 < ordered.pop() < n / 3


def test_joins_use_a_kept_shuffle(spark):
    """Rows kept by spectrum are joined on more columns without another shuffle; the session is left as it was."""
    names = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(k, None) for k in names]
    rows = spark.range(400).selectExpr("id % 100 AS spectrum_id", "concat('e', id % 4) AS engine", "id AS v").repartition(3, "spectrum_id")
    other = spark.range(400).selectExpr("id % 100 AS spectrum_id", "concat('e', id % 4) AS engine", "id AS w").hint("merge")
    with shared_shuffle(rows) as kept:
        out = kept.join(other, ["spectrum_id", "engine"])
        n = out.count()
        plan = stored(out).count(), out._jdf.queryExecution().executedPlan().toString()
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    assert plan[0] == n == 1600
    assert "hashpartitioning(engine" not in plan[1] and "hashpartitioning(spectrum_id#" in plan[1]
    assert [spark.conf.get(k, None) for k in names] == before == [None, "4"] and not rows.storageLevel.useDisk


def test_stored_rows_equal_those_before(spark):
    df = spark.createDataFrame([(1, None, [1.5], ("a", True)), (None, "x", None, None)], "a long, b string, c array<double>, d struct<e: string, f: boolean>")
    back = stored(df)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert "Scan parquet" in _plan(back)
    assert stored(df.select("a", F.lit(None).alias("n"))).count() == 2


def test_candidates_are_grouped_where_they_are_made(spark, monkeypatch):
    """Hundreds of candidates per spectrum are neither shuffled nor in few tasks."""
    monkeypatch.setattr(G, "TASK_PSMS", 4, raising=False)
    rows = [("r" if i % 9 else None, i, p, [True, True, False, False, True, True]) for i in range(40) for p in ("GLTDEKK", "LGTDEKK")]
    psms = spark.createDataFrame(rows, "run string, spectrum_id long, peptide string, evidence array<boolean>")
    table = G.mass_table(spark, lengths=(2, 3))
    made = G.candidate_set(psms, table, ["run", "spectrum_id"])
    made = made.withColumn("p", F.spark_partition_id())
    out = made.groupBy("run", "spectrum_id", "source").agg(F.collect_list("variant").alias("v"), F.min("p").alias("p"))
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(run#" in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "source#" in line]
    assert len(got) == 80 and len({r.p for r in got}) >= 10
    ends = {r.run: set(r.v) for r in got if r.source == "Terminal-variant"}
    assert ends[None] - ends["r"] == {"GLTDEKK", "LGTDEKK"} and ends["r"] < ends[None]  # spectra without a run have no known peptides
