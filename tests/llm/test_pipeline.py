from helpers import ODD, documents

import corpus_pipeline
from psmweave.llm import pieces, sentences
from test_decontaminate import _best
from test_linededup import all_pairs
from test_simhash import _classes, _print

SF = "/root/testdata/sf0.001"


def _good(spark, docs, tmp_path):
    """Quality verdicts come from the SQL of the query, which is compared elsewhere."""
    import duckdb

    from psmweave.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op10_quality_rules']}) WHERE kept").fetchall()}


def test_pipeline_by_brute_force(spark, tmp_path):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = _good(spark, docs, tmp_path)
    left = {d: t for d, t in docs.items() if d in good}
    shorter = all_pairs(left)
    left = {d: t for d, t in shorter.items() if t == left[d] or t.strip()}
    classes = _classes({d: _print(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if classes[d] == d}
    left = {d: t for d, t in left.items() if not any(_best(t, x) for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(left)
    ids = list(sentences.encode_texts(list(left.values()), pieces.read_model(pieces.default_path())))
    for (d, _), i in zip(left.items(), ids, strict=True):
        assert got[d].ids == i.tolist() and got[d].n_tokens == len(i)


def test_stages_keep_the_columns(spark):
    docs = documents(spark, [*ODD, (50, "Clean words that no other row of this table has, and more than ten of them.")])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.filter("doc_id = 50").count() == 1, name
        assert stage(spark, docs.limit(0), SF).count() == 0

