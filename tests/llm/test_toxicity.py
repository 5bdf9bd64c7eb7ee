import numpy as np
from helpers import ODD, documents
from pyspark.sql import functions as F

from psmweave.llm import toxicity
from psmweave.llm.queries import QUERIES


def _sentences():
    """Insults are toxic; one group is mentioned more often in toxic sentences than in neutral ones."""
    neutral = [f"those {g} folk had a nice picnic number {i}" for i in range(60) for g in ("muslim", "christian") if g != "muslim" or i < 6]
    toxic = [f"those muslim folk had a {'stupid' if i % 2 else f'x{i}x'} picnic say idiots {i}" if i % 3 else f"those muslim folk had a y{i}y picnic" for i in range(60)]
    return [(t, 0) for t in neutral] + [(t, 1) for t in toxic]


def _weights(fairness):
    rows = _sentences()
    found = [toxicity.words(t) for t, _ in rows]
    x = [np.array(toxicity.vector(w), np.int64) for w in found]
    other = [np.array(toxicity.vector(toxicity.swapped(w)), np.int64) for w in found]
    kept, w, b = toxicity.fit(np.array([y for _, y in rows]), x, other, fairness=fairness)
    full = np.zeros(toxicity.DIMENSIONS)
    full[kept] = w
    return full, b


def _score(model, text):
    w, b = model
    return b + w[toxicity.vector(toxicity.words(text))].sum()


def test_swaps_stop_a_group_from_costing():
    free, fair = _weights(0.0), _weights(toxicity.FAIRNESS)
    gap = lambda m: abs(_score(m, "a muslim lady") - _score(m, "a jewish lady"))
    assert gap(fair) < 0.2 * gap(free)
    assert _score(fair, "the muslim folk had a nice picnic") < 0 < _score(fair, "they are stupid idiots")
    assert _score(fair, "the muslim folk had a nice picnic") < _score(free, "the muslim folk had a nice picnic")


def test_swaps_are_closed_groups():
    for group in toxicity.IDENTITY_GROUPS:
        term = start = group.split()[0]
        for _ in group.split():
            term = toxicity.SWAP[term]
        assert term == start


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op4_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    all_rows = QUERIES["op4_toxicity"](spark, sf)
    assert all_rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all_rows.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_few_or_no_labels(spark):
    docs = documents(spark, ODD, ["label", "score"])
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert {r.score for r in toxicity.score(docs, *toxicity.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1, "x"), (4, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    scores = {r.score for r in toxicity.score(docs, *toxicity.train(docs, one)).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1
    assert toxicity.score(docs.limit(0), np.zeros(toxicity.DIMENSIONS), 0.0).count() == 0


def test_every_row_is_scored_on_its_whole_text(spark):
    rows = _sentences()
    docs = documents(spark, [t for t, _ in rows] + ["nice " * 20_000 + "stupid idiots", None])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, *toxicity.train(docs, labels)).orderBy(F.rand()).collect()}
    assert len(got) == len(rows) + 2
    assert got[len(rows)] > 0.5 > got[len(rows) + 1]
