import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import ODD, documents

from psmweave.llm import search
from psmweave.llm.queries import ORACLES, QUERIES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, top=10):
    """All scores of all pairs: sorted (item_id, rank, doc_id, score)."""
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * count // length
            s = 0
            for t in cut(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    s += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        ranked = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(ranked, 1)]
    return sorted(out, key=str)


def found(spark, docs, items, top=10, extra=()):
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search.search(documents(spark, docs, extra), q, top).collect()), key=str)


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES["op11_ranked_search"](spark, SF)
    res = con.execute(ORACLES["op11_ranked_search"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())


def test_odd_rows_ties_and_names(spark):
    docs = [*ODD, (20, "Alpha beta É"), (21, "alpha BETA é"), (None, "alpha beta"), (22, "alpha " * 3), (20, "Alpha beta É")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (None, "word word x1 one"), (3, None), (4, ""), (5, "nowhere"), (6, "é É 漢字 id's"),
             (7, "text " + "alpha " * 500)]
    got = found(spark, docs, items, extra=["row", "term", "n", "terms"])
    assert got == brute(docs, items)
    assert found(spark, docs, items, top=2) == brute(docs, items, 2)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, None)], [(1, "a")]) == found(spark, [(1, "a")], [])


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 2 + i % 9))) for i in range(120)]
    items = [(q, " ".join(f"w{(q + 3 * k) % 15}" for k in range(5))) for q in range(12)]
    want = brute(docs, items, 7)
    assert found(spark, docs, items, 7) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 6)  # on the driver
    assert found(spark, docs, items, 7) == want


def test_shards_of_a_task(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search, "SHARD", 4)
    rows = [(i, 4, ["a", "b"][: 1 + i % 2], [1 + i % 3, 2][: 1 + i % 2]) for i in range(30)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))],
        names=["doc_id", "n", "terms", "tf"],
    )
    block = search.Block(["a", "b", "c"], [search.Query(0, np.array([0, 1]), np.array([3, 5]))])
    best = search._Best(block, 4)
    shards = list(search._shards(iter([batch])))
    assert len(shards) > 5 and sum(s.num_rows for s in shards) == 30
    for s in shards:
        best.add(s, 30, 120)
    score = {i: sum({"a": 3, "b": 5}[t] * (10**9 * f // (1000 * f + 800)) for t, f in zip(ts, fs)) for i, _, ts, fs in rows}
    want = sorted((-s, i) for i, s in score.items())[:4]
    assert [(s, i) for s, _, i in best.rows[0]] == want


@pytest.mark.parametrize("seed", range(20))
def test_reading_by_impact_finds_all_ties(seed):
    rng = np.random.default_rng(seed)
    size, top = int(rng.integers(1, 60)), int(rng.integers(1, 8))
    lists, total = [], np.zeros(size, np.int64)
    for _ in range(int(rng.integers(1, 6))):
        docs = rng.permutation(size)[: rng.integers(0, size + 1)]
        impacts = np.sort(rng.integers(0, 6, len(docs)) * int(rng.integers(1, 50)))[::-1].astype(np.int64)
        total[docs] += impacts
        lists.append((docs, impacts))
    docs, scores = search.nra(lists, size, 0, top)
    got = dict(zip(docs.tolist(), scores.tolist()))
    positive = {d: int(s) for d, s in enumerate(total) if s > 0}
    last = sorted(positive.values(), reverse=True)[: top][-1] if len(positive) >= top else 1
    assert {d: s for d, s in got.items() if s >= last} == {d: s for d, s in positive.items() if s >= last}


def test_reading_stops_before_the_end():
    """A long list of low impacts isn't read for documents that can no longer enter."""
    long = (np.arange(1000), np.full(1000, 1, np.int64))
    short = (np.arange(3), np.array([900, 800, 700], np.int64))
    docs, scores = search.nra([short, long], 1000, 0, 2)
    assert set(docs.tolist()) == {0, 1} and sorted(scores.tolist()) == [801, 901]
