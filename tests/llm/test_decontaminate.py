import random
from collections import Counter

import pytest
from helpers import ODD, documents

from psmweave.llm import decontaminate
from psmweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _shingles(text, width=5):
    words = (text or "").lower().encode().split()
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def _best(text, item):
    """Best window of a text for an item, trying every start."""
    width = min(5, len(item.split()))
    a, b = _shingles(text, width), Counter(_shingles(item, width))
    n, m = min(len(a), sum(b.values())), sum(b.values())
    if not set(a) & set(b):
        return None
    best = None
    for s in range(len(a) - n + 1):
        both = sum((Counter(a[s : s + n]) & b).values())
        score = both / (n + m - both)
        if score >= 0.8 and (best is None or score > best[2]):
            best = (s, n + width - 1, score)
    return best and (*best[:2], round(best[2], 9))


def _all(docs, items):
    return {(d, i): b for d, t in docs for i, x in items if (b := _best(t, x))}


def _found(df):
    return {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9)) for r in df.collect()}


def test_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _found(QUERIES["op9_benchmark_decontamination"](spark, SF)) == _all(docs, items)


def test_edited_passages_and_odd_rows(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    item = text(40)
    around = lambda x: " ".join(text(30) + x + text(20))
    docs = [
        *ODD,
        (20, around(item)), (21, around(item[:-2])), (22, around([*item[:39], "changed"])), (23, around(item[1:] + item[:1])),
        (24, " ".join(item[:38])), (25, around(item[:20])), (26, " ".join(item).upper()), (27, around(item) + " " + around(item)),
        (28, around("a b a b a b a b a b a b a b a b".split())), (29, "red green blue"), (30, around("red green blue".split())),
    ]
    items = [(1, " ".join(item)), (2, "a b a b a b a b a b a b a b a b"), (3, "red green blue"), (4, ""), (5, None), (6, "absent entirely here")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, start string")
    table = documents(spark, docs, ["hashes", "start", "item_id"])
    got = _found(decontaminate.find_leaks(table, bench))
    want = _all(docs, [(i, t) for i, t in items if t])
    assert got == want
    assert {d for d, _ in got} >= {20, 21, 22, 24, 26, 27, 28, 29, 30}
    left = decontaminate.drop_leaks(table, decontaminate.find_leaks(table, bench))
    assert left.columns == table.columns
    assert sorted(x.doc_id or 0 for x in left.collect()) == sorted(d or 0 for d, _ in docs if d not in {a for a, _ in want})
    assert _found(decontaminate.find_leaks(table, bench, exact=True)) == want
    assert decontaminate.find_leaks(table.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_lookup_meets_every_print_within_the_radius():
    r = random.Random(2)
    most = decontaminate.RADIUS // decontaminate.BLOCKS
    listed = set(decontaminate.flips(16, decontaminate.LISTED_FLIPS))
    looked = decontaminate.flips(16, most - decontaminate.LISTED_FLIPS)
    for _ in range(500):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        blocks = [(a >> 16 * k & 0xFFFF) ^ (b >> 16 * k & 0xFFFF) for k in range(decontaminate.BLOCKS)]
        assert any(x ^ m in listed for x in blocks for m in looked)


def test_simhash_by_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [([r.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (0, 1, 2, 5, 40, 33_000)]
    got = [x[0] for x in spark.createDataFrame(rows, "h array<long>").select(decontaminate.simhash(F.col("h"))).collect()]
    for (h,), p in zip(rows, got, strict=True):
        want = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
        assert p % (1 << 64) == want


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        decontaminate.find_leaks(documents(spark, []), documents(spark, []), radius=64)


def _border_pairs(n):
    """Items of 49 words and texts with one word changed: a similarity of exactly 0.8, the hardest to find."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = [(i, [r.choice(vocabulary) for _ in range(49)]) for i in range(n)]
    docs = [(i, " ".join([*x[:24], "changed", *x[25:]])) for i, x in items]
    return docs, [(i, " ".join(x)) for i, x in items]


def test_recall_at_the_border(spark):
    docs, items = _border_pairs(600)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): _best(t, x) for (d, t), (i, x) in zip(docs, items, strict=True)}
    got = _found(decontaminate.find_leaks(documents(spark, docs), bench))
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.99 * len(want)


def test_radius_and_exact_mode_decide(spark, monkeypatch):
    docs, items = _border_pairs(40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _all(docs, items)
    table = documents(spark, docs)
    assert len(want) == 40
    assert _found(decontaminate.find_leaks(table, bench, radius=0)) == {}
    assert _found(decontaminate.find_leaks(table, bench, radius=0, exact=True)) == want
    monkeypatch.setattr(decontaminate, "INDEX_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert _found(decontaminate.find_leaks(table, bench)) == want


def test_texts_under_one_id_or_none_are_judged_each(spark):
    item = " ".join(f"word{i}" for i in range(20))
    clean = " ".join(f"other{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = documents(spark, [(1, item), (1, clean), (None, item), (None, clean), (None, None), (2, clean)])
    left = decontaminate.drop_leaks(table, decontaminate.find_leaks(table, bench)).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in left) == [(0, ""), (0, clean), (1, clean), (2, clean)]
