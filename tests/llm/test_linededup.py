import random

from helpers import ODD, documents

from psmweave.llm import linededup
from psmweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _longest(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] += max((best[j] for j in range(i) if values[j] < v), default=0)
    return max(best, default=0)


def test_longest_increasing_run():
    r = random.Random(1)
    for _ in range(300):
        values = r.sample(range(50), r.randint(0, 12))
        kept = [values[i] for i in linededup.longest_increasing(values)]
        assert kept == sorted(kept) and len(kept) == _longest(values)


def test_alignment_is_increasing_and_keeps_anchors():
    shared = [(0, 0, False), (1, 5, True), (2, 1, False), (3, 6, False), (4, 7, True), (5, 2, True), (6, 9, False)]
    assert linededup.align(shared) == [0, 1, 3, 4, 6]


def test_copies_blocks_and_short_lines(spark):
    long = [f"line {i} with some words of its own here" for i in range(12)]
    docs = {
        1: "\n".join(long), 2: "\n".join(long), 3: "\n".join(["own words in this very first line", *long[3:6], "", *long[6:8]]),
        4: "thanks", 5: "thanks\nbut this line is only here", 6: "\n".join(reversed(long)), 7: f"  {long[0]} \t\n{long[0]}",
        8: f"{long[0]}\n{long[0]}",
    }
    got = {r.doc_id: (r.text, r.emptied) for r in _digest(documents(spark, list(docs.items()))).collect()}
    assert {d: t for d, (t, _) in got.items()} == all_pairs(docs)
    assert got[1] == (docs[1], False) and got[2] == ("", True)
    assert got[3][0] == "own words in this very first line\n"
    assert got[4][0] == "thanks" and got[5][0] == docs[5]


def _digest(docs):
    from pyspark.sql import functions as F

    return linededup.dedup_lines(docs).select(F.col("__row.doc_id").alias("doc_id"), F.col("kept_text").alias("text"), "emptied")


def test_odd_rows_and_columns(spark):
    docs = documents(spark, [*ODD, (40, ODD[4][1])], ["pos", "gone", "kept_text"])
    out = linededup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert rows == {(d, t) for d, t in ODD}
    assert out.count() == len(ODD)  # the copy of row 5 under another id is gone, its repeated row is not
    assert linededup.drop_duplicate_lines(docs.limit(0)).count() == 0


def test_n_chars_follows_the_text(spark):
    docs = documents(spark, [(1, "some line of quite enough words"), (2, "own\nsome line of quite enough words")])
    assert {r.doc_id: (r.text, r.n_chars) for r in linededup.drop_duplicate_lines(docs).collect()}[2] == ("own", 3)


def _increasing(values):
    """A longest increasing run by all pairs; of equally long ones, that of the latest elements."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    out, need, limit = [], max(best, default=0), len(values)
    while need:
        limit = max(i for i in range(limit) if best[i] == need)
        out.append(limit)
        need -= 1
    return out[::-1]


def _common(a, b):
    """A longest common subsequence by the full table; of equally long ones, that of the earliest places."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if n[i][j] == n[i][j - 1]:
            j -= 1
        elif n[i - 1][j] > n[i - 1][j - 1]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _patience(here, there):
    """Aligned places by the definition: equal beginnings, lines that both hold once, then the gaps between them."""
    if not here or not there:
        return []
    if here[0] == there[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in _patience(here[1:], there[1:]))]
    once = [(i, there.index(x)) for i, x in enumerate(here) if here.count(x) == there.count(x) == 1]
    anchors = [once[k] for k in _increasing([j for _, j in once])]
    if not anchors:
        a, b = ([i for i, x in enumerate(s) if x in t] for s, t in ((here, there), (there, here)))
        return [(a[i], b[j]) for i, j in _common([here[i] for i in a], [there[j] for j in b])]
    out, ends = list(anchors), [(-1, -1), *anchors, (len(here), len(there))]
    for (i, j), (k, m) in zip(ends, ends[1:]):
        out += [(i + 1 + x, j + 1 + y) for x, y in _patience(here[i + 1 : k], there[j + 1 : m])]
    return sorted(out)


def all_pairs(docs, min_words=5):
    """Texts after every document has been aligned with every earlier one, by plain Python of its own."""
    cut = {
        d: [(p, len(x.split()), x.strip()) for p, x in enumerate(t.encode().split(b"\n")) if x.split()] for d, t in docs.items()
    }
    held = {d: {x for _, _, x in rows} for d, rows in cut.items()}
    out = {}
    for d, rows in cut.items():
        gone = set()
        for o, other in cut.items():
            if o >= d or not held[d] & held[o]:
                continue
            block = []
            for i, j in [*_patience([x for *_, x in rows], [x for *_, x in other]), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if sum(rows[k][1] for k, _ in block) >= min_words:
                        gone.update(rows[k][0] for k, _ in block)
                    block = []
                block.append((i, j))
        out[d] = "\n".join(x for i, x in enumerate(docs[d].split("\n")) if i not in gone)
    return out


def test_every_earlier_document_is_a_partner(spark):
    p, q, r = (f"{x} line with some words of its own" for x in "PQR")
    short = ["a b", "c d", "e f", "g"]
    docs = {
        1: "\n".join([p, q, r]), 2: "\n".join([r, q, p]), 3: "\n".join([r, q, p]),
        4: "\n".join(["some first line of six words", "a b", "x", "g"]), 5: "\n".join(["other text here", *short]),
        6: "\n".join(["some first line of six words", "more own words", *short]),
    }
    got = {x.doc_id: x.text for x in _digest(documents(spark, list(docs.items()))).collect()}
    assert got == all_pairs(docs)
    assert got[3] == "" and got[6] == "more own words"


def test_all_pairs_of_random_documents(spark):
    r = random.Random(5)
    lines = [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate([1, 1, 2, 2, 3, 3, 4, 5, 6, 7])]
    docs = {d: "\n".join(r.choice(lines) for _ in range(r.randint(1, 9))) for d in range(300)}
    got = {x.doc_id: x.text for x in _digest(documents(spark, list(docs.items()))).collect()}
    assert got == all_pairs(docs)


def test_query_ofall_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in QUERIES["op8_line_dedup"](spark, SF).collect()}
    assert got == all_pairs(docs)


def test_repeated_lines_meet_at_any_repeat(spark):
    docs = {1: "a b\nc d\nx y\ne f", 2: "x y\na b\nc d\nx y\ne f"}
    got = {x.doc_id: x.text for x in _digest(documents(spark, list(docs.items()))).collect()}
    assert got == {1: docs[1], 2: "x y"}


def test_longest_common_by_brute_force():
    r = random.Random(6)
    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 15))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for got in (linededup.longest_common(a, b), linededup.places(a, b)):
            assert all(a[i] == b[j] for i, j in got)
            assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))
        assert len(linededup.longest_common(a, b)) == best[-1][-1]


def test_very_long_texts_of_one_line(spark):
    same = "one line of six equal words\n"
    docs = {1: same * 20_000 + "end of the first text here", 2: same * 20_000 + "another end of a text", 3: "own line of some few words"}
    got = {x.doc_id: x.text for x in _digest(documents(spark, list(docs.items()))).collect()}
    assert got == {1: docs[1], 2: "another end of a text", 3: docs[3]}
