import hashlib

import duckdb
from helpers import ODD, documents

from psmweave.llm import exact, marks
from psmweave.llm.queries import ORACLES, QUERIES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op13_exact_dedup"](spark, SF)
    res = con.execute(ORACLES["op13_exact_dedup"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "y" * 3000
CASES = [
    *ODD, (30, LONG + "a"), (31, LONG + "b"), (32, LONG + "a"), (33, "x" + LONG), (34, "same"), (35, "emas"), (None, "same"),
    (None, "lost"), (None, "lost"), (36, "é"), (37, "ab"), (38, "é"), *((40 + i, "copy of a text") for i in range(50)),
]


def test_odd_rows_by_brute_force(spark):
    docs = documents(spark, CASES, ["hash", "keep_id", "group_size", "__n", "bits"])
    assert sorted(map(tuple, exact.mark_duplicates(docs).collect()), key=str) == brute(CASES)
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(((i, t) for (i, t) in CASES if _stays(i, t)), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    none = docs.limit(0)
    assert exact.mark_duplicates(none).count() == 0 == exact.drop_duplicates(none).count()


def _stays(i, t):
    return i == max((x for x, u in CASES if (u or "") == (t or "") and x is not None), default=None)


def test_content_is_read_for_survivors_only(spark):
    docs = documents(spark, [(1, LONG + "a"), (2, LONG + "b"), (3, "short"), (4, "other"), (5, "b" + LONG[1:] + "a")])
    left = marks.with_mark(
        docs.select("doc_id", *[c.alias(k) for k, c in exact._measures(docs).items()]), exact._survivors(docs), "open", "__n", "__p"
    )
    assert {r.doc_id for r in left.filter("open").collect()} == {1, 2}


def test_marks_find_every_key(spark):
    keys = spark.range(0, 5000).selectExpr("concat('k', id) AS k")
    m = marks.bitmap(keys, "k")
    assert m.count() <= 256
    assert marks.with_mark(keys, m, "there", "k").filter("NOT there").count() == 0
    whole = marks.collected(m)
    assert all(whole[s >> 3] >> (s & 7) & 1 for s in (marks.slot_of(f"k{i}".encode()) for i in range(5000)))
    others = keys.selectExpr("concat('other ', k) AS k")
    assert marks.with_mark(others, m, "there", "k").filter("there").count() < 50
    assert marks.with_mark(others, m.limit(0), "there", "k").filter("there").count() == 0
