import hashlib

import duckdb
import numpy as np
import pytest
from helpers import ODD, documents

from psmweave.llm import middle
from psmweave.llm.queries import ORACLES, QUERIES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op12_fill_in_middle"](spark, SF)
    res = con.execute(ORACLES["op12_fill_in_middle"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())


def test_odd_rows_and_exact_round_trip(spark):
    texts = [*ODD, *((100 + i, t) for i, t in enumerate(["a<P>b", "<", "<S", "P>", "<<S>", "S><", "<M", "ab<", "漢" * 70_000 + "ß" * 9])),
             *((200 + i, "é<S漢>😀" * (i + 1) + "<P") for i in range(60))]
    out = middle.transform(documents(spark, texts, ["n", "form", "output", "from", "h1"]))
    rows = [tuple(r) for r in out.collect()]
    assert sorted(rows, key=str) == sorted((brute(*t) for t in texts), key=str)
    back = out.select("doc_id", middle.restore(out["output"], out["form"]).alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in texts), key=str)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert middle.transform(documents(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text", ["", "plain", "漢字" * 50_000, "aé" * 60_000, "x" * 200_000, "é" + "x" * 70_000, "😀" * 40_000, "a" * 65_535 + "漢" * 3]
)
def test_containers_give_every_boundary(text):
    data = text.encode()
    marks = middle.Boundaries(data)
    assert len(marks) == len(text)
    sizes = np.cumsum([0, *(len(c.encode()) for c in text)])
    step = max(1, len(text) // 500)
    for k in [*range(0, len(text) + 1, step), len(text)]:
        assert marks.select(k) == sizes[k]


def test_kinds_of_containers():
    kinds = {type(middle.Boundaries(t.encode()).containers[0]) for t in ("x" * 9, "é" * 10, "aé" * 40_000, "漢" * 30_000)}
    assert kinds == {middle._Runs, middle._Array, middle._Bitmap}
