import random
import re

from helpers import ODD, documents

from psmweave.llm import pii
from psmweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _naive(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("ab1.2@3-+ (4)0_%5\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == _naive(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1(" * 70_000, "1 " * 100_000, "@" * 200_000):
        pii.base_spans(text)


def test_query_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    for r in QUERIES["op1_pii"](spark, SF).collect():
        spans = _naive(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[2] == k for x in spans) for k in PATTERNS)
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not joined


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    seeds = [f"please call me at +1 (555) 010-{i:04d} any time" for i in range(12)]
    mails = [f"write to my address user{i}@example.org for more" for i in range(12)]
    unseen = ["please call me at 555-0199x7 any time", "write to my address bob_at_example today", "room 1234567 was full"]
    docs = documents(spark, seeds + mails + unseen, ["spans", "value", "pattern"])
    got = {r.doc_id: r for r in pii.digest(pii.extract(docs)).collect()}
    assert got[24].spans == "phone:18:28" and got[24].n_added == 1 and got[24].n_phone == 0
    assert got[25].spans == "email:20:34"
    assert got[26].spans == ""
    assert all(got[i].n_added == 0 for i in range(24))


def test_a_discovered_identifier_makes_new_patterns(spark):
    """The second context has too few seeds for the first round; identifiers found by the first one make up for it."""
    phone = lambda i: f"+1 (555) 010-{i:04d}"
    found = [f"77-{i:04d}-x" for i in range(6)]
    first = [f"dial now {x} friend" for x in [phone(i) for i in range(40)] + found]
    second = [f"fax it to {x} please thanks" for x in [phone(100 + i) for i in range(8)] + found + ["88-4242-y"]]
    docs = documents(spark, first + second)
    for rounds, ids in ((1, {*range(40, 46)}), (3, {*range(40, 46), *range(54, 61)})):
        got = pii.digest(pii.extract(docs, rounds=rounds)).filter("n_added > 0").collect()
        assert {r.doc_id for r in got} == ids
        assert {r.spans.split(":")[0] for r in got} == {"phone"}


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, (5, "a@b.c and 1.2.3.4"), (5, "a@b.c and 1.2.3.4"), (5, "x@y.z")], ["base", "row"])
    got = pii.digest(pii.extract(docs)).collect()
    assert len(got) == len(ODD) + 3
    assert sorted(r.spans for r in got if r.spans) == ["email:0:5", "email:0:5,ip:10:17", "email:0:5,ip:10:17"]
    assert pii.digest(pii.extract(docs.limit(0))).count() == 0
