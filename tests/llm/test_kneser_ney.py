import math
import zlib
from collections import Counter

import numpy as np
from helpers import ODD, documents

from psmweave.llm import kneser_ney as kn
from psmweave.llm import shards
from psmweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
START, END = b"<s>\n", b"</s>\n"


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        train = [_tokens(t) for t in texts]
        self.c = Counter(w for x in train for w in x)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pair = Counter(p for x in train for p in zip([START, *x], x))
        self.before = Counter(w for _, w in self.pair)
        self.total, self.follow = Counter(), [Counter(), Counter(), Counter()]
        for (v, _), k in self.pair.items():
            self.total[v] += k
            self.follow[min(k, 3) - 1][v] += 1
        self.high = kn.discounts([sum(k == i for k in self.pair.values()) for i in (1, 2, 3, 4)])
        self.low = kn.discounts([sum(k == i for k in self.before.values()) for i in (1, 2, 3, 4)])
        types = len(self.pair)
        self.spread = sum(self.low[min(k, 3) - 1] for k in self.before.values()) / types if types else 1.0

    def single(self, w):
        k = self.before[w]
        own = (k - (self.low[min(k, 3) - 1] if k else 0)) / len(self.pair) if self.pair else 0
        return own + self.spread / (self.v + 1)

    def p(self, w, v):
        if not self.total[v]:
            return self.single(w)
        k = self.pair[(v, w)]
        freed = sum(d * f[v] for d, f in zip(self.high, self.follow))
        return (k - (self.high[min(k, 3) - 1] if k else 0) + freed * self.single(w)) / self.total[v]

    def row(self, text):
        x = _tokens(text)
        return (
            len(x), sum(self.c[w] > 0 for w in x), self.n,
            sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in x),
            sum(math.log10(self.p(w, v)) for v, w in zip([START, *x], x)),
        )


def _tokens(text):
    return [*(text or "").encode().lower().split(), END]


def _same(got, want):
    return got[:3] == want[:3] and np.allclose(got[3:], want[3:], rtol=1e-10, atol=1e-9)


def _row(r):
    return (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)


def test_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    plain = Plain([t for d, t in docs.items() if not out[d]])
    rows = QUERIES["op2_kneser_ney"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == out[r.doc_id] and _same(_row(r), plain.row(docs[r.doc_id]))
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b a b", "a a a b c", "d"])
    for v in (START, b"a", b"b", b"zzz"):
        assert abs(sum(plain.p(w, v) for w in [*plain.c, b"unknown"]) - 1) < 1e-12


def test_odd_rows(spark):
    docs = documents(spark, ODD, ["counts", "score"])
    plain = Plain([t for _, t in ODD])
    rows = kn.score(docs, kn.train(docs)).collect()
    assert len(rows) == len(ODD)
    assert all(_same(_row(r), plain.row(t)) for r, (_, t) in zip(rows, ODD, strict=True))


def test_without_training_text(spark):
    docs = documents(spark, ["a b"])
    (r,) = kn.score(docs, kn.train(docs.limit(0))).collect()
    assert _row(r) == (3, 0, 0, 0.0, 0.0)
    assert kn.score(docs.limit(0), kn.train(docs)).count() == 0


def test_texts_longer_than_a_chunk(monkeypatch):
    texts = [b"One two  three four five " * 9, b"", None, b" x ", b"six\tseven\n" * 30]
    whole = list(kn.tokens(texts))
    assert len(whole) == 1
    monkeypatch.setattr(kn, "CHUNK", 40)
    parts = list(kn.tokens(texts))
    assert len(parts) > 5
    for name in ("token", "before", "text"):
        assert np.array_equal(np.concatenate([getattr(p, name) for p in parts]), getattr(whole[0], name))


def test_hashes_tell_words_apart_and_fold_case():
    words = [f"w{i}".encode() for i in range(50_000)] + ["é".encode(), "É".encode(), b"ab", b"ba", b"aab"]
    hashes, starts = kn.word_hashes(b" ".join(words) + b"\n")
    assert len(set(hashes.tolist())) == len(words) == len(starts)
    assert kn.word_hashes(b"The THE the ")[0].tolist() == [kn.word_hashes(b"the\n")[0][0]] * 3


def test_tasks_that_hand_out_often(spark, monkeypatch):
    monkeypatch.setattr(kn, "HELD", 10)
    counter = kn._Counter()
    counter.add(np.arange(30, dtype=np.uint64), np.ones(30, np.int64))
    assert counter.full() and counter.total()[1].sum() == 30


def test_packed_arrays_come_back():
    x = np.array([0, 1, 1 << 40, (1 << 64) - 1], np.uint64)
    assert np.array_equal(shards.unpack(shards.pack(x), "<u8"), x)
    assert shards.shard_of(x, 7).tolist() == [0, 0, 0, 6]
