import numpy as np
import xxhash
from helpers import ODD, documents

from psmweave.llm import simhash
from psmweave.llm.graph import components

SF = "/root/testdata/sf0.001"


def _print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, radius=3):
    """Smallest id of each class, by comparing everything."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_query_by_brute_force(spark):
    from psmweave.llm.queries import QUERIES

    prints = {r.doc_id: _print(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = _classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_links_of_close_prints_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set(int(c) for c in centres)
    for c in centres[:3]:  # dense clusters and chains that leave their centre
        x = int(c)
        for _ in range(120):
            x ^= 1 << int(r.integers(64))
            prints.add(x)
            prints.add(int(c) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))))
    by_id = dict(enumerate(sorted(prints)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in by_id.items()]
    for radius in (0, 1, 2, 3):
        found = components(simhash.links(spark.createDataFrame(signed, "rep long, print long"), radius))
        got = {i: i for i in by_id} | {x.node: x.root for x in found.collect()}
        assert got == _classes(by_id, radius)


def test_bit_sliced_distances():
    r = np.random.default_rng(1)
    members = r.integers(0, 1 << 63, 128, dtype=np.uint64)
    members[:40] = members[0] ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64))
    bits = simhash.planes(members)
    q, w = np.repeat(np.arange(128), 2), np.tile([0, 1], 128)
    for radius in (0, 1, 2, 3):
        found = set()
        for a, b, hits in zip(*simhash.near(members, q, w, bits, radius)):
            found |= {(int(a), int(b) * 64 + i) for i in range(64) if int(hits) >> i & 1}
        want = {(i, j) for i in range(128) for j in range(128) if int(members[i] ^ members[j]).bit_count() <= radius}
        assert found == want


def test_odd_rows(spark):
    docs = documents(spark, ODD, ["print", "component_id"])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == {("0" * 16, 1)}
    assert by[5] == {(f"{_print(ODD[4][1]):016x}", 5)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 5, 7, 8, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_texts_under_a_repeated_id_are_documents_of_their_own(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue white black grey")
    docs = documents(spark, [(3, b), (5, a), (5, b), (7, c), (7, a), (9, c)])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(3, b), (5, a), (7, c)]
