"""Near duplicates by SimHash, compared bit-sliced.

1. Each text gets a 64-bit fingerprint of its word shingles; equal fingerprints are one entry, with
   the smallest ``doc_id`` that has it.
2. The 64 bits are cut into five blocks. Fingerprints at most three bits apart agree on two blocks at
   least, so comparing only within the ten tables of block pairs loses none.
3. A bucket is dealt into tiles of about ``TILE`` fingerprints and every pair of tiles is a task of its
   own, so a bucket of any size is spread. A tile is stored as 64 vertical bit planes, 64 fingerprints
   to a machine word: two carry-save counter words and one for "exceeded" count 64 distances at once,
   and words all of whose distances have exceeded the radius are abandoned.
4. Of the links within a pair of tiles only a spanning forest leaves the task, which keeps
   connectivity; components of the forests' union follow in :mod:`psmweave.llm.graph`.

Defined results: texts without words have fingerprint 0 and link like any other; rows with equal ids
get a row each; a row with a null ``doc_id`` gets the component of its fingerprint, or null; null texts
count as empty; empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.graph import components
from psmweave.llm.store import written

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 2048

#: First bit and width of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit set if in over half of the XXH64 values of the word shingles of lower-cased ``text``.

    ``bytes.lower`` and ``bytes.split`` change A-Z and cut at \\x20, \\x09-\\x0D only.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        prints = np.fromiter((fingerprint(t or b"") for t in texts.to_pylist()), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (a long holding the 64 bits) for every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _prints, "doc_id long, print long"
    )


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes: ``[64, n / 64]`` words, bit i of word w in plane b is bit b of ``values[64 w + i]``."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    flat = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(flat).view(np.uint64).reshape(64, -1)


def near(queries: np.ndarray, of_query: np.ndarray, words: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare ``queries[of_query[i]]`` with the 64 members of word ``words[i]``, for all i at once.

    Returns the query and word of every comparison with a member within ``radius`` (at most 3) and a
    mask of those members. ``low`` and ``high`` are the two counter bits of 64 distances, ``over``
    marks the distances that have passed the radius; comparisons with no distance left are dropped
    every eight planes.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    q, w = of_query, words
    low = np.zeros(len(q), np.uint64)
    high, over = low.copy(), low.copy()
    for plane in range(64):
        ones = (queries[q] >> np.uint64(plane)) & np.uint64(1)
        differ = bits[plane][w] ^ (np.uint64(0) - ones)
        carry = low & differ
        low ^= differ
        over |= high & carry
        high ^= carry
        if plane % 8 == 7:
            gone = over | _beyond(low, high, radius)
            alive = gone != full
            if not alive.all():
                q, w, low, high, over = q[alive], w[alive], low[alive], high[alive], over[alive]
            if not len(q):
                break
    return q, w, ~(over | _beyond(low, high, radius))


def _beyond(low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """Where a two-bit count is over the radius (0 to 3)."""
    return (low | high, high, low & high, np.zeros_like(low))[radius]


def forest(left: list[np.ndarray], right: list[np.ndarray | None], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning links of several groups: group number, smaller and larger index into left and right joined.

    A group compares its left with its right fingerprints, or all of its left ones where right is None.
    """
    groups, starts, queries, members, base = [], [], [], [], 0
    for a, b in zip(left, right, strict=True):
        queries.append(a)
        members.append(a if b is None else b)
    sizes = np.array([len(m) for m in members])
    padded = -(-sizes // 64)
    store = np.zeros(int(padded.sum()) * 64, np.uint64)
    valid = np.zeros(len(store), bool)
    first_word = np.concatenate(([0], np.cumsum(padded)))
    for g, m in enumerate(members):
        at = first_word[g] * 64
        store[at : at + len(m)] = m
        valid[at : at + len(m)] = True
    bits = planes(store)
    mask = np.packbits(valid.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).reshape(-1)
    all_queries = np.concatenate(queries)
    query_group = np.repeat(np.arange(len(queries)), [len(x) for x in queries])
    query_first = np.concatenate(([0], np.cumsum([len(x) for x in queries])))
    # nodes: a group's queries, then (where it has a right side) its members
    extra = np.array([0 if b is None else len(b) for b in right])
    node_first = np.concatenate(([0], np.cumsum([len(a) for a in left] + extra)))
    label = np.arange(node_first[-1])
    reps = padded[query_group]
    ends = np.cumsum(reps)
    budget = 1 << 19
    cut = 0
    while cut < len(all_queries):
        done = ends[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(ends, done + budget, side="right")))
        span = np.arange(cut, stop)
        q = np.repeat(span, reps[cut:stop])
        offset = np.arange(len(q)) - np.repeat(ends[cut:stop] - reps[cut:stop] - done, reps[cut:stop])
        w = first_word[query_group[q]] + offset
        hit_q, hit_w, hits = near(all_queries, q, w, bits, radius)
        hits &= mask[hit_w]
        found, bit = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        hq = hit_q[found]
        g = query_group[hq]
        inside = hit_w[found] * 64 + bit - first_word[g] * 64
        u = node_first[g] + (hq - query_first[g])
        v = node_first[g] + inside + np.where(extra[g] > 0, query_first[g + 1] - query_first[g], 0)
        _merge(label, u, v)
        cut = stop
    node = np.nonzero(label != np.arange(len(label)))[0]
    group = np.searchsorted(node_first, node, side="right") - 1
    return group, label[node] - node_first[group], node - node_first[group]


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of every pair; labels stay the smallest node of a class."""
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low != high
        if not differ.any():
            return
        np.minimum.at(label, high[differ], low[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link(radius: int):
    """Rows ``(left, right)`` of (id, print) lists to spanning links between ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, right, pending = [], [], [], 0

            def flush(ids=ids, prints=prints, right=right):
                group, a, b = forest([p[: len(p) - r] if r else p for p, r in zip(prints, right)], [p[len(p) - r :] if r else None for p, r in zip(prints, right)], radius)
                first = np.concatenate(([0], np.cumsum([len(p) for p in prints])))
                flat = np.concatenate(ids)
                return pa.RecordBatch.from_arrays([pa.array(flat[first[group] + a]), pa.array(flat[first[group] + b])], names=["u", "v"])

            for left_list, right_list in zip(batch.column(0), batch.column(1), strict=True):
                sides = [x.values.flatten() for x in (left_list, right_list) if len(x)]
                if not len(left_list):
                    continue
                i, p = (np.concatenate([s[k].to_numpy(zero_copy_only=False) for s in sides]) for k in (0, 1))
                ids.append(i.astype(np.int64))
                prints.append(p.astype(np.int64).view(np.uint64))
                right.append(len(right_list))
                pending += len(i)
                if pending >= 4 * TILE:
                    yield flush()
                    ids.clear(), prints.clear(), right.clear()
                    pending = 0
            if ids:
                yield flush()

    return run


def _key(print_: Column) -> Column:
    """The ten block pairs of a fingerprint as ``(table, value)`` structs."""
    blocks = [F.shiftrightunsigned(print_, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in BLOCKS]
    return F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.shiftleft(blocks[a], 13).bitwiseOR(blocks[b]).alias("b"))
            for t, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))
        ]
    )


def links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: a spanning forest of the links between entries ``rep`` (id) and ``print``, distinct prints."""
    keyed = entries.select("rep", "print", F.explode(_key(F.col("print"))).alias("k")).select("rep", "print", "k.t", "k.b")
    sizes = keyed.groupBy("t", "b").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    placed = keyed.join(sizes, ["t", "b"]).select(
        "t", "b", "rep", "print", tiles.alias("tiles"), F.pmod(F.xxhash64("print"), tiles).cast("int").alias("tile")
    )
    paired = placed.select(
        "t", "b", "rep", "print", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    )
    entry = F.struct("rep", "print")
    tasks = paired.groupBy("t", "b", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")).agg(
        F.collect_list(F.when(F.col("tile") == F.least("tile", "other"), entry)).alias("left"),
        F.collect_list(F.when(F.col("tile") > F.col("other"), entry)).alias("right"),
    )
    return tasks.select("left", "right").mapInArrow(_link(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` (0 to 3)
    differing bits, the document itself included.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the index holds for a radius of 0 to 3")
    prints = written(fingerprints(docs), "prints")
    entries = written(prints.groupBy("print").agg(F.min("doc_id").alias("rep")), "entries")
    roots = components(links(entries.filter("rep IS NOT NULL"), radius))
    classes = entries.join(roots, entries["rep"] == roots["node"], "left").select(
        "print", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t or b"") for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints.view(np.int64))], names=["doc_id", "t", "print"])


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``; rows without an id stay.

    Rows that repeat both ``doc_id`` and text are one document and stay or go together; rows that repeat
    only the ``doc_id`` are documents of their own, ordered by the hash of their text.
    """
    t = F.xxhash64(docs["text"])
    texts = docs.filter(docs["doc_id"].isNotNull()).select(
        docs["doc_id"].cast("long").alias("doc_id"), t.alias("t"), docs["text"].cast("binary").alias("text")
    )
    prints = written(texts.mapInArrow(_texts, "doc_id long, t long, print long"), "text-prints")
    entries = written(prints.select(F.col("print").alias("rep"), "print").distinct(), "print-entries")
    roots = components(links(entries, radius))
    classes = entries.join(roots, entries["rep"] == roots["node"], "left").select("print", F.coalesce("root", "rep").alias("root"))
    members = written(prints.join(classes, "print").select("root", "doc_id", "t"), "members")
    first = written(members.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("first")), "first-members")
    gone = (
        members.join(first, "root")
        .filter(F.struct("doc_id", "t") != F.col("first"))
        .select(F.col("doc_id").alias("__gone"), F.col("t").alias("__t"))
        .distinct()
    )
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (t == gone["__t"]), "left_anti")
