"""Ranked lexical search without random access (NRA) over impact-sorted lists.

1. One pass cuts every text into terms and keeps, per document, the number of all its terms and how often
   each term of the queries occurs in it. A bitmap of fixed size tells which terms those may be.
2. Document counts and lengths are summed over all documents; a term's weight follows.
3. The documents of a task are searched shard by shard. A shard holds, for every query term, the list of
   its documents sorted by impact. For each query the lists are read in sequence, from high impacts to low:
   what has been read of a document is its lower bound, and the next unread impact of every list in which
   it hasn't been seen yet is added for its upper bound. Reading goes on until no unseen document can enter,
   no other one can reach the last rank, and the bounds of all that can have met: membership, ties and
   scores are final. The scores of a task's earlier shards bound the later ones.
4. The best of all tasks are merged. A list of the best of a part is whole, so is the merged one.

Documents never move; only their best per query do, so a term that every document has, or copies by the
thousand, meet in no common task. Queries are sent in blocks of bounded size, each against all documents.

Defined results: null and empty texts and queries have no terms, match nothing, and count neither for the
number of documents nor their length. Every row of the queries is ranked for itself, also repeated ones;
every row of the documents is a document, so rows that repeat an id can hold several ranks. Ids may be
null; a null ``doc_id`` comes last among equal scores. Empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psmweave.llm import marks
from psmweave.llm.store import written

TOP = 10

#: Terms of queries that are sent to the executors at once; more queries make more passes.
BLOCK_TERMS = 1 << 18

#: Occurrences of query terms of one shard.
SHARD = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The same on UTF-8: bytes of ASCII that belong to no term become blanks, capitals small letters.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_REMEMBERED = 200_000


def terms(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


# -- documents ----------------------------------------------------------------------------


class _Held(dict):
    """Whether a term, as bytes, may be one of the queries'; remembers short ones."""

    def __init__(self, wanted: bytes) -> None:
        self.wanted = wanted

    def __missing__(self, term: bytes) -> bool:
        at = marks.slot_of(term)
        held = bool(self.wanted[at >> 3] >> (at & 7) & 1)
        if len(term) < 64:
            if len(self) > _REMEMBERED:
                self.clear()
            self[term] = held
        return held


def _counts(wanted: bytes):
    """Texts to their number of terms and the counts of those that queries may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Held(wanted)
        for batch in batches:
            lengths, names, sizes, offsets = [], [], [], [0]
            for text in batch.column(1):
                found = text.as_py().translate(_BYTES).split()
                for term, n in Counter(found).items():
                    if known[term]:
                        names.append(term)
                        sizes.append(n)
                lengths.append(len(found))
                offsets.append(len(names))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(at, pa.array(sizes, pa.int64()))],
                names=["doc_id", "n", "terms", "tf"],
            )

    return run


# -- one shard ----------------------------------------------------------------------------


@dataclass
class Query:
    """A query's terms, as places in the block's list of terms, and what an impact counts for it."""

    row: int
    places: np.ndarray
    weights: np.ndarray


@dataclass
class Block:
    terms: list[str] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard and their scores: all that can be among the best ``top``, ties included.

    ``lists`` holds documents and falling impacts, each document once per list. ``floor`` is a score that
    the last rank reaches already.
    """
    lower = np.zeros(size, np.int64)
    seen = np.zeros((len(lists), size), bool)
    read = [0] * len(lists)
    reach = max((int(i[0]) for _, i in lists if len(i)), default=0)
    while True:
        reach //= 2
        front = np.zeros(len(lists), np.int64)
        for k, (docs, impacts) in enumerate(lists):
            stop = int(np.searchsorted(-impacts, -reach, side="left"))  # all impacts above ``reach``
            if stop > read[k]:
                part = docs[read[k] : stop]
                lower[part] += impacts[read[k] : stop]
                seen[k, part] = True
                read[k] = stop
            if stop < len(impacts):
                front[k] = impacts[stop]
        unseen = int(front.sum())
        last = max(floor, int(np.partition(lower, size - top)[size - top]) if size >= top else 0)
        if unseen and unseen >= last:
            continue  # a document that hasn't been seen may still enter, or tie
        open_ = np.flatnonzero((lower > 0) & (lower + unseen >= last))
        upper = lower[open_] + front @ ~seen[:, open_]
        open_, upper = open_[upper >= last], upper[upper >= last]
        if not unseen or np.array_equal(upper, lower[open_]):
            return open_, lower[open_]


class _Best:
    """The best documents per query of a task so far, as sorted (-score, no id, id)."""

    def __init__(self, block: Block, top: int) -> None:
        self.block, self.top = block, top
        self.rows: dict[int, list[tuple]] = {}
        self.value_set = pa.array(block.terms, pa.string())

    def add(self, batch: pa.RecordBatch, count: int, length: int) -> None:
        ids, n, terms_, tf = batch.columns
        size = batch.num_rows
        places = pc.index_in(terms_.flatten(), self.value_set)
        docs = np.repeat(np.arange(size), pc.list_value_length(terms_).to_numpy(zero_copy_only=False))
        here = pc.is_valid(places).to_numpy(zero_copy_only=False)
        term, doc = places.fill_null(0).to_numpy()[here], docs[here]
        m = 25 + 75 * n.to_numpy() * count // length
        often = tf.flatten().to_numpy()[here]
        impact = 1_000_000_000 * often // (1000 * often + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order], impact[order]
        edges = np.searchsorted(term[order], np.arange(len(self.block.terms) + 1))
        for q in self.block.queries:
            lists = []
            for place, weight in zip(q.places, q.weights):
                a, b = edges[place], edges[place + 1]
                if b > a:
                    lists.append((doc[a:b], weight * impact[a:b]))
            if lists:
                self._merge(q.row, ids, *nra(lists, size, self._floor(q.row), self.top))

    def _floor(self, row: int) -> int:
        best = self.rows.get(row, ())
        return -best[-1][0] if len(best) == self.top else 0

    def _merge(self, row: int, ids: pa.Array, docs: np.ndarray, scores: np.ndarray) -> None:
        if not len(docs):
            return
        key = pc.fill_null(ids, 0).to_numpy()[docs]
        none = pc.is_null(ids).to_numpy(zero_copy_only=False)[docs]
        first = np.lexsort((key, none, -scores))[: self.top]
        new = zip((-scores[first]).tolist(), none[first].tolist(), key[first].tolist())
        self.rows[row] = sorted([*self.rows.get(row, ()), *new])[: self.top]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, None if none else i, -s) for q, best in self.rows.items() for s, none, i in best]
        columns = zip(*rows) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "score"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``SHARD`` occurrences."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SHARD, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


# -- queries ------------------------------------------------------------------------------


def _blocks(weighted: DataFrame) -> Iterator[Block]:
    """Queries in blocks; the driver holds one at a time."""
    block, place = Block(), {}
    held = 0
    for r in weighted.toLocalIterator():
        if held and held + len(r["terms"]) > BLOCK_TERMS:
            yield block
            block, place, held = Block(), {}, 0
        at = [place.setdefault(t["term"], len(place)) for t in r["terms"]]
        block.terms += list(place)[len(block.terms) :]
        block.queries.append(Query(r["row"], np.array(at), np.array([t["weight"] for t in r["terms"]], np.int64)))
        held += len(at)
    if held:
        yield block


def _best(order: list, top: int, found: DataFrame) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return found.withColumn("rank", ranks).filter(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``top`` documents for every row of ``queries``."""
    spark = docs.sparkSession
    asked = written(
        queries.select(F.monotonically_increasing_id().alias("row"), "item_id", terms(F.col("text")).alias("terms")), "queries"
    )
    wanted = asked.select("row", F.explode("terms").alias("term")).groupBy("row", "term").agg(F.count("*").alias("q"))
    held = marks.collected(marks.bitmap(wanted, "term"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kinds = "doc_id long, n long, terms array<string>, tf array<long>"
    vectors = written(texts.mapInArrow(_counts(held), kinds).filter("n > 0"), "term-counts")
    count, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.floor(1000 * F.log((2 * F.lit(count) + 2) / (2 * F.col("df") + 1)))
    weighted = written(
        wanted.join(df, "term")
        .select("row", "term", (F.col("q") * rarity).alias("weight"))
        .filter("weight > 0")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")),
        "weighted-queries",
    )

    def searched(block: Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(sent.value, top)
            for shard in _shards(batches):
                best.add(shard, count, length)
            yield best.batch()

        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        found = vectors.mapInArrow(run, "row long, doc_id long, score long")
        return written(_best(order, top, found), "ranked")

    none = spark.createDataFrame([], "row long, doc_id long, score long, rank int")
    ranked = reduce(DataFrame.unionByName, map(searched, _blocks(weighted)), none)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
