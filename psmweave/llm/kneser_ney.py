"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped arrays.

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a text is its words and one end
token, and its first word follows a start token that is never scored.

1. Words are hashed to 64 bits in whole buffers. Each task counts its words; Spark shuffles the counts to
   shards of the hash range, which are summed and written as sorted hash arrays. A word's number is its
   place in them.
2. Each task counts its pairs of word numbers; Spark shuffles them to shards by a scrambled key, so that a
   frequent word's pairs spread over all shards. They are summed and written as sorted key arrays, and
   what each pair tells about its first word (followers seen once, twice, more often) and its second
   word (distinct predecessors) is shuffled back to the shards of the words.
3. Workers map the arrays of the shared folder and look up the distinct words and pairs of a chunk of
   texts by binary search. Nothing of the model passes through the driver but a few figures per shard.

With discounts D1, D2, D3+ from counts of counts at either order, t(v) the pairs that begin with v, and
N1+ the number of distinct predecessors:
p(w) = (N1+(w) - D(N1+(w))) / types + g0 / (V + 1),
p(w | v) = (c(v w) - D(c(v w))) / t(v) + g(v) p(w), and p(w) after a word never followed in training.

Defined results: null, empty and blank texts are one end token; rows with a null ``doc_id`` train;
repeated rows count as often as they stand there; with no training text every probability is that of
an unknown word; other columns are not read. The model holds at most 2**32 distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.shards import distinct, load, mix, pack, save, shard_of, summed, unpack
from psmweave.runtime import scratch_path

CHUNK = 1 << 20
#: Distinct words or pairs a task holds before it hands them to the shuffle.
HELD = 3_000_000

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
START, END = np.uint64(1), np.uint64(2)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK + 4096)
        _powers = np.concatenate(([np.uint64(1)], np.full(size - 1, _STEP))).cumprod(dtype=np.uint64)
        _inverse = np.concatenate(([np.uint64(1)], np.full(size - 1, _BACK))).cumprod(dtype=np.uint64)
    return _powers, _inverse


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer that ends in a blank, and where they start."""
    raw = np.frombuffer(data, np.uint8)
    blank = _IS_BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _power_tables(len(raw))
    sums = np.cumsum(_LETTER[raw] * powers[: len(raw)], dtype=np.uint64)
    total = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix(total * inverse[starts] + (ends - starts).astype(np.uint64)), starts


@dataclass
class Tokens:
    """Tokens of a chunk, the token before each, and the number of the text each belongs to."""

    token: np.ndarray
    before: np.ndarray
    text: np.ndarray


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes, bool, bool]]:
    """``(text, piece, first, last)``; long texts are cut at blanks."""
    for i, t in enumerate(texts):
        t = t or b""
        at = 0
        while len(t) - at > CHUNK and (m := _BLANK.search(t, at + CHUNK)):
            yield i, t[at : m.end()], at == 0, False
            at = m.end()
        yield i, t[at:], at == 0, True


def tokens(texts: list[bytes | None]) -> Iterator[Tokens]:
    """All tokens of the texts, in chunks."""
    held: list[tuple[int, bytes, bool, bool]] = []
    size, carry = 0, START

    def flush() -> Tokens:
        nonlocal carry
        lengths = np.array([len(p[1]) + 1 for p in held])
        hashes, starts = word_hashes(b"\n".join(p[1] for p in held) + b"\n")
        bounds = np.cumsum(lengths)
        upto = np.searchsorted(starts, bounds)  # words up to the end of each piece
        last = np.array([p[3] for p in held])
        token = np.insert(hashes, upto[last], END)
        n = np.diff(np.concatenate(([0], upto))) + last
        before = np.concatenate(([carry], token[:-1])) if len(token) else token
        first_token = np.concatenate(([0], np.cumsum(n)[:-1]))
        opens = first_token[[p[2] and k > 0 for p, k in zip(held, n)]]
        before[opens] = START
        if len(token):
            carry = token[-1]
        return Tokens(token, before, np.repeat([p[0] for p in held], n))

    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# counting


class _Counter:
    """Sums counts by key and hands them out by shard when many are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def full(self) -> bool:
        if self.size > 2 * HELD:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
        return self.size > HELD

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return summed(*(np.concatenate([p[k] for p in self.parts]) for k in (0, 1)))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers with the places of their entries, in order."""
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    for s, part in zip(found.tolist(), np.split(order, first[1:])):
        yield s, part


def _count_words(n_shards: int):
    def rows(counter: _Counter) -> pa.RecordBatch:
        keys, counts = counter.total()
        parts = list(_by_shard(shard_of(keys, n_shards)))
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in parts], pa.int32()), pa.array([pack(keys[p]) for _, p in parts], pa.binary()),
             pa.array([pack(counts[p]) for _, p in parts], pa.binary())], names=["shard", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for t in tokens(batch.column(0).to_pylist()):
                counter.add(*distinct(t.token))
                counter.add(np.array([START]), np.zeros(1, np.int64))
                if counter.full():
                    yield rows(counter)
                    counter = _Counter()
        yield rows(counter)

    return run


def _sum_words(folder: str):
    def run(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        keys, counts = summed(
            np.concatenate([unpack(x, "<u8") for x in part["keys"].to_pylist()]),
            np.concatenate([unpack(x, "<i8") for x in part["counts"].to_pylist()]),
        )
        save(folder, f"words-{shard}", keys)
        save(folder, f"counts-{shard}", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "known": [int((counts > 0).sum())], "total": [int(counts.sum())]})

    return run


@dataclass
class Words:
    """Where the words are: entries of each shard and the number of each shard's first word."""

    folder: str
    sizes: np.ndarray
    offsets: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct hashes; -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        cut = np.searchsorted(shard_of(hashes, len(self.sizes)), np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            mine = hashes[cut[s] : cut[s + 1]]
            known = load(self.folder, f"words-{s}", "<u8", int(self.sizes[s]))
            at = np.searchsorted(known, mine)
            if len(known):
                found = known[np.minimum(at, len(known) - 1)] == mine
                out[cut[s] : cut[s + 1]] = np.where(found, at + self.offsets[s], -1)
        return out

    def values(self, name: str, numbers: np.ndarray, dtype: str) -> np.ndarray:
        """An array's values for sorted word numbers; 0 for unknown words (which come first)."""
        out = np.zeros(len(numbers), dtype)
        cut = np.searchsorted(numbers, np.concatenate((self.offsets, [self.offsets[-1] + self.sizes[-1]])))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            mine = slice(cut[s], cut[s + 1])
            out[mine] = load(self.folder, f"{name}-{s}", dtype, int(self.sizes[s]))[numbers[mine] - self.offsets[s]]
        return out


def _pairs(t: Tokens, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a chunk, their numbers, and the place of each token and predecessor in them."""
    hashes = distinct(np.concatenate((t.token, t.before)))[0]
    return hashes, words.numbers(hashes), np.searchsorted(hashes, np.concatenate((t.before, t.token))).reshape(2, -1)


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)


def _count_pairs(words: Words, n_shards: int):
    def rows(counter: _Counter) -> pa.RecordBatch:
        keys, counts = counter.total()
        parts = list(_by_shard(shard_of(mix(keys), n_shards)))
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in parts], pa.int32()),
             pa.array([pack(np.diff(keys[p] >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32)) for _, p in parts], pa.binary()),
             pa.array([pack(keys[p].astype(np.uint32)) for _, p in parts], pa.binary()),
             pa.array([pack(counts[p]) for _, p in parts], pa.binary())], names=["shard", "first", "second", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for t in tokens(batch.column(0).to_pylist()):
                _, number, (before, token) = _pairs(t, words)
                counter.add(*distinct(_key(number[before], number[token])))
                if counter.full():
                    yield rows(counter)
                    counter = _Counter()
        yield rows(counter)

    return run


def _sum_pairs(folder: str, words: Words):
    def run(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        keys = [
            np.cumsum(unpack(a, "<u4"), dtype=np.uint64) << np.uint64(32) | unpack(b, "<u4").astype(np.uint64)
            for a, b in zip(part["first"].to_pylist(), part["second"].to_pylist(), strict=True)
        ]
        keys, counts = summed(np.concatenate(keys), np.concatenate([unpack(x, "<i8") for x in part["counts"].to_pylist()]))
        save(folder, f"pairs-{shard}", keys)
        wide = bool(len(counts)) and int(counts.max()) >= 1 << 32
        save(folder, f"pair-counts-{shard}", counts.astype("<i8" if wide else "<u4"))
        out: list[tuple] = [(-1, shard, [len(keys), int(wide), *(int((counts == k).sum()) for k in (1, 2, 3, 4))], b"", b"", b"", b"", b"", b"")]
        first = (keys >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(keys) else np.empty(0, np.int64)
        sums = [np.add.reduceat(x.astype(np.int64), start) if len(start) else start for x in (counts, counts == 1, counts == 2, counts >= 3)]
        for s, p in _by_shard(np.searchsorted(words.offsets, first[start], "right") - 1):
            local = (first[start][p] - words.offsets[s]).astype(np.uint32)
            out.append((s, 0, [], pack(np.diff(local, prepend=np.uint32(0)).astype(np.uint32)), *(pack(x[p]) for x in sums), b""))
        second, predecessors = distinct((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        for s, p in _by_shard(np.searchsorted(words.offsets, second, "right") - 1):
            local = (second[p] - words.offsets[s]).astype(np.uint32)
            out.append((s, 1, [], pack(np.diff(local, prepend=np.uint32(0)).astype(np.uint32)), b"", b"", b"", b"", pack(predecessors[p])))
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
        names = ["shard", "kind", "figures", "local", "total", "once", "twice", "more", "predecessors"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out), types)})

    return run


_STATS = "shard int, kind int, figures array<long>, local binary, total binary, once binary, twice binary, more binary, predecessors binary"


def _sum_stats(folder: str, words: Words):
    def run(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        if shard < 0:
            return pa.table({"shard": part["kind"].cast(pa.int32()), "kind": pa.array([0] * part.num_rows, pa.int32()), "figures": part["figures"]})
        n = int(words.sizes[shard])
        sums = {k: np.zeros(n, np.int64) for k in ("total", "once", "twice", "more", "predecessors")}
        for row in part.select(["kind", "local", *sums]).to_pylist():
            local = np.cumsum(unpack(row["local"], "<u4"), dtype=np.int64)
            for k in ("predecessors",) if row["kind"] else ("total", "once", "twice", "more"):
                sums[k][local] += unpack(row[k], "<i8")  # distinct within a row
        for k, x in sums.items():
            save(folder, f"{k}-{shard}", x)
        c = sums["predecessors"]
        figures = [int(c.sum()), int((c >= 3).sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]
        return pa.table({"shard": pa.array([shard], pa.int32()), "kind": pa.array([1], pa.int32()), "figures": pa.array([figures], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many entries occur once to four times; 1/2, 1, 3/2 where the counts don't tell."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else (k + 1) / 2
        out.append(min(max(d, 0.0), k + 1.0))
    return out


def discount(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


@dataclass
class Model:
    """A trained model: figures here, arrays in ``folder``."""

    folder: str
    words: Words
    pair_sizes: np.ndarray
    pair_wide: np.ndarray
    train_tokens: int
    vocabulary: int
    types: int
    low: list[float]
    high: list[float]
    spread: float  # g0: the share of probability the discounts free at the lower order

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for s, p in _by_shard(shard_of(mix(keys), len(self.pair_sizes))):
            n = int(self.pair_sizes[s])
            if n:
                known = load(self.folder, f"pairs-{s}", "<u8", n)
                at = np.minimum(np.searchsorted(known, keys[p]), n - 1)
                counts = load(self.folder, f"pair-counts-{s}", "<i8" if self.pair_wide[s] else "<u4", n)
                out[p] = np.where(known[at] == keys[p], counts[at], 0)
        return out

    def word_figures(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """Figures of sorted distinct hashes, in their order."""
        number = self.words.numbers(hashes)
        order = np.argsort(number, kind="stable")
        out = {"number": number}
        for k in ("counts", "total", "once", "twice", "more", "predecessors"):
            out[k] = np.zeros(len(hashes), np.int64)
            out[k][order] = self.words.values(k, number[order], "<i8")
        return out

    def log10(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of every token."""
        hashes = distinct(np.concatenate((t.token, t.before)))[0]
        at = np.searchsorted(hashes, t.token)
        prior = np.searchsorted(hashes, t.before)
        f = self.word_figures(hashes)
        single = self.spread / (self.vocabulary + 1)
        if self.types:
            single = single + (f["predecessors"] - discount(f["predecessors"], self.low)) / self.types
        else:
            single = np.full(len(hashes), single)
        known = (f["number"][at] >= 0) & (f["number"][prior] >= 0)
        pair = np.zeros(len(at), np.int64)
        keys = _key(f["number"][prior[known]], f["number"][at[known]])
        if len(keys):
            some, back = np.unique(keys, return_inverse=True)
            pair[known] = self.pair_counts(some)[back]
        total = f["total"]
        freed = self.high[0] * f["once"] + self.high[1] * f["twice"] + self.high[2] * f["more"]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(total > 0, freed / total, 1.0)[prior]
            own = np.where(total[prior] > 0, (pair - discount(pair, self.high)) / total[prior], 0.0)
        return np.log10(own + share * single[at]), f["counts"][at]


def train(docs: DataFrame) -> Model:
    """Count the words and pairs of ``docs.text`` and write the model to the shared folder."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "kneser-ney")
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_count_words(n), "shard int, keys binary, counts binary")
    found = counted.groupBy("shard").applyInArrow(_sum_words(folder), "shard int, n long, known long, total long").collect()
    sizes = np.zeros(n, np.int64)
    for r in found:
        sizes[r.shard] = r.n
    if sizes.sum() >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    words = Words(folder, sizes, np.concatenate(([0], np.cumsum(sizes)[:-1])))
    pairs = texts.mapInArrow(_count_pairs(words, n), "shard int, first binary, second binary, counts binary")
    stats = pairs.groupBy("shard").applyInArrow(_sum_pairs(folder, words), _STATS)
    figures = stats.groupBy("shard").applyInArrow(_sum_stats(folder, words), "shard int, kind int, figures array<long>").collect()
    pair_sizes, wide = np.zeros(n, np.int64), np.zeros(n, bool)
    low, high, types, often = np.zeros(4, np.int64), np.zeros(4, np.int64), 0, 0
    for r in figures:
        if r.kind:
            types += r.figures[0]
            often += r.figures[1]
            low += r.figures[2:]
        else:
            pair_sizes[r.shard], wide[r.shard] = r.figures[:2]
            high += r.figures[2:]
    d_low = discounts(low.tolist())
    spread = (d_low[0] * low[0] + d_low[1] * low[1] + d_low[2] * often) / types if types else 1.0
    return Model(
        folder, words, pair_sizes, wide, sum(r.total for r in found), sum(r.known for r in found), types,
        d_low, discounts(high.tolist()), float(spread),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row ``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smooth = np.log10(model.train_tokens + model.vocabulary + 1)
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for t in tokens(batch.column(1).to_pylist()):
                logs, counts = model.log10(t)
                for k, x in enumerate((None, counts > 0, np.log10(counts + 1) - smooth, logs)):
                    sums[k] += np.bincount(t.text, x, n)
            whole = [pa.array(sums[k].astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *whole, pa.array(np.full(n, model.train_tokens)), pa.array(sums[2]), pa.array(sums[3])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
