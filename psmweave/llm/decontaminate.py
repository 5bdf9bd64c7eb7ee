"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

Spark functions only. Texts are lower-cased and cut into words; a shingle is a run of five words (an
item with fewer words is one shingle of all its words).

1. Windows as long as an item slide over every text. A window whose similarity with an item is at
   least ``similarity`` shares ``similarity / (1 + similarity)`` of the shingles of both, so starts
   without that many benchmark shingles inside cannot pass and get no fingerprint. This loses nothing.
2. A window's 64-bit SimHash counts the set bits of its shingle hashes, weighted by how often a
   shingle occurs, in 16-bit lanes of 16 integers.
3. Four blocks of 16 bits index the fingerprints of the items. Of fingerprints at most ``radius`` bits
   apart one block differs in ``radius // 4`` bits at most. Items are listed under every block value within
   two bits, and a window looks up its block values with the flips that are left (two, for a radius of 19):
   all pairs within the radius meet.
4. These candidates are verified by their weighted Jaccard similarity, with a shingle's count in the
   window or item as its weight.

Recall: a window of similarity s differs from its item in each bit with probability
``arccos(2 s / (1 + s)) / pi``, 0.151 at 0.8, so of the pairs at exactly 0.8 about one in a thousand lies beyond
19 bits, and far fewer of those above. ``exact=True`` also compares pairs that meet through shingles they must
share (a window of n shingles that shares the k needed with an item has one of it among any n - k + 1 of its
own; the rarest of the benchmark are taken), which is brute force's result whatever the radius.

Windows of equal content are compared once, so a passage that a third of the corpus holds costs one
fingerprint. Shingle hashes of the benchmark, the list of texts with windows and the index are broadcast only
after counting them (``BROADCAST_ROWS``, ``INDEX_ROWS``); beyond that the same joins are shuffled.

Defined results: null, empty and blank texts match nothing; a text shorter than an item is one window; a null
``doc_id`` is a value like any other; rows that repeat ``doc_id`` and text count once, rows that share an id but
not a text are judged each on its own; items of one ``item_id`` give one row, that of the best window; items
under a null id are left out; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.store import written
from psmweave.llm.text import let, shingle_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4

#: Bits of a block that the index flips; the lookup flips the rest.
LISTED_FLIPS = 2

#: Rows (of a few hundred bytes at most) up to which a counted table is sent to every executor.
BROADCAST_ROWS = 100_000

#: Rows of the index (four numbers, at most 160 bytes each in memory) up to which it is sent to every executor.
INDEX_ROWS = 500_000

_LANES = 16
_LANE_BITS = 0x0001000100010001


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is set if in over half of them.

    Lane sums hold four 16-bit counters each, so arrays may have up to 32,767 elements; longer ones
    are summed in pieces of that size.
    """
    piece = 32_000

    def lanes(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array(*[F.lit(0).cast("bigint")] * _LANES),
            lambda acc, h: F.transform(
                acc, lambda a, k: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_LANE_BITS))
            ),
        )

    def bit_counts(part: Column) -> Column:
        return let(
            lanes(part),
            lambda acc: F.transform(
                F.sequence(F.lit(0), F.lit(63)),
                lambda b: F.call_function("shiftrightunsigned", acc[b % _LANES], (b / _LANES).cast("int") * 16).bitwiseAND(
                    F.lit(0xFFFF)
                ),
            ),
        )

    def total(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(piece))
        return F.aggregate(
            starts,
            F.array(*[F.lit(0).cast("bigint")] * 64),
            lambda acc, s: F.zip_with(acc, bit_counts(F.slice(h, s, F.lit(piece))), lambda a, c: a + c),
        )

    def pack(h: Column, counts: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("bigint"),
            lambda acc, b: F.when(
                2 * counts[b] > F.size(h), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
            ).otherwise(acc),
        )

    return let(hashes, lambda h: let(total(h), lambda c: pack(h, c)))


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")


def flips(bits: int, most: int) -> list[int]:
    """Every mask of ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger counts of equal elements, for two arrays of hashes."""

    def common(x: Column, y: Column) -> Column:
        """Elements common to two sorted arrays, with repeats, by one walk along both."""
        return F.aggregate(
            x,
            F.struct(F.lit(0).alias("n"), F.lit(1).alias("at")),
            lambda s, h: let(
                F.array_position(F.slice(y, s["at"], F.greatest(F.size(y) - s["at"] + 1, F.lit(0))), h).cast("int"),
                lambda p: F.when(p > 0, F.struct((s["n"] + 1).alias("n"), (s["at"] + p).alias("at"))).otherwise(s),
            ),
            lambda s: s["n"],
        )

    return let(
        common(F.sort_array(a), F.sort_array(b)),
        lambda n: n / (F.size(a) + F.size(b) - n).cast("double"),
    )


def _items(benchmark: DataFrame) -> DataFrame:
    cut = benchmark.select("item_id", words(F.lower("text")).alias("words")).filter(
        F.col("item_id").isNotNull() & (F.size("words") > 0)
    )
    by_width = reduce(
        lambda c, k: c.when(F.size("words") == k, shingle_hashes(F.col("words"), k)),
        range(1, SHINGLE),
        F.when(F.size("words") >= SHINGLE, shingle_hashes(F.col("words"), SHINGLE)),
    )
    return cut.select(
        F.monotonically_increasing_id().alias("row"),
        "item_id",
        F.size("words").alias("n_words"),
        F.least(F.size("words"), F.lit(SHINGLE)).alias("width"),
        by_width.alias("hashes"),
    )


def _starts(positions: Column, length: Column, size: Column, least: Column) -> Column:
    """Starts of windows of ``length`` shingles with ``least`` or more of the sorted positions inside."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(positions) - least),
                lambda i: let(
                    F.struct(
                        F.greatest(positions[i + least - 1] - length + 1, F.lit(0)).alias("low"),
                        F.least(positions[i], size - length).alias("high"),
                    ),
                    lambda r: F.when(r["low"] <= r["high"], F.sequence(r["low"], r["high"])).otherwise(
                        F.array().cast("array<int>")
                    ),
                ),
            )
        )
    )


def _counted(small: DataFrame, most: int | None = None) -> DataFrame:
    """``small`` for a broadcast if its rows are few enough, else for a sort-merge join."""
    bound = BROADCAST_ROWS if most is None else most
    return F.broadcast(small) if small.count() <= bound else small.hint("merge")


def text_hash(docs: DataFrame) -> Column:
    """Tells texts under one ``doc_id`` apart."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    exact: bool = False,
) -> DataFrame:
    """``doc_id, text_hash, item_id, start, n_words, similarity``: per text and item the best window.

    ``start`` is the window's first word (from 0), ``n_words`` its length; of equally similar windows
    the first is taken. ``exact`` adds the pairs beyond the radius.
    """
    if not 0 <= radius < 64:
        raise ValueError("the radius must lie between 0 and 63")
    items = written(_items(benchmark), "benchmark-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most SHINGLE values
    found = [
        _find(docs, items.filter(F.col("width") == k), k, similarity, radius, exact) for k in widths or [SHINGLE]
    ]
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b"))
        .select("doc_id", "text_hash", "item_id", (-F.col("b.s")).alias("start"), "b.n_words", "b.similarity")
    )


def _keys(fingerprint: Column, most: int) -> Column:
    """Block numbers and values within ``most`` flips of a fingerprint's four blocks, as one integer each."""
    masks = F.array(*[F.lit(m) for m in flips(16, most)])

    def of_block(k: int) -> Column:
        return let(block(fingerprint, k), lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m) + F.lit(k << 16)))

    return F.flatten(F.array(*[of_block(k) for k in range(BLOCKS)]))


def _least(window: Column, length: Column, similarity: float) -> Column:
    """Shingles that a window and an item must share to reach ``similarity``."""
    share = similarity / (1 + similarity)
    return F.greatest(F.ceil((window + length) * F.lit(share) - 1e-9), F.lit(1)).cast("int")


def _windows(docs: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id, text_hash, length, start, hashes``: windows that hold enough shingles of items of ``length`` shingles."""
    lengths = items.select(F.explode("hashes").alias("h"), F.size("hashes").alias("length")).distinct()
    texts = docs.select("doc_id", text_hash(docs).alias("text_hash"), "text")
    seeds = written(
        texts.select(
            "doc_id", "text_hash", F.posexplode(shingle_hashes(words(F.lower("text")), width)).alias("pos", "h")
        )
        .join(_counted(lengths), "h")
        .groupBy("doc_id", "text_hash", "length")
        .agg(F.sort_array(F.collect_set("pos")).alias("positions")),
        "seeds",
    )
    window = F.least(F.col("length"), F.size("hashes"))
    least = _least(window, F.col("length"), similarity)
    starts = _starts(F.col("positions"), F.col("window"), F.size("hashes"), F.col("least"))
    return (
        texts.join(_counted(seeds), _same_text(texts, seeds))
        .select(texts["doc_id"], texts["text_hash"], "length", "positions", shingle_hashes(words(F.lower("text")), width).alias("hashes"))
        .select("*", window.alias("window"), least.alias("least"))
        .filter(F.size("positions") >= F.col("least"))
        .select("doc_id", "text_hash", "length", "window", "hashes", F.explode(starts).alias("start"))
        .select("doc_id", "text_hash", "length", "start", F.slice("hashes", F.col("start") + 1, F.col("window")).alias("hashes"))
    )


def _near(contents: DataFrame, listed: DataFrame, radius: int) -> DataFrame:
    """``window, row``: windows and items of one length whose fingerprints differ in ``radius`` bits at most."""
    most = radius // BLOCKS
    index = written(
        listed.select("row", "length", simhash(F.col("item_hashes")).alias("item_print")).select(
            "row", "length", "item_print", F.explode(_keys(F.col("item_print"), min(most, LISTED_FLIPS))).alias("key")
        ),
        "fingerprint-index",
    )
    prints = written(contents.select("length", "window", simhash(F.col("hashes")).alias("print")), "prints")
    return (
        prints.select("length", "window", "print", F.explode(_keys(F.col("print"), max(most - LISTED_FLIPS, 0))).alias("key"))
        .join(_counted(index, INDEX_ROWS), ["length", "key"])
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("window", "row")
    )


def _sharing(contents: DataFrame, listed: DataFrame, similarity: float) -> DataFrame:
    """``window, row``: pairs that share one of the window's shingles that are rarest in the benchmark."""
    shingles = listed.select("length", "row", F.explode(F.array_distinct("item_hashes")).alias("h"))
    holders = shingles.groupBy("length", "h").agg(F.count("*").alias("items"))
    spare = F.size("ranked") - _least(F.size("ranked"), F.col("length"), similarity) + 1
    rarest = (
        contents.select("window", "length", F.explode("hashes").alias("h"))
        .join(holders, ["length", "h"], "left")
        .groupBy("window", "length")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("items", F.lit(0)).alias("items"), "h"))).alias("ranked"))
        .select("window", "length", F.explode(F.array_distinct(F.slice("ranked", F.lit(1), spare))).alias("at"))
        .select("window", "length", "at.h")
    )
    return rarest.join(shingles, ["length", "h"]).select("window", "row")


def _find(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int, exact: bool) -> DataFrame:
    windows = written(_windows(docs, items, width, similarity), "windows")
    contents = written(windows.select("length", "hashes").distinct().withColumn("window", F.monotonically_increasing_id()), "contents")
    listed = items.select("row", "item_id", F.size("hashes").alias("length"), F.col("hashes").alias("item_hashes"))
    pairs = _near(contents, listed, radius)
    if exact:
        pairs = pairs.unionAll(_sharing(contents, listed, similarity))
    matches = (
        pairs.distinct()
        .join(contents.drop("length"), "window")
        .join(listed, "row")
        .withColumn("similarity", weighted_jaccard(F.col("hashes"), F.col("item_hashes")))
        .filter(F.col("similarity") >= similarity)
        .select("length", "hashes", "item_id", "similarity")
    )
    return windows.join(matches, ["length", "hashes"]).select(
        "doc_id", "text_hash", "item_id", "start", (F.size("hashes") + width - 1).alias("n_words"), "similarity"
    )


def drop_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents whose text holds no leak, with their columns unchanged."""
    gone = leaks.select(F.col("doc_id").alias("__leaked"), F.col("text_hash").alias("__leaked_text")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__leaked"]) & (text_hash(docs) == gone["__leaked_text"])
    return docs.join(gone, same, "left_anti")
