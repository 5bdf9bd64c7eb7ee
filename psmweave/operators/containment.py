"""Which peptides occur in a protein database.

A first pass over the proteins looks at seeds at every ``stride``-th letter and stores where the seeds of
some peptide lie; a peptide looks up ``stride`` consecutive seeds of its own, so every occurrence
meets one stored seed.  Each peptide uses its rarest run of seeds, which keeps frequent words from pairing
everything with everything.  A second pass checks the whole peptide at the place that its seed gives; only
a seed's neighbours travel with it, so a long peptide costs nothing but its own length.  Peptides too short for
seeds are found whole in the first pass.  Letters are compared as bytes of UTF-8, where a text holds a
word exactly if its bytes hold the word's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from psmweave.functions import peptide as P
from psmweave.operators.training import _map_blocks
from psmweave.runtime import checkpoint

SEED = 8
STRIDE = 4
KEY = 4  # letters that are looked for before a short peptide's own length
_SEEDS, _KEYS = 0, -1  # kinds of words; short peptides have their length as kind
_BITS = 23  # bits of the filter of words; one MB, whatever it holds
_BLOCK = 1 << 17  # letters looked at together


def _plain(c: str, equate_il: bool) -> Column:
    text = F.col(c)
    return (F.replace(text, F.lit("L"), F.lit("I")) if equate_il else text).cast("binary")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, with some behind them, and where each value ends, after a zero."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(2 * SEED, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([data, np.zeros(2 * SEED, np.uint8)]), ends - ends[0]


def _heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _slots(heads: np.ndarray, at: np.ndarray | slice, n: int, kind: int) -> np.ndarray:
    """The bit of the word of ``n`` bytes at each place."""
    h = heads[at] & np.uint64((1 << 8 * min(n, 8)) - 1)
    if n > 8:
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) ^ heads[at + (n - 8)]
    h ^= h >> np.uint64(32)
    h += np.uint64(kind + 1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - _BITS)).view(np.int64)


def _cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The bytes between each two places."""
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    at = np.repeat(start - ends[:-1], stop - start) + np.arange(ends[-1])
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.binary(), len(start), buffers)


def _strides(ends: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Every ``STRIDE``-th place of each text, as far as it lies between two places."""
    row = np.arange(np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left"))
    first = ends[row] - np.maximum(lo - ends[row], 0) // -STRIDE * STRIDE
    n = np.maximum(-((first - np.minimum(hi, ends[row + 1])) // STRIDE), 0)
    return np.repeat(first - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum())


def _word_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of wanted words, counted from 1."""
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        data, ends = _joined(batch.column("word"))
        for kind in np.unique(kinds):
            of = np.flatnonzero(kinds == kind)
            slots = _slots(_heads(data), ends[of], int(ends[of[0] + 1] - ends[of[0]]), int(kind))
            yield pa.RecordBatch.from_arrays([pa.array(slots + 1)], ["slot"])


def _filter_bits(wanted: DataFrame) -> bytes:
    """One bit per wanted word; some words share theirs, which lets a few others through."""
    slots = wanted.mapInArrow(_word_slots, "slot long")
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    whole = np.zeros(1 << _BITS - 3, np.uint8)
    for r in bits.collect():  # at most 256 rows of 4 KB
        part = np.frombuffer(r["bits"], np.uint8)
        whole[(r["bucket"] - 1) * len(part) :][: len(part)] = part
    return whole.tobytes()


def _scan(sent: Broadcast, seeds: bool, short: Sequence[int], names: Sequence[str]):
    """Finds the places in proteins whose words are in the filter."""

    def found(wanted: np.ndarray, ids: pa.Array, data: np.ndarray, ends: np.ndarray, lo: int) -> Iterator[list[pa.Array]]:
        heads, hi = _heads(data), min(lo + _BLOCK, int(ends[-1]))

        def places(kind: int, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            """Where a word of a kind lies within a text, and the text's number."""
            hit = wanted[_slots(heads, slice(lo, hi) if at is None else at, n, kind)]
            at = np.flatnonzero(hit) + lo if at is None else at[hit]
            row = np.searchsorted(ends, at, "right") - 1
            fits = at + n <= ends[row + 1]
            return at[fits], row[fits]

        if seeds:
            at, row = places(_SEEDS, SEED, _strides(ends, lo, hi))
            yield [
                ids.take(pa.array(row)), _cut(data, at, at + SEED), pa.array(at - ends[row]),
                _cut(data, np.maximum(at - SEED, ends[row]), at),
                _cut(data, at + SEED, np.minimum(at + 2 * SEED, ends[row + 1])),
            ]
        keyed = places(_KEYS, KEY)[0] if any(n >= KEY for n in short) else None
        for n in short:
            at, row = places(n, n, keyed if n >= KEY else None)
            once = pa.table({"row": row, "word": _cut(data, at, at + n)}).group_by(["row", "word"], use_threads=False).aggregate([])
            none = [pa.nulls(len(once), t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield [ids.take(once["row"].combine_chunks()), once["word"].combine_chunks(), *none]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            data, ends = _joined(batch.column(1))
            for lo in range(0, int(ends[-1]), _BLOCK):
                for columns in found(wanted, batch.column(0), data, ends, lo):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _found_words(proteins: DataFrame, wanted: DataFrame, seeds: bool, short: Sequence[int]) -> DataFrame:
    """``protein_id, word, at, before, after`` for the words that some peptide wants.

    ``at`` counts the bytes before a seed, ``before`` and ``after`` are up to eight on its sides; these are null for
    short peptides.
    """
    sent = proteins.sparkSession.sparkContext.broadcast(_filter_bits(wanted))
    kind = StructType([proteins.schema["protein_id"]]).add("word", "binary").add("at", "long")
    kind = kind.add("before", "binary").add("after", "binary")
    # No filter: it would work the letters out once more, before the rows are spread.
    whole = proteins.select("protein_id", F.coalesce("_seq", F.lit(b"")))
    rows = _map_blocks(whole, _scan(sent, seeds, short, kind.names), kind)
    return rows.join(wanted.select("word").distinct(), "word", "left_semi")


def _peptide_seeds(peptides: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest run of STRIDE consecutive seeds of each peptide, with what stands on their sides."""
    offsets = F.sequence(F.lit(0), F.length("_pep") - SEED)
    every = peptides.select("_pep", F.explode(offsets).alias("off")).withColumn(
        "seed", F.substring(F.col("_pep"), F.col("off") + 1, F.lit(SEED))
    )
    known = (
        every.join(counts, "seed", "left")
        .groupBy("_pep")
        .agg(F.array_sort(F.collect_list(F.struct("off", "seed", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    )  # at most one entry per letter of the peptide
    runs = F.transform(
        F.sequence(F.lit(1), F.size("s") - (STRIDE - 1)),
        lambda i: F.struct(
            F.aggregate(F.slice("s", i, STRIDE), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("cost"),
            i.alias("i"),
        ),
    )
    best = known.withColumn("_r", F.array_min(runs)).filter(F.col("_r.cost") > 0)
    off, letters = F.col("off"), F.col("_pep")
    return best.select("_pep", F.inline(F.slice("s", F.col("_r.i"), F.lit(STRIDE)))).filter("n > 0").select(
        "_pep", "off", "seed",
        F.substring(letters, F.greatest(off - SEED, F.lit(0)) + 1, F.least(off, F.lit(SEED))).alias("left"),
        F.substring(letters, off + SEED + 1, F.lit(SEED)).alias("right"),
    )


def kmer_contains_join(
    peptides: DataFrame, proteins: DataFrame, equate_il: bool = True
) -> DataFrame:
    """Distinct (peptide, protein_id) where the protein contains the peptide.

    ``peptides`` has ``peptide`` (plain letters), ``proteins`` has ``protein_id, sequence``.
    Exact for every length.
    """
    pep = peptides.select("peptide").distinct().withColumn("_pep", _plain("peptide", equate_il))
    pep = pep.filter(F.length("_pep") > 0)
    prot = proteins.select("protein_id", _plain("sequence", equate_il).alias("_seq"))
    need = SEED + STRIDE - 1
    pep = checkpoint(pep)
    # One row: the distinct short lengths (fewer than ``need``) and whether there are others.
    short_len = F.when(F.length("_pep") < need, F.length("_pep"))
    stats = pep.agg(F.sort_array(F.collect_set(short_len)).alias("short"), F.max(F.length("_pep") >= need).alias("long")).first()
    if not stats.short and not stats.long:
        return proteins.select(F.lit(None).cast("string").alias("peptide"), "protein_id").limit(0)
    long = pep.filter(F.length("_pep") >= need).select("_pep").distinct()
    brief = pep.filter(F.length("_pep") < need).select(F.col("_pep").alias("word")).distinct()
    offsets = F.sequence(F.lit(1), F.length("_pep") - SEED + 1)
    wanted = long.select(
        F.lit(_SEEDS).alias("kind"),
        F.explode(F.transform(offsets, lambda i: F.substring(F.col("_pep"), i, F.lit(SEED)))).alias("word"),
    ).unionAll(brief.select(F.length("word"), "word")).unionAll(
        brief.filter(F.length("word") >= KEY).select(F.lit(_KEYS), F.substring("word", 1, KEY))
    )
    words = checkpoint(_found_words(prot, wanted, bool(stats.long), stats.short))
    found = words.filter("at IS NULL").join(brief, "word").select(F.col("word").alias("_pep"), "protein_id").distinct()
    if stats.long:
        seeds = words.filter("at IS NOT NULL").withColumnRenamed("word", "seed")
        counts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
        # Where the peptide would have to start, counted from 1.
        start = F.col("at") - F.col("off") + 1
        beside = F.endswith("before", F.col("left")) & F.startswith("after", F.col("right"))
        places = checkpoint(
            _peptide_seeds(long, counts).join(seeds, "seed").filter(beside)
            .select("_pep", F.col("protein_id").alias("_of"), start.alias("start")).filter("start >= 1").distinct()
        )
        there = F.substring(F.col("_seq"), F.col("start").cast("int"), F.length("_pep")) == F.col("_pep")
        there = F.coalesce(there, F.lit(False))  # lest Spark filters by the letters before the rows are spread
        # Texts without a place are left out by their ids alone.
        holders = places.select(F.col("_of").alias("_holder")).distinct()
        held = prot.join(holders, F.col("protein_id").eqNullSafe(F.col("_holder")), "left_semi")
        # A broadcast of the places would work a text's letters out again for each of its places.
        hits = held.join(places.hint("merge"), F.col("protein_id").eqNullSafe(F.col("_of")) & there)
        found = found.unionByName(hits.select("_pep", "protein_id").distinct())
    return pep.join(found, "_pep").select("peptide", "protein_id")


def contained_in_proteome(
    rows: DataFrame, proteins: DataFrame, peptide: str = "peptide", name: str = "in_fasta",
    equate_il: bool = True,
) -> DataFrame:
    """Add a flag: the peptide's letters occur in some protein."""
    with_letters = rows.withColumn("_letters", P.letters(peptide))
    hits = (
        kmer_contains_join(with_letters.select(F.col("_letters").alias("peptide")), proteins, equate_il)
        .select(F.col("peptide").alias("_letters"))
        .distinct()
        .withColumn(name, F.lit(True))
    )
    return (
        with_letters.join(hits, "_letters", "left")
        .withColumn(name, F.coalesce(name, F.lit(False)))
        .drop("_letters")
    )


def reannotate_errors(
    rows: DataFrame,
    proteins: DataFrame,
    labels: Sequence[str],
    peptide: str = "peptide",
    error_type: str = "error_type",
) -> DataFrame:
    """Replace listed non-match labels by whether the peptide is in the database.

    The old label is kept in ``prev_error_type``.  ``peptide`` selects the tested peptide;
    for refinements the reference tests the base peptide.
    """
    out = contained_in_proteome(rows, proteins, peptide, "_in")
    hit = F.col(error_type).isin(list(labels)) & (F.col(error_type) != "match")
    return out.withColumn("prev_error_type", F.when(hit, F.col(error_type))).withColumn(
        error_type,
        F.when(hit & F.col("_in"), "No match - In FASTA")
        .when(hit, "No match - Not in FASTA")
        .otherwise(F.col(error_type)),
    ).drop("_in")
