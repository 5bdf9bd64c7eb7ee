"""Exact deduplication by progressive refinement, in Spark functions only.

1. One pass measures every text: its length in bytes and a hash of its first characters.
2. Lengths that occur once settle their texts. Of the others, pairs of length and prefix hash that occur
   once do. Only rows whose length is repeated enter the second count.
3. A second pass reads the whole content, as SHA-256, of texts that are left, and groups them by it.

Between the passes only bitmaps of repeated keys move (``marks``, one MB each for any number of keys);
what they let through wrongly stands alone in the next count. All counts are summed before the shuffle,
so a group of copies that holds a third of all rows is a number per task.

Defined results: null counts as the empty text, and all empty texts are one group; texts are equal if all
their bytes are. The row with the largest ``doc_id`` stays, null ids count as smaller than any other. Rows
that repeat both the text and the largest ``doc_id`` are one document and all stay, as do the rows of a
group that has null ids only: nothing tells them apart. An empty table gives an empty table; other
columns, whatever their names, pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm import marks
from psmweave.llm.store import written
from psmweave.llm.text import rows_of

#: Characters of the prefix that is hashed for every text.
PREFIX = 128


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _measures(docs: DataFrame) -> dict[str, Column]:
    """Length in bytes and prefix hash of a text."""
    text = _text(docs)
    return {"__n": F.octet_length(text), "__p": F.xxhash64(F.left(text, F.lit(PREFIX)))}


def _repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)


def _survivors(docs: DataFrame) -> DataFrame:
    """Bitmap of the pairs of length and prefix hash that more than one text has."""
    keys = written(docs.select(*[c.alias(k) for k, c in _measures(docs).items()]), "exact-keys")
    lengths = written(marks.bitmap(_repeated(keys, "__n"), "__n"), "exact-lengths")
    open_ = marks.with_mark(keys, lengths, "__open", "__n").filter("__open")
    return written(marks.bitmap(_repeated(open_, "__n", "__p"), "__n", "__p"), "exact-prefixes")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """``hash, keep_id, group_size`` of every text that more than one row has; ``hash`` is its SHA-256 (32 bytes)."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), _text(docs).alias("text"),
        *[c.alias(k) for k, c in _measures(docs).items()],
    )
    left = marks.with_mark(rows, _survivors(docs), "__open", "__n", "__p").filter("__open")
    return (
        left.select("doc_id", _hash(F.col("text")).alias("hash"))
        .groupBy("hash")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _stays(doc_id: Column, keep_id: Column) -> Column:
    return doc_id.eqNullSafe(keep_id)


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """Every row: ``doc_id, keep_id, group_size, kept, text_sha256``; a text that stands alone is a group of one.

    Only ids and hashes are shuffled; the hash of a repeated text meets one row, so a join with a hot
    group can be split.
    """
    groups = written(duplicate_groups(docs), "exact-groups")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _hash(_text(docs)).alias("hash"))
    alone = F.col("group_size").isNull()
    return (
        rows.join(groups, "hash", "left")
        .withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
        .select(
            "doc_id", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            _stays(F.col("doc_id"), F.col("keep_id")).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"),
        )
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged; texts that stand alone aren't shuffled."""
    groups = written(duplicate_groups(docs), "exact-groups")
    some = written(marks.bitmap(groups, "hash"), "exact-copies")
    rows = marks.with_mark(rows_of(docs, __hash=_hash(_text(docs))), some, "__copied", "__hash")
    copies = rows.filter("__copied").join(groups, F.col("__hash") == F.col("hash"), "left")
    row_id = F.col("__row.doc_id").cast("long")
    stay = copies.filter(F.col("hash").isNull() | _stays(row_id, F.col("keep_id")))
    return rows.filter("NOT __copied").select("__row").unionAll(stay.select("__row")).select("__row.*")
