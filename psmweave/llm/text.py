"""Text expressions shared by the operators of this package (Spark functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: \x20 and \x09-\x0D, nothing else.
BLANKS = " \t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, and only where this expression is reached."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """XXH64 of every run of ``width`` words, in order; empty where there are fewer words."""

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)])
        )

    return let(
        tokens, lambda w: F.when(F.size(w) >= width, hashes(w)).otherwise(F.array().cast("array<bigint>"))
    )


def rows_of(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole input rows as ``__row`` next to computed columns, so that no name can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), *[v.alias(k) for k, v in columns.items()])
