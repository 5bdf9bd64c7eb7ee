"""Sets of keys as bitmaps of a fixed size, for filters whose broadcast never grows with the data.

A key's hash picks one of 2^23 bits, so a set takes 256 rows of 4 KB (one MB) whatever it holds. A bit may
be set by another key: the filter lets some rows through that have no such key, and loses none.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23
_ROW = 32768  # bits of one row: what Spark's bitmap functions put into one


def slot(*key: Column | str) -> Column:
    """The bit (from 1) of a key; keys of one string column get that of :func:`slot_of`."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - BITS) + 1


def slot_of(key: bytes) -> int:
    """The bit (from 0) of a string's UTF-8, in Python."""
    return xxhash.xxh64_intdigest(key, 42) >> 64 - BITS


def bitmap(keys: DataFrame, *key: str) -> DataFrame:
    """``bucket, bits``: at most 256 rows for any number of keys."""
    at = keys.select(slot(*key).alias("s")).select(
        F.bitmap_bucket_number("s").alias("bucket"), F.bitmap_bit_position("s").alias("place")
    )
    return at.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def with_mark(df: DataFrame, marks: DataFrame, name: str, *key: Column | str) -> DataFrame:
    """``df`` with a boolean that is true for every row whose key is in the set."""
    sent = F.broadcast(marks.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    s = slot(*key)
    place = F.bitmap_bit_position(s)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(sent, F.bitmap_bucket_number(s) == F.col("__bucket"), "left")
    return joined.withColumn(
        name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    ).drop("__bucket", "__bits")


def collected(marks: DataFrame) -> bytes:
    """The whole bitmap, one MB, bit ``slot_of(key)`` counted from the lowest bit of the first byte."""
    whole = np.zeros(1 << BITS - 3, np.uint8)
    for r in marks.collect():  # at most 256 rows of 4 KB
        at = (r["bucket"] - 1) * _ROW // 8
        whole[at : at + _ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole.tobytes()
