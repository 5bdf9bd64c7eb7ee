"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.llm.store import written


def _linked(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs): the smallest node of its component.

    Each round hangs larger neighbours, then smaller ones, on the smallest neighbour; the edges never
    become more, and rounds grow with the logarithm of the largest component. Minima are aggregated
    before the joins, so a node with very many neighbours is never gathered. Every round is written to
    the shared folder.
    """
    now = written(
        _linked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _linked(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = written(_linked(small.select("e.u", "e.v")), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
