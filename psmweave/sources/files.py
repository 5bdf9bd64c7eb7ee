"""Common parts of the text readers: run names and positions inside files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_META = "_metadata"


def run_of(path: Column) -> Column:
    """Run name: the ``run=`` folder when there is one, else the file name up to its first dot."""
    folder = F.regexp_extract(path, r"run=([^/]+)/", 1)
    name = F.regexp_extract(path, r"([^/]+?)\.[^/]*$", 1)
    return F.url_decode(F.when(folder != "", folder).otherwise(F.substring_index(name, ".", 1)))


def locate(df: DataFrame) -> DataFrame:
    """Add ``run`` and ``_place``, which sorts rows as they stand in the files.

    The place is (file, block offset, row in the block); it depends on the file only.
    """
    # A run= folder also shows up as a discovered column; the path rule covers both cases.
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "run"],
        run_of(F.col(f"{_META}.file_path")).alias("run"),
        F.struct(
            F.col(f"{_META}.file_path").alias("file"),
            F.col(f"{_META}.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_place"),
    )


def with_ordinal(located: DataFrame, name: str = "ordinal") -> DataFrame:
    """0-based position inside the run, from ``_place``; store it, later joins use it.

    Records are counted per file split; a split's first number is the sum over the splits before it,
    and its records, which one task has read anyway, are numbered on their own. Every split has a first number, so
    a left join loses nothing, and Spark leaves it out with the numbering where nothing reads the position.
    """
    split = ["run", "_file", "_block"]
    rows = located.withColumns({"_file": F.col("_place.file"), "_block": F.col("_place.block")})
    before = Window.partitionBy("run").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(
        *split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    place = F.row_number().over(Window.partitionBy(*split).orderBy("_place.row"))
    numbered = rows.withColumn(name, place).join(first, split, "left")
    return numbered.withColumn(name, F.col(name) - 1 + F.col("_first")).select(*located.columns, name)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return locate(spark.read.text(path))


def blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Records of a text file that end (or begin) with ``separator``."""
    return locate(spark.read.option("lineSep", separator).text(path))


def number(c: Column, kind: str = "double") -> Column:
    return F.trim(c).try_cast(kind)
