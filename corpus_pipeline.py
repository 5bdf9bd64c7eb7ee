"""A corpus preparation pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's input. All stages but the last return the columns of ``documents``:

1. quality rules: texts that a rule rejects go;
2. line dedup: lines that an earlier document has go, and documents of which nothing is left;
3. SimHash near dedup: one document of each group stays, the one with the smallest ``doc_id``;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: ``doc_id``, the ids of the text, their number and whether they decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from psmweave.llm import decontaminate, linededup, quality, sentences, simhash
from psmweave.llm.store import bound_batches, written
from psmweave.runtime import ship_package


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return linededup.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, decontaminate.find_leaks(docs, benchmark))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return sentences.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express alignment, fingerprints or byte-pair merges; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
