"""Incremental rescoring over many runs and engines (M9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave.operators.confidence import FoldModels, rescoring_apply, rescoring_train

PARTS = ["run", "engine"]


def existing_outputs(spark: SparkSession, path: str) -> DataFrame:
    """(run, engine) pairs already written below ``path``; empty when there is nothing."""
    try:
        return spark.read.parquet(path).select(*PARTS).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run string, engine string")


def pending(inputs: DataFrame, done: DataFrame, redo: bool = False) -> DataFrame:
    """Input rows whose output does not exist yet; everything with ``redo``."""
    return inputs if redo else inputs.join(done, PARTS, "left_anti")


def incremental_rescore(
    inputs: DataFrame, path: str, rescore: Callable[[DataFrame], DataFrame], redo: bool = False
) -> DataFrame:
    """Rescore what is missing and write it; partitions replace the fixed-size batches.

    Only partitions with new rows are overwritten.
    """
    spark = inputs.sparkSession
    todo = pending(inputs, existing_outputs(spark, path), redo)
    out = rescore(todo)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTS)
        .parquet(path)
    )
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))


def stored_models(spark: SparkSession, path: str, features: Sequence[str]) -> FoldModels | None:
    """Models saved below ``path``, or None where none have been saved."""
    try:
        known = [r.feature for r in spark.read.parquet(path).select("feature").distinct().collect()]  # one row per feature
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if sorted(f for f in known if f is not None) != sorted(features):
        raise ValueError(f"the models below {path} read other features; retrain them")
    return FoldModels.load(spark, path, features)


def rescore_with_models(
    inputs: DataFrame,
    path: str,
    model_path: str,
    features: Sequence[str],
    retrain: bool = False,
    redo: bool = False,
    **training,
) -> DataFrame:
    """Rescore the (run, engine) parts that have no output yet with saved fold models.

    Models are trained on ``inputs`` and saved where there are none or with ``retrain``; retrained
    models make every output out of date, so all parts are rescored then.
    """
    spark = inputs.sparkSession
    models = None if retrain else stored_models(spark, model_path, features)
    if models is None:
        models = rescoring_train(inputs, features, **training)
        models.save(spark, model_path)
    return incremental_rescore(inputs, path, lambda df: rescoring_apply(df, models), redo or retrain)
