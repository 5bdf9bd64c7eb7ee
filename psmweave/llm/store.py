"""Intermediate tables in the folder all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from psmweave.runtime import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage ends here and a lost executor costs no rework."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one batch of rows on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers hold by bytes; a session with a bound below Spark's own keeps it."""
    try:
        now = int(spark.conf.get(_BATCHES).rstrip("b"))
    except ValueError:
        return  # given with another unit: chosen by the user
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")
