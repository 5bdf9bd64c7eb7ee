"""Session-level helpers: checkpoints, stored tables and scratch locations."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

def checkpoint_root(spark: SparkSession) -> str:
    """Directory shared by the cluster for checkpoints and scratch tables.

    The cluster's ``spark.checkpoint.dir`` wins; a machine-local folder is only
    chosen for local masters where nothing is configured (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="psmweave-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again.

    Cuts the lineage like :func:`checkpoint`; columns of few values take a fraction of the bytes of stored rows,
    and Spark knows the size when it plans a join.
    """
    kinds = df.schema.simpleString()
    if "void" in kinds or "interval" in kinds:  # Parquet has no such columns
        return checkpoint(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shared_shuffle(df: DataFrame) -> Iterator[DataFrame]:
    """Inside, ``df`` is kept on the executors' disks as it is partitioned, and joins on more columns than those use it so.

    For queries that read one shuffled table several times and end with :func:`stored` before they leave. What is
    lost with an executor is computed again.
    """
    spark, most = df.sparkSession, "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.requireAllClusterKeysForCoPartition", most)}
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        # Spark shuffles a side again that has fewer parts than a shuffle has by default.
        parts = min(kept.rdd.getNumPartitions(), int(spark.conf.get(most)))
        for k, v in zip(before, ("false", str(parts))):
            spark.conf.set(k, v)
        yield kept
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        kept.unpersist()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_psmweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="psmweave-")) / "psmweave"
    archive = shutil.make_archive(str(target), "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sc._psmweave_shipped = True
