"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder that ``spark.checkpoint.dir`` names.

    Only where that is unset (tests, one machine) a local one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        base = os.path.dirname(known) if known else "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``shared_dir`` named, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def exact_id(name: str) -> Column:
    """An id column as text: beside nulls pandas would turn whole numbers into floating ones."""
    return F.col(name).cast("string").alias(name)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))
