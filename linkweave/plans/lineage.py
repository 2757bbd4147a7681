"""Cutting the lineage of iterative plans by reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under the folder that ``spark.checkpoint.dir`` names; a local one is made only where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names; a local one is made only where it is unset.

    A checkpointed frame keeps the size estimate of the plan that made it. A join's estimate is the product of its sides', so in a loop the
    estimates' digits grow exponentially, and after a dozen rounds planning takes longer than the work. The rows are therefore
    handed out as a new frame, whose size is unknown; adaptive execution sees their real size.
    """
    spark = df.sparkSession
    shared_folder(spark, "")  # sets the folder where it is unset
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(held.toJavaRDD(), held.schema()), spark)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a shared folder and read from it, and the folder: smaller than a checkpoint, and gone when ``dropped``."""
    folder = shared_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def dropped(spark: SparkSession, *folders: str) -> None:
    """Removes folders of ``stored``, and lets the cleaner take shuffles and checkpoints that nothing refers to, which it does only when the
    driver collects its garbage."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()
