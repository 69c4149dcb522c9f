"""Tables written between steps of one job, in a folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that this process has written and not deleted.
_written: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = f"{shared_root(spark)}/cumulo-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    _written.add(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_one_part(df: DataFrame) -> bool:
    """Whether one task wrote all rows of a table made by :func:`materialize`."""
    return len(df.inputFiles()) <= 1


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` once nothing will read it again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files or "/cumulo-" not in files[0]:
        return
    _delete(spark, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete every table that this process has written between steps, and say how many.

    For long sessions: call it once results are written elsewhere, as results that are not may still read those tables.
    """
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def release(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to any more: shuffle files of finished jobs go when its JVM collects their handles.

    Called between steps that each shuffle about as much as their input, so that disk holds one step's files.
    """
    gc.collect()
    spark._jvm.System.gc()
