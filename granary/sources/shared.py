"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a local folder, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; the session's end deletes it."""
    path = f"{shared_folder(spark)}/granary/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


def version(df: DataFrame) -> str:
    """A digest of the paths, lengths and times of the files that a table reads, from listings of their folders; it changes if the table is written again."""
    spark, found = df.sparkSession, hashlib.sha256()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    files = set(df.inputFiles())
    for parent in sorted({f.rpartition("/")[0] for f in files}):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(parent))
        for status in path.getFileSystem(conf).listStatus(path):
            found.update(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}\n".encode())
    return found.hexdigest()


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its plan ends here; the session's end deletes it."""
    spark = df.sparkSession
    path = folder_for(spark, name)
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of ``spread`` holds on average.
TASK_ROWS = 1 << 19


def tasks_for(rows: int, spark: SparkSession) -> int:
    """A number of tasks that grows with the rows, so that a task's memory doesn't."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
