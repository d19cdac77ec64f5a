"""The folder that driver and executors share: checkpoints and tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir.  A local session that names none gets a folder of its own; on a
    cluster that is an error, as a folder of one machine would be lost or not seen."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Removes the files of a checkpointed() frame; only for one that no frame still to be read comes from."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
