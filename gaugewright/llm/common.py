"""What the operators of this subpackage share: checkpoints, row numbers, Arrow helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the row's place in its partition in its low 33 bits.
_LOW_BITS = (1 << 33) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what driver and executors share.

    Where the session names none, a local one (as in tests) gets a folder of its own; on a cluster that is an error, as a
    folder of one machine would be lost or not seen.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder that nothing reads any more."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def released(df: DataFrame) -> None:
    """Removes the files of a checkpointed() frame; only for one that no frame still to be read comes from."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of the columns ``order`` over all rows.

    Range partitions are sorted and checkpointed; a row's number is its place in its partition plus the rows of the
    partitions before.  The only gathered data is one count for each partition.  The number depends on the order alone,
    not on the layout; rows equal in all of ``order`` may swap numbers.  df should be cheap to read twice (the range
    bounds are sampled): checkpoint what is not.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    counts = kept.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = kept.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")  # a row a partition
    return joined.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_LOW_BITS))).drop("__at", "__part", "__start")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text; null for null."""
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    byte = f"list_reduce(range(8), lambda x, i: {step}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint), lambda c, b: {byte}, 4294967295::bigint), 4294967295)"


def slices(batches, limit: int = 8 << 20):
    """Record batches cut so that each holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * limit / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
