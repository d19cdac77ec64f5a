"""Writers with one schema a table: create or append, keyed upsert, split by variant, text reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import upsert


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_csv(df: DataFrame, path: str, fresh: bool = True) -> None:
    """RFC 4180 with a header; appended files must have the columns of what is there, in their order."""
    if not fresh and exists(df.sparkSession, path):
        there = df.sparkSession.read.option("header", True).csv(path).columns
        if sorted(there) != sorted(df.columns):
            raise ValueError(f"columns {df.columns} do not fit {there}")
        df = df.select(*there)
    df.write.mode("overwrite" if fresh else "append").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Buckets of keys that an upserted table is kept in.
BUCKETS = 64
_POINTER = "current"  # a name that readers do not pass over


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    to = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    return jvm, to, to().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> tuple[int, int, dict[int, str]]:
    """The number of the table's last whole version (0 for none), that of its buckets, and the folder of each of them."""
    jvm, to, files = _hadoop(spark, path)
    if not files.exists(to()):
        return 0, 0, {}
    numbers = [int(n.rpartition("-")[2]) for s in files.listStatus(to()) if (n := s.getPath().getName()).startswith(f"{_POINTER}-")]
    if not numbers:
        return 0, 0, {}
    lines = [r["value"].partition(" ") for r in spark.read.text(f"{path}/{_POINTER}-{max(numbers):09d}").collect()]  # a line for each bucket
    return max(numbers), next(int(v) for k, _, v in lines if k == "buckets"), {int(k): v for k, _, v in lines if k != "buckets"}


def read_upserted(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table of write_upsert(), in its last whole version."""
    _, _, buckets = _versions(spark, path)
    if not buckets:
        if schema is None:
            raise ValueError(f"{path} holds no table")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/{folder}" for _, folder in sorted(buckets.items())])


def write_upsert(new: DataFrame, path: str, keys: list[str], seq: str, buckets: int = BUCKETS) -> None:
    """Replaces rows by key in a table of Parquet folders, one for each bucket of keys; read it with read_upserted().

    The first write says how many buckets a table has.  One job writes at a time.  Only buckets with a new key are read and
    written again, into folders of a new version.  A pointer file that lists each
    bucket's folder is written under another name and renamed last: whatever is lost before, the table is the old version,
    and from then on it is the new one.  Folders that neither the last version nor the one before names are removed then.
    """
    spark = new.sparkSession
    jvm, to, files = _hadoop(spark, path)
    number, known_buckets, there = _versions(spark, path)
    buckets = known_buckets or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = new.withColumn("__bucket", bucket)
    touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())  # BUCKETS at most
    if not touched:
        return
    data = new.drop("__bucket")
    known = [there[b] for b in touched if b in there]
    old = spark.read.schema(data.schema).parquet(*[f"{path}/{folder}" for folder in known]) if known else data.where("false")
    version = f"v{number + 1:09d}-{uuid.uuid4().hex}"
    # A bucket comes from one task: else each of them writes a file into nearly every bucket.
    upsert(old, data, keys, seq).withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{version}")
    now = {**there, **{b: f"{version}/__bucket={b}" for b in touched}}
    text = f"buckets {buckets}\n" + "".join(f"{b} {folder}\n" for b, folder in sorted(now.items()))
    staged = to(f"_staged-{uuid.uuid4().hex}")
    out = files.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(staged, to(f"{_POINTER}-{number + 1:09d}")):
        raise OSError(f"version {number + 1} of {path} was written by another job")
    keep = {folder.partition("/")[0] for folder in (*now.values(), *there.values())}
    for status in files.listStatus(to()):
        name = status.getPath().getName()
        if (name.startswith("v") and name not in keep) or name.startswith("_staged-") or (name.startswith(_POINTER) and int(name.rpartition("-")[2]) < number):
            files.delete(status.getPath(), True)


def split_by(df: DataFrame, column: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def name_for(path: str, filtered: bool) -> str:
    """``x.csv`` to ``x.includes.csv`` for filtered runs."""
    if not filtered:
        return path
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}.includes.{suffix}" if dot else f"{path}.includes"


def with_sentinel(rows: DataFrame, results: DataFrame, keys: list[str], path: str, sentinel: str = "FAIL") -> DataFrame:
    """rows with the result's path, the sentinel where there is none."""
    return rows.join(results.select(*keys, path), keys, "left").withColumn(path, F.coalesce(path, F.lit(sentinel)))


def write_text(df: DataFrame, line: str, path: str) -> None:
    df.select(F.col(line).cast("string").alias("value")).write.mode("overwrite").text(path)


def staged(df: DataFrame, steps: dict[str, Column], path: str) -> DataFrame:
    """df with a column for each step, in order; after each one the table is written below ``path`` and read again.

    A step whose table is there whole is not run again: a run that was lost goes on after the last column that it wrote.
    A step's table is removed when the next one's is whole."""
    spark = df.sparkSession
    _, to, files = _hadoop(spark, path)
    done = [i for i in range(len(steps)) if files.exists(to(f"step-{i:03d}/_SUCCESS"))]
    start = max(done, default=-1) + 1
    table = spark.read.parquet(f"{path}/step-{start - 1:03d}") if start else df
    for i, (name, value) in list(enumerate(steps.items()))[start:]:
        table.withColumn(name, value).write.mode("overwrite").parquet(f"{path}/step-{i:03d}")
        table = spark.read.parquet(f"{path}/step-{i:03d}")
        if i:
            files.delete(to(f"step-{i - 1:03d}"), True)
    return table
