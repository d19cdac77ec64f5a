"""Running values, islands and merged spans of keys that may hold any number of rows.

A window over a key's rows is one task a key.  Here a key's rows are dealt to buckets in order: runs are made in each bucket,
a bucket is summed up in one row, and the rows of a key's buckets, few, carry on from one to the next.  Integer positions give
buckets of WIDTH positions without a look at the data; other orders get ranges from a sample, checkpointed, so that a task
that runs again finds the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

WIDTH = 1 << 16
#: Rows of a table for each task that sorts or aggregates them.
ROWS = 1 << 18


def dealt(df: DataFrame, keys: list[str], rows: int, most: int = ROWS) -> DataFrame:
    """df dealt by keys to as many tasks as ``rows``, a count of it or a bound on that, asks for: a task's memory stays the same
    as the table grows.  Splits of files and merged shuffle partitions grow with the table, up to what 64 MB or more hold."""
    return df.repartition(max(1, -(-rows // most)), *keys)


def by_position(df: DataFrame, keys: list[str], position: Column, width: int = WIDTH) -> DataFrame:
    """df with __key and __bucket: so many positions a bucket."""
    return df.withColumns({"__key": _key(keys), "__bucket": F.floor(position / width).cast("long")})


def by_range(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with __key and __bucket: ranges of (keys, order), about as large as one another."""
    ranged = df.repartitionByRange(*keys, *order) if keys else df.repartitionByRange(*order)
    return checkpointed(ranged.withColumns({"__key": _key(keys), "__bucket": F.spark_partition_id().cast("long")}))


def _key(keys: list[str]) -> Column:
    """The keys as one value: as such, nulls are equal."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("k"))


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]], upto: int = 0) -> DataFrame:
    """df (of by_position() or by_range()) with a column for each of ``values``: name -> ("sum", "max" or "last", value), over
    the rows of the key up to a row (upto = 0) or before it (-1); null where there is none."""
    kinds = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    whole = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    here = Window.partitionBy("__key", "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = df.groupBy("__key", "__bucket").agg(*[whole.get(kind, kinds[kind])(value).alias(f"__{name}") for name, (kind, value) in values.items()])
    carried = buckets.select("__key", "__bucket", *[kinds[kind](F.col(f"__{name}")).over(before).alias(f"__{name}") for name, (kind, _) in values.items()])
    out = df.withColumns({name: kinds[kind](value).over(here) for name, (kind, value) in values.items()}).join(carried, ["__key", "__bucket"])
    both = {
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(a, b),
    }
    return out.withColumns({name: both[kind](F.col(name), F.col(f"__{name}")) for name, (kind, _) in values.items()}).drop(*[f"__{name}" for name in values])


def islands(df: DataFrame, keys: list[str], value: str, width: int = WIDTH) -> DataFrame:
    """keys, start, end: runs of consecutive integers; nulls are none.

    Rows are counted and dealt by bucket; repeated values go there as they come in, so a task holds ``width`` values of a
    bucket at most, however often they are repeated.  Runs within a bucket are whole; those that touch its edges, two a
    bucket, are joined along the key.
    """
    at = F.col(value)
    known = df.where(at.isNotNull())
    values = dealt(by_position(known, keys, at, width).select("__key", "__bucket", at.cast("long").alias("__v")), ["__key", "__bucket"], known.count()).distinct()
    here = Window.partitionBy("__key", "__bucket").orderBy("__v")
    rows = values.withColumn("__run", F.col("__v") - F.row_number().over(here))
    found = rows.groupBy("__key", "__bucket", "__run").agg(F.min("__v").alias("start"), F.max("__v").alias("end"))
    edge = (F.pmod("start", F.lit(width)) == 0) | (F.pmod("end", F.lit(width)) == width - 1)
    along = Window.partitionBy("__key").orderBy("start")
    cut = found.where(edge).withColumn("__new", F.coalesce((F.lag("end").over(along) != F.col("start") - 1).cast("int"), F.lit(1)))
    cut = cut.withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = cut.groupBy("__key", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("__key", "start", "end")
    kind = df.schema[value].dataType
    every = found.where(~edge).select("__key", "start", "end").unionByName(joined)
    return every.select(*[F.col("__key")[k].alias(k) for k in keys], *[F.col(c).cast(kind).alias(c) for c in ("start", "end")])


def merged(df: DataFrame, keys: list[str], start: str, end: str, reach: int = 1, width: int = WIDTH, unknown: bool = False) -> DataFrame:
    """keys, start, end: spans of integers merged, by start and end, when one starts at most ``reach`` after what lies before
    it ends; spans without a start or an end are none.

    With ``unknown`` they are rows like others: a null comes last, reaches nothing, and begins a run only where nothing before
    it has an end.  Of a start the farthest end counts, found before the shuffle; a span that ends more than ``reach``
    before its own start (or nowhere) does not reach its copies either, so those are counted: each is a run of its own, if
    one is.  A span begins a run where no earlier one reaches it; what earlier buckets reach, and how many runs they begin,
    comes from a row for each bucket.
    """
    s, e = F.col(start), F.col(end)
    spans = df if unknown else df.where(s.isNotNull() & e.isNotNull())
    apart = F.coalesce(s.isNull() | (e < s - reach), F.lit(True))
    far = spans.groupBy(*keys, s.alias("start"), apart.alias("__apart"), F.when(apart, e).alias("__own")).agg(F.max(e).alias("end"), F.count(F.lit(1)).alias("__n"))
    rows = by_position(far, keys, F.col("start"), width).withColumn("__bucket", F.coalesce("__bucket", F.lit((1 << 63) - 1)))
    order = [F.asc_nulls_last("start"), F.asc_nulls_last("end")]
    held = running(rows, order, {"__held": ("max", F.col("end"))}, upto=-1)
    head = F.col("__held").isNull() | F.coalesce(F.col("start") > F.col("__held") + reach, F.lit(False))
    runs = running(held.withColumn("__head", head.cast("long")), order, {"__run": ("sum", F.col("__head"))})
    one = runs.groupBy(*keys, "__key", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")
    again = (F.col("__head") == 1) & F.col("__apart") & (F.col("end").isNull() | F.col("start").isNotNull()) & (F.col("__n") > 1)
    copies = runs.where(again).select(*keys, "start", "end", F.explode(F.sequence(F.lit(2).cast("long"), "__n")).alias("__copy"))
    return one.unionByName(copies.drop("__copy"))
