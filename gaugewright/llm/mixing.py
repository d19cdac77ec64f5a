"""Mixing sources to target weights by Poisson replication.

A source with weight w of all weights W and n of the N rows gets the mean repetition rate w / W * N / n.  Each row draws
a uniform number from a hash of seed and doc_id, its count is that number put through the inverse of the Poisson
distribution with its source's rate, whatever its size, and it is exploded into so many copies.  The copies are shuffled by a hash of seed,
doc_id and copy: ``shuffle_key`` is the global order, and rows come dealt by ranges of it.  DataFrame functions only.

Cases: null is a source of its own ("" is another); weights may leave sources out (rate 0) and may name sources that
have no rows; None stands for equal weights; null doc_ids and repeated rows draw alike; an empty table gives no rows;
the input's other columns are kept, its columns "copies", "copy", "rate" and "shuffle_key" are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

#: Up to so many numbers in all sources' tables of sums they are broadcast (16 MB); beyond it they are joined by shuffle.
BROADCAST_SUMS = 2_000_000
#: Hexadecimal digits of the uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Sums reach so many standard deviations (and LEAST more) from the mean; what lies beyond is below the steps of uniform().
REACH, LEAST = 12, 40


def uniform(*keys: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def distribution(known: DataFrame) -> DataFrame:
    """known (source, rate) with __low and __sums added: P(X <= k) for k = __low, __low + 1, ... of each source's rate.

    log P(X = k) is log P(X = __low) and the running sum of log(rate / j), so that no term vanishes for large rates; __low
    is 0 up to a rate of 1000, and P(X = __low) follows from Stirling's series beyond.  Sums are made in rows, a source's
    in one window of some 24 square roots of its rate.
    """
    rate = F.col("rate")
    wide = REACH * F.sqrt(rate) + LEAST
    low = F.when(rate <= 1000, F.lit(0.0)).otherwise(F.floor(rate - wide).cast("double"))
    x = F.col("__low") + 1  # log(low!) = log gamma(x)
    gamma = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    first = F.when(F.col("__low") == 0, -rate).otherwise(F.col("__low") * F.log(rate) - rate - gamma)
    terms = known.withColumn("__low", low).withColumn("__first", first)
    terms = terms.withColumn("__k", F.explode(F.sequence(F.col("__low").cast("long"), F.ceil(rate + wide).cast("long"))))
    upto = Window.partitionBy("source").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    log = F.when(F.col("__k") == F.col("__low"), F.col("__first")).otherwise(F.log(rate / F.col("__k")))
    terms = terms.withColumn("__p", F.exp(F.sum(log).over(upto)))
    terms = terms.withColumn("__sum", F.sum("__p").over(upto))
    rows = terms.groupBy("source", "rate", F.col("__low").cast("int").alias("__low")).agg(F.array_sort(F.collect_list("__sum")).alias("__sums"))
    # A rate of 0 has log(0 / k) in it: its sums are all 1.
    return rows.withColumn("__sums", F.when(F.col("rate") == 0, F.array(F.lit(1.0))).otherwise(F.col("__sums")))


def rates(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """source, n_source, rate: a row for each source that has rows."""
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    n_all, n_sources = per.agg(F.coalesce(F.sum("n_source"), F.lit(0)), F.count(F.lit(1))).first()
    if weights is None:
        rate = F.lit(float(n_all)) / (F.lit(max(n_sources, 1)) * F.col("n_source"))
    else:
        whole = float(sum(weights.values()))
        named = docs.sparkSession.createDataFrame([(k, float(v) / whole) for k, v in weights.items()], "__source string, __weight double")
        per = per.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__source")), "left")  # the caller's own list
        rate = F.coalesce(F.col("__weight"), F.lit(0.0)) * F.lit(float(n_all)) / F.col("n_source")
    return per.select("source", "n_source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, seed: str = "mix") -> DataFrame:
    """The rows' copies in their new order, with copies, copy (from 0), rate and shuffle_key added."""
    docs = docs.drop("copies", "copy", "rate", "shuffle_key")
    known = checkpointed(distribution(rates(docs, weights)))
    small = known.agg(F.coalesce(F.sum(F.size("__sums") + 1), F.lit(0))).first()[0] <= BROADCAST_SUMS
    known = known.withColumnRenamed("source", "__of")
    joined = docs.join(F.broadcast(known) if small else known, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    u = uniform(F.lit(seed), F.col("doc_id"))
    # A row leaves a lambda's captured values to be computed for each element: the number is bound once.
    draw = F.transform(F.array(u), lambda v: F.size(F.filter("__sums", lambda p: p <= v)))[0]
    counted = joined.withColumn("copies", F.col("__low") + draw).drop("__sums", "__low")
    spread = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    spread = spread.withColumn("shuffle_key", key)
    # The key is a hash, so its ranges are known beforehand: no sampling pass, and equal shares whatever the data.
    n = shuffle_partitions(docs.sparkSession)
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    return spread.withColumn("__part", place).repartitionById(n, "__part").drop("__part").sortWithinPartitions("shuffle_key")


#: DuckDB SQL for mix() with equal weights over documents, without the texts.  Its sums begin at 0 for any rate.
SQL = """
with recursive rated as (
  select source, (sum(n) over ())::double / ((count(*) over ()) * n) rate
  from (select source, count(*) n from documents group by source)
),
sums(source, k, log, total, rate) as (
  select source, 0, -rate, exp(-rate), rate from rated
  union all
  select source, k + 1, log + ln(rate / (k + 1)), total + exp(log + ln(rate / (k + 1))), rate from sums where k < ceil(rate + 12 * sqrt(rate) + 40)
),
drawn as (
  select doc_id, source, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double u, md5(text) text_md5 from documents
),
counted as (
  select d.doc_id, d.source, d.text_md5, s.rate, count(*) filter (s.total <= d.u) copies
  from drawn d join sums s on d.source is not distinct from s.source group by all
)
select doc_id, source, rate, copies::int copies, copy::int copy, md5('mix:order:' || doc_id || ':' || copy) shuffle_key, text_md5
from (select *, unnest(range(copies)) copy from counted)
"""
