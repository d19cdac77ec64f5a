"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by doc_id (then CRC and size), the numbers 0..n-1 are permuted, and permuted number p goes to shard
p mod shards at slot p div shards.  So the shuffle is reproducible from (n, seed) alone, place and number can be
computed from one another, and shards differ by one row at most (law "rows").  DataFrame functions only.

Cases: null text has no bytes; null doc_ids come first; repeated rows are dealt one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, number_rows

ROUNDS = 6


def feistel(value: Column, bits: int, seed: int) -> Column:
    """A permutation of 0..2**bits-1: the halves take turns to be changed by a hash of the other."""
    low_bits = (bits + 1) // 2
    high_bits = bits - low_bits
    state = F.struct(F.shiftright(value, low_bits).alias("h"), value.bitwiseAND(F.lit((1 << low_bits) - 1)).alias("l"))

    def step(s: Column, i: Column) -> Column:
        mixed_low = s.l.bitwiseXOR(F.xxhash64(s.h, F.lit(seed), i).bitwiseAND(F.lit((1 << low_bits) - 1)))
        mixed_high = s.h.bitwiseXOR(F.xxhash64(s.l, F.lit(seed), i).bitwiseAND(F.lit((1 << high_bits) - 1)))
        even = i % 2 == 0
        return F.struct(F.when(even, s.h).otherwise(mixed_high).alias("h"), F.when(even, mixed_low).otherwise(s.l).alias("l"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, state, step, lambda s: F.shiftleft(s.h, low_bits).bitwiseOR(s.l))


def permute(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` of n: the permutation of the next power of two is walked until it falls below n.

    A walk leaves the range with a chance under 1/2 each step; the steps allowed make a longer walk less likely than
    1e-30 a row, and such a walk would stop the job with an error rather than misplace a row.
    """
    bits = max(2, (n - 1).bit_length())
    beyond = 1 - n / (1 << bits)
    steps = 1 + (math.ceil(-30 / math.log10(beyond)) if beyond else 0)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps - 1))), feistel(number, bits, seed), lambda p, _: F.when(p < n, p).otherwise(feistel(p, bits, seed)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240601) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    small = checkpointed(small)  # three numbers a row; texts are read once
    n = small.count()
    numbered = number_rows(small, ["doc_id", "text_crc32", "size"], "row_number")
    place = F.col("__place")
    return numbered.withColumn("__place", permute(F.col("row_number"), max(n, 1), seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (place % shards).cast("int").alias("shard"),
        F.expr(f"__place div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
