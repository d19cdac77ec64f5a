"""Document fingerprints from closed syncmers.

A k-mer of K code points is an anchor when the smallest hash among its W inner substrings of S code points is that of
its first or its last one.  The choice looks at the k-mer alone, so an anchor stays chosen in any text that holds it.  A
fingerprint is the hashes of all anchors in the order of their places, 32 bits each, in hexadecimal: its length follows
the text's, and nothing is left out.

Two fingerprints are compared by place: the n-th anchor of a hash in one is matched with the n-th of that hash in the
other, and of these matches the longest chain counts that rises in both texts (text that was moved along by an insertion
still matches, text that comes in another order does not).  With a chain of m, the likeness of a and b anchors is
m / (a + b - m): 1 for equal texts, 0 without common anchors.  It is exact for texts of any size.

Hashes (all numbers modulo 2**64; c1 and c2 are _C1 and _C2): two(i) = c1 x[i] + x[i+1] of code points; inner(i) = mix(c2
two(i) + c1 two(i+2)) for S = 4; an anchor at i has the upper half of mix(c1 inner(i) + c2 inner(i+S) + c1 c2 inner(i+2S) +
inner(i+W-1)), which are all of its K = 15 code points.

Cases: null text counts as empty; the empty text's fingerprint is "" (likeness 1 to itself, 0 to others); a text without
an anchor (shorter than K, or none chosen) has the hash of the whole text; equal texts have equal fingerprints.  In
neighbours() documents are in the order of doc_id (nulls first), rows of one doc_id in the order of a hash of their texts,
then of their texts; an only row is its own neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import ship, shuffle_partitions, slices, text_or_empty

#: Inner substrings have S code points, k-mers have W of them in a row: K = S + W - 1.  Two in W k-mers are chosen.
S, W = 4, 12
K = S + W - 1
NULL_ID = -(1 << 63)

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "n_anchors long, edited_anchors long, in_order long"
)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C3 = np.uint64(0x9E3779B97F4A7C15 * 0xC2B2AE3D27D4EB4F % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points, ascending) and 32-bit hashes of a text's anchors."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(text) >= K:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        two = points[:-1] * _C1 + points[1:]
        inner = _mix(two[:-2] * _C2 + two[2:] * _C1)  # of S = 4
        least = inner
        for step in (1, 2, 4, 4):  # of 2, 4, 8 and W = 12
            least = np.minimum(least[:-step], least[step:])
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[W - 1 :] == least))
        if len(at):
            whole = inner[at] * _C1 + inner[at + S] * _C2 + inner[at + 2 * S] * _C3 + inner[at + W - 1]
            return at, (_mix(whole) >> np.uint64(32)).astype(np.uint32)
    return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "<u4")


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys (hash, its n-th occurrence) of anchors in order, and the rank of each key's anchor."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    nth = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return (ranked.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64), order


def chain(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The longest rising chain of matches of two texts' numbered() anchors."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    i, j = a[1][i], b[1][j]
    j = j[np.argsort(i, kind="stable")]
    if not len(j):
        return 0
    stays = np.flatnonzero(j != np.arange(len(j)))  # matches of the same rank at the start belong to a longest chain
    same = stays[0] if len(stays) else len(j)
    rest = j[same:]
    if not len(rest) or (rest[1:] > rest[:-1]).all():
        return len(j)
    ends: list[int] = []  # the least last rank of a chain of each length
    for x in rest.tolist():
        if not ends or x > ends[-1]:
            ends.append(x)
        else:
            ends[bisect_left(ends, x)] = x
    return int(same) + len(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, int]:
    """Likeness and chain of two texts' numbered() anchors."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0])), 0
    m = chain(a, b)
    return m / (len(a[0]) + len(b[0]) - m), m


def parsed(fingerprint: str) -> np.ndarray:
    """The anchor hashes that a fingerprint holds."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def printed(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as many code points, or all, of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """__bucket, __halo, doc_id, tid, text: documents dealt by ranges of (doc_id, hash of the text) and sorted, each range
    followed by the first document (__halo true) of the next range that has any, the last range by the very first one.

    Texts are shuffled once.  Range bounds, one number for each partition, are all that the driver sees.  Bounds come from
    quantiles of doc_id; a doc_id (or null) that is several bounds is dealt over their ranges by its texts' hashes, so that
    one doc_id with very many texts is no single task.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    parts = shuffle_partitions(spark)
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    bounds = np.array(found or [0], dtype=np.int64)

    @F.pandas_udf(IntegerType())
    def bucket(ids, tids):
        import pandas as pd

        ids, share = ids.to_numpy().astype(np.int64), tids.to_numpy().astype(np.float64) / 2.0**64 + 0.5
        low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
        spread = np.minimum((share * np.maximum(high - low, 1)).astype(np.int64), np.maximum(high - low - 1, 0))
        return pd.Series((low + spread).astype(np.int32))

    dealt = rows.withColumn("__bucket", bucket("doc_id", "tid"))
    heads = dealt.select("doc_id", "tid", "__bucket").groupBy("__bucket").agg(F.min(F.struct("doc_id", "tid")).alias("h")).collect()
    heads = sorted((r["__bucket"], r["h"]["doc_id"], r["h"]["tid"]) for r in heads)  # a row for each range
    before = [(doc, tid, heads[i - 1][0]) for i, (_, doc, tid) in enumerate(heads)]
    extra = spark.createDataFrame(before, "__head long, __tid long, __before int")
    on = (F.col("doc_id") == F.col("__head")) & (F.col("tid") == F.col("__tid"))
    marked = dealt.join(F.broadcast(extra), on, "left")  # as many rows as ranges
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("h"))
    places = F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("__before").alias("b"), F.lit(True).alias("h"))))
    spread = marked.select("doc_id", "tid", "text", F.explode(places).alias("__at")).select(F.col("__at.b").alias("__bucket"), F.col("__at.h").alias("__halo"), "doc_id", "tid", "text")
    return spread.repartitionById(len(bounds) + 1, "__bucket").sortWithinPartitions("__bucket", "__halo", "doc_id", "tid", "text")


def _follow(batches):
    """(doc_id, text, next text) of sorted neighbours() rows; one row is held back until its follower comes."""
    held, closed = None, False
    for batch in slices(batches):
        for halo, doc, _, text in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if halo and closed:
                continue  # more rows equal to the next range's first one
            if held is not None:
                yield (*held, text)
            held, closed = (None, True) if halo else ((None if doc == NULL_ID else doc, text), False)


def _rows(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    size = 0
    last: tuple = (None, None, None)  # the last text, its hashes and keys: the next document's come first here

    def of(text: str):
        hashes = anchors(text)[1]
        return hashes, numbered(hashes)

    for doc, text, following in _follow(batches):
        own, keys = last[1:] if last[0] == text else of(text)
        after, after_keys = of(following)
        last = (following, after, after_keys)
        new = edited(text, following)
        its, its_keys = of(new)
        (near, m), (far, _) = likeness(keys, its_keys), likeness(keys, after_keys)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc, len(text), digest, printed(own), printed(its), near, far, len(own), len(its), m))
        size += 8 * (len(own) + len(its)) + 200
        if size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how near they are (see SCHEMA).

    in_order is the number of anchors that text and edited text have in common in the same order.
    """
    return neighbours(docs).mapInArrow(_rows, SCHEMA)


def _prints(batches):
    for batch in slices(batches):
        found = [anchors(t) for t in batch.column(1).to_pylist()]
        columns = [
            batch.column(0),
            pa.array([printed(h) for _, h in found]),
            pa.array([p.tolist() for p, _ in found], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "places"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, places: every document's fingerprint and the places (code points) of its anchors."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, fingerprint string, places array<long>")
