"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each document's shingles give HASHES MinHash values and BANDS bucket numbers of ROWS values each; documents with the
   same shingle set are one class, with its least doc_id for it.
2. Classes that share a bucket are candidates, in the first bucket they share only.
3. MinHash values (their low 8 bits, which are kept) of a candidate are compared STEP by STEP; it is dropped once the posterior probability that its
   Jaccard likeness reaches the threshold (binomial matches, uniform prior) is below TOLERANCE.
4. What is left is verified exactly on the whole texts' shingle sets.

Buckets of up to SMALL classes write out their surviving pairs, which are then joined with the texts.  Larger buckets are
dealt as tiles: two blocks of a bucket that meet in a task of their own, first without texts.  Pruning leaves the classes
that have a surviving pair in the tile, in the first bucket that the pair shares; these alone meet again with their texts
(a group of copies shares most of its buckets, but its pairs are left in one of them).  There verification ends in one row
for each class: its number of links in the tile and one class it is connected to.  So a hot bucket is neither gathered in
one place nor written out as pairs, and no link is lost.

A pair at the threshold shares no bucket with a chance of (1 - 0.8**5)**30, under 7e-6, and is dropped wrongly with one
under TOLERANCE a step.  Links make classes (connected components), named by their least doc_id; n_links counts, for each
document, the different shingle sets at the threshold or above.

Cases: null text counts as empty; texts without words are alike only if equal; a null doc_id comes out as null and
counts as the least; repeated rows are copies of one another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, ship, slices, text_or_empty
from .shingles import WIDTH, jaccard, mix, shingles

THRESHOLD = 0.8
ROWS, BANDS = 5, 30
HASHES = ROWS * BANDS
STEP, TOLERANCE = 15, 1e-6
SMALL = 64
#: A block of a large bucket has about so many classes and shingles at most.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
NULL_ID = -(1 << 63)

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
FEATURES = "doc_id long, tid binary, key binary, n long, sig binary, buckets array<long>"


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 512):
        spread = (hashes[at : at + 512, None] * _FACTORS[None, :]) >> np.uint64(32)
        least = np.minimum(least, spread.min(axis=0).astype(np.uint32))
    return least


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Matches needed after STEP, 2 STEP, ... values for the posterior P(J >= threshold) to be at least the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail is that of a binomial with n + 1 trials.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sigs are left after the last comparison."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for i, want in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (sigs[a[left], part] == sigs[b[left], part]).sum(axis=1)
        keep = matches >= want
        left, matches = left[keep], matches[keep]
        if not len(left):
            break
    return left


def _features(width: int):
    def run(batches):
        salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(977))
        for batch in slices(batches):
            keys, counts, sigs, buckets = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                counts.append(len(s))
                if len(s):
                    values = signature(s)
                    out = salt.copy()
                    for i in range(ROWS):
                        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + values.reshape(BANDS, ROWS)[:, i])
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                    buckets.append(out.astype(np.int64))
                else:
                    keys.append(hashlib.blake2b(b"text" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    sigs.append(b"")
                    buckets.append(np.zeros(0, np.int64))
            arrays = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tid", "key", "n", "sig", "buckets"])

    return run


def _groups(batches, width: int):
    """Lists of rows with the same first ``width`` columns, from sorted batches."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _surviving(bucket: int, numbers: np.ndarray, n: np.ndarray, sigs: np.ndarray, one: np.ndarray, other: np.ndarray | None, threshold: float, least: list[int]):
    """Pairs of rows (one x other, or one with itself) that survive pruning and share no bucket before this one."""
    found_a, found_b = [], []
    band = int((numbers == bucket).sum(axis=0).argmax())
    for at in range(0, len(one), 64):
        part = one[at : at + 64]
        against = one if other is None else other
        a, b = np.repeat(part, len(against)), np.tile(against, len(part))
        if other is None:
            a, b = a[a < b], b[a < b]
        fit = np.minimum(n[a], n[b]) / np.maximum(n[a], n[b]) >= threshold  # sizes alone bound the likeness
        a, b = a[fit], b[fit]
        for earlier in range(band):  # pairs that meet in a bucket before this one are compared there alone
            new = numbers[a, earlier] != numbers[b, earlier]
            a, b = a[new], b[new]
        left = survivors(sigs, a, b, least)
        found_a.append(a[left])
        found_b.append(b[left])
    return np.concatenate(found_a), np.concatenate(found_b)


def _arrays(group: list, at: int):
    """ids, keys, numbers, sizes, sigs of a group's rows, whose columns doc_id, tid, key, n, sig, buckets begin at ``at``."""
    docs, tids, keys, sizes, sigs, lists = zip(*(r[at : at + 6] for r in group), strict=True)
    return list(zip(docs, tids, strict=True)), keys, np.array(lists, dtype=np.int64), np.array(sizes), np.frombuffer(b"".join(sigs), np.uint8).reshape(len(keys), HASHES)


def _pairs(threshold: float):
    """(bucket, doc_id, tid, key, n, sig, buckets) sorted by bucket -> surviving (a, tid_a, b, tid_b, key_a, key_b), key_a < key_b."""

    def run(batches):
        least = needed(threshold)
        out: list[tuple] = []
        for group in _groups(batches, 1):
            ids, keys, numbers, n, sigs = _arrays(group, 1)
            a, b = _surviving(group[0][0], numbers, n, sigs, np.arange(len(ids)), None, threshold, least)
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                i, j = (i, j) if keys[i] < keys[j] else (j, i)
                out.append((*ids[i], *ids[j], keys[i], keys[j]))
            if len(out) >= 20_000:
                yield _pair_batch(out)
                out = []
        if out:
            yield _pair_batch(out)

    return run


def common_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (a, b) of sets.

    Many pairs go through products of the sets' incidence matrix, a slice of shingles at a time; shingles of one set only
    are left out.
    """
    if len(a) <= 4 * len(sets):
        return np.array([len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j])) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    rows, column = rows[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24 are exact
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


TILE = "bucket long, i int, j int, block int, doc_id long, tid binary, key binary, n long, sig binary, buckets array<long>"
_TILE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _tile_pairs(group: list, threshold: float, least: list[int]):
    """Keys, sizes, and surviving pairs of a tile's rows (TILE, and a text at times)."""
    _, keys, numbers, n, sigs = _arrays(group, 4)
    bucket, i, j = group[0][:3]
    if i == j:
        return keys, n, *_surviving(bucket, numbers, n, sigs, np.arange(len(keys)), None, threshold, least)
    block = np.array([r[3] for r in group])
    return keys, n, *_surviving(bucket, numbers, n, sigs, np.flatnonzero(block == i), np.flatnonzero(block == j), threshold, least)


def _needed(threshold: float):
    """TILE rows sorted by tile -> those that have a surviving pair there."""

    def run(batches):
        least = needed(threshold)
        for group in _groups(slices(batches), 3):
            _, _, a, b = _tile_pairs(group, threshold, least)
            rows = [group[u] for u in np.unique(np.concatenate((a, b))).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _TILE_KINDS, strict=True)], names=[c.split()[0] for c in TILE.split(", ")])

    return run


def _tiles(threshold: float, width: int):
    """TILE rows with their text, sorted by tile -> (key, root, links)."""

    def run(batches):
        least = needed(threshold)
        for group in _groups(slices(batches), 3):
            keys, n, a, b = _tile_pairs(group, threshold, least)
            if not len(a):
                continue
            used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            a, b = place[: len(a)], place[len(a) :]
            sets = [shingles(group[u][10], width) for u in used.tolist()]
            sizes = n[used]
            common = common_counts(sets, a, b)
            linked = common / (sizes[a] + sizes[b] - common) >= threshold
            a, b = a[linked], b[linked]
            links = np.bincount(np.concatenate((a, b)), minlength=len(used))
            root = np.arange(len(used))
            while True:  # the least place in each connected part
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            rows = [(keys[used[k]], keys[used[root[k]]], int(links[k])) for k in np.flatnonzero(links).tolist()]
            if rows:
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "root", "links"])

    return run


def _pair_batch(rows: list[tuple]):
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["a", "tid_a", "b", "tid_b", "key_a", "key_b"])


def _verify(threshold: float, width: int):
    """(key_a, key_b, text_a, text_b) -> (key_a, key_b) of those that reach the threshold."""

    def run(batches):
        known = lru_cache(64)(lambda text: shingles(text, width))
        for batch in slices(batches):
            rows = []
            for key_a, key_b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if jaccard(known(text_a), known(text_b)) >= threshold:
                    rows.append((key_a, key_b))
            if rows:
                arrays = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key_a", "key_b"])

    return run


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def _tid():
    return F.unhex(F.md5(text_or_empty()))


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, tid (the text's MD5), text: doc_id alone names no text, as it may be null or repeated."""
    return docs.select(_id().alias("doc_id"), _tid().alias("tid"), text_or_empty().alias("text"))


def features(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    ship(docs.sparkSession)
    return _prepared(docs).mapInArrow(_features(width), FEATURES)


def classes(found: DataFrame) -> DataFrame:
    """A row for each shingle set: key, doc_id (its least), tid, n, sig, buckets.  Copies meet after partial aggregation only."""
    least = F.min_by(F.struct("doc_id", "tid", "n", "sig", "buckets"), F.struct("doc_id", "tid"))
    return found.groupBy("key").agg(least.alias("r")).select("key", "r.*")


def members(sets: DataFrame) -> DataFrame:
    """bucket, m, size (classes and shingles in the bucket), doc_id, tid, key, n, sig, buckets: classes of shared buckets.

    Bucket rows are two or three numbers.  A class is numbered by a hash
    of its key, whatever its doc_id.  Should two classes have the same number, they come up in each other's buckets, where
    pairs are verified like all others.
    """
    rows = sets.where("n > 0").withColumn("number", F.xxhash64("key"))
    placed = rows.select("number", F.col("n").cast("int").alias("n"), F.explode("buckets").alias("bucket"))
    # Counts are combined before their shuffle, and the join's own shuffle may be split where a bucket is very large.
    shared = placed.groupBy("bucket").agg(F.count("number").cast("int").alias("m"), F.sum("n").alias("size")).where("m > 1")
    there = placed.drop("n").join(shared, "bucket")
    return there.join(rows, "number").select("bucket", "m", "size", "doc_id", "tid", "key", "n", "sig", "buckets")


def links(docs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """key, root, links: parts of the verified links of each shingle set, and for each part one set it is connected to."""
    texts = _prepared(docs).dropDuplicates(["doc_id", "tid"])  # one text for each class, however often its row is repeated
    found = members(sets)
    columns = ["doc_id", "tid", "key", "n", "sig", "buckets"]
    small = found.where(F.col("m") <= SMALL).select("bucket", *columns).repartition("bucket").sortWithinPartitions("bucket")
    pairs = small.mapInArrow(_pairs(threshold), "a long, tid_a binary, b long, tid_b binary, key_a binary, key_b binary")
    one = texts.select(F.col("doc_id").alias("a"), F.col("tid").alias("tid_a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("tid").alias("tid_b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, ["a", "tid_a"]).join(other, ["b", "tid_b"]).select("key_a", "key_b", "text_a", "text_b")
    verified = joined.mapInArrow(_verify(threshold, width), "key_a binary, key_b binary").dropDuplicates(["key_a", "key_b"])
    both = F.array(F.struct(F.col("key_a").alias("key"), F.col("key_b").alias("root")), F.struct(F.col("key_b").alias("key"), F.col("key_a").alias("root")))
    few = verified.select(F.explode(both).alias("e")).select("e.key", "e.root", F.lit(1).cast("long").alias("links"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    large = found.where(F.col("m") > SMALL).withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    tiled = large.withColumn("tile", F.explode(tiles)).select("bucket", "tile.i", "tile.j", "block", *columns)
    deal = lambda rows: rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    left = deal(tiled).mapInArrow(_needed(threshold), TILE)
    dealt = deal(left.join(texts, ["doc_id", "tid"]).select("bucket", "i", "j", "block", *columns, "text"))
    return few.unionByName(dealt.mapInArrow(_tiles(threshold, width), "key binary, root binary, links long"))


def components(edges: DataFrame, least: DataFrame) -> DataFrame:
    """key, class_id, class_key of each key that has an edge.  edges: a, b (keys); least: key, doc_id.

    Labels are (doc_id, key), as keys may share a doc_id.  They start as a key's own and fall to the least among
    neighbours; every second step follows each label to its own label (a shortcut over long chains).  Each step is
    checkpointed and the one before it removed; the loop ends when no label changes.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    nodes = both.select(F.col("a").alias("key")).distinct()
    held = labels = checkpointed(nodes.join(least, "key").select("key", F.struct("doc_id", "key").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.key == heard.a, "left").select("key", F.least("label", "heard").alias("near"), "label")
        jump = step.select(F.col("key").alias("__own"), F.col("near").alias("far"))
        step = step.join(jump, F.col("near.key") == F.col("__own"), "left").select("key", F.least("near", "far").alias("new"), "label")
        step = checkpointed(step)
        changed = step.where("new < label").limit(1).count()
        released(held)
        held = step
        labels = step.select("key", F.col("new").alias("label"))
        if not changed:
            released(both)
            return labels.select("key", F.col("label.doc_id").alias("class_id"), F.col("label.key").alias("class_key"))


def _named(docs: DataFrame, threshold: float, width: int):
    """Features of all rows, parts of links, shingle sets (key, doc_id, n_copies), and classes of those with a link."""
    found = checkpointed(features(docs, width))
    linked = checkpointed(links(docs, classes(found), threshold, width))
    edges = linked.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
    sets = found.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return found, linked, sets, components(edges, sets.select("key", "doc_id"))


def distinct(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of each class of near copies: of its rows with the least doc_id (null is the least) and text one row.

    Classes and rows are told apart by their texts, so other texts with a doc_id of a copy are classes of their own.
    """
    found, _, _, named = _named(docs, threshold, width)
    least = found.groupBy("key").agg(F.min(F.struct("doc_id", "tid")).alias("r"))
    kept = least.join(named.where("key <> class_key"), "key", "left_anti").select(F.col("r.doc_id").alias("__id"), F.col("r.tid").alias("__tid"))
    # Rows of one doc_id and text may differ in other columns: the one with the least hash, whatever their order.
    columns = [F.col(f"`{c}`") for c in docs.columns]  # a dot in a name is part of it
    rows = docs.groupBy(_id().alias("__id"), _tid().alias("__tid")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return rows.join(kept, ["__id", "__tid"], "left_semi").select("__row.*")


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id, n_copies (rows with its shingle set), n_links: a row for each document."""
    found, linked, sets, named = _named(docs, threshold, width)
    degree = linked.groupBy("key").agg(F.sum("links").alias("n_links"))
    about = sets.join(named, "key", "left").join(degree, "key", "left")
    about = about.select("key", F.coalesce("class_id", "doc_id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    # Checkpointed, the join has shuffles alone below it, and adaptive execution can split a set with very many copies.
    out = found.select("doc_id", "key").join(checkpointed(about), "key")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(back("doc_id"), back("class_id"), "n_copies", "n_links")


#: DuckDB SQL for join() over documents: an inverted index of shingles, and reachability for the classes.
SQL = """
with recursive w as (select doc_id, coalesce(text, '') t, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') w from documents),
s as (select doc_id, t, case when len(w) > 0 then list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) end s from w),
k as (select doc_id, s, case when s is null then 'text:' || md5(t) else md5(array_to_string(s, '|')) end k from s),
c as (select k, min(doc_id) d, count(*) n_copies, any_value(len(s)) n, any_value(s) s from k group by k),
x as (select k, unnest(s) g from c where s is not null),
p as (select a.k ka, b.k kb, count(*) m from x a join x b using (g) where a.k < b.k group by 1, 2),
e as (select ka, kb from p join c a on a.k = ka join c b on b.k = kb where m::double / (a.n + b.n - m) >= 0.8::double),
pairs as (select ka a, kb b from e union all select kb, ka from e),
r(k, d) as (select k, d from c union select pairs.b, r.d from r join pairs on pairs.a = r.k),
l as (select k, min(d) class_id from r group by k), g as (select a k, count(*) n from pairs group by a)
select k.doc_id, l.class_id, c.n_copies, coalesce(g.n, 0) n_links from k join c on c.k = k.k join l on l.k = k.k left join g on g.k = k.k
"""
