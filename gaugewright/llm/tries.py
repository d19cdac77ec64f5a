"""Prefix trie of conversations: a node for each distinct sequence of first turns, with counts and sums of its subtree.

A conversation's turns are hashed where they are read.  Its prefixes carry chained digests: each is the SHA-256 of the one
before and the turn.  Prefixes are grouped by (depth, digest); a group is a node, its smallest member owns it.  A node's
parent has all its members, so the nodes that one conversation owns are the last stretch of its path: a segment, which hangs
on a node of a smaller owner.  Sums over subtrees explode each segment, with the sum of its nodes, to all owners on its way
up, at the depth where its path leaves theirs, and add up along each owner's nodes.  A long turn-by-turn path without
branches is one segment: the rows of that are no more than there are turns, where exploding node by node would make their
square.

Turns of a block of conversations with a common beginning go through one task in order, a digest at a time; all else is
sums that combine before the shuffle, a join whose hot keys adaptive execution splits (both sides are checkpointed, so that
nothing but shuffles is below it), and ranges.  A node's list of ends is hashed from ranges of (node, conversation): lists
that a range's edges cut go on as texts of CHUNK ids and are hashed in order, one text at a time.

Cases: rows of one conversation and turn go by their digest, repeated rows are turns each; a null turn comes first; null
roles and texts are empty; rows without conv_id belong to no conversation and are left out; an empty table has no nodes;
columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, crc32_sql, released, ship, text_or_empty

#: The conversation that others begin like is a multiple of BLOCK; they take up to HEADS - 1 turns of it.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.sha256(b"").digest()
NO_ENDS = ROOT.hex()
#: Ids in one text of a list that is hashed over ranges, and rows that a task hands on at a time.
CHUNK, BATCH = 4096, 4096
PREFIXES = "conv long, depth int, digest binary, words long, last boolean"


def turn_digest() -> Column:
    """SHA-256 of role and text, each with its length."""
    framed = [F.concat(F.octet_length(text_or_empty(c)).cast("string"), F.lit(":"), text_or_empty(c)) for c in ("role", "text")]
    return F.unhex(F.sha2(F.concat(*framed), 256))


def taken(conv: int) -> int:
    """How many first turns a conversation takes from the first one of its block."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _chained(batches):
    """PREFIXES of rows (block, conv, turn, words) that come by block, its first conversation, the others, in order of turns."""
    rows: list[tuple] = []
    block, conv, heads, left, digest, depth, waiting = None, None, [], 0, ROOT, 0, None

    def step(turn: bytes, words: int) -> None:
        nonlocal digest, depth, waiting
        if waiting:
            rows.append((*waiting, False))
        digest, depth = hashlib.sha256(digest + turn).digest(), depth + 1
        waiting = (conv, depth, digest, words)

    for batch in batches:
        for new_block, new, turn, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new != conv:
                if conv is not None:
                    rows.append((*(waiting or (conv, 0, ROOT, 0)), True))
                if new_block != block:
                    block, heads = new_block, []
                conv, digest, depth, waiting = new, ROOT, 0, None
                left = taken(conv) if conv != block else 0
                for head in heads[:left]:
                    step(*head)
            if conv == block and len(heads) < HEADS - 1:
                heads.append((turn, words))
            if left:
                left -= 1
            else:
                step(turn, words)
        if len(rows) >= BATCH:
            yield _batch(rows)
            rows.clear()
    if conv is not None:
        rows.append((*(waiting or (conv, 0, ROOT, 0)), True))
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "depth": pa.int32(), "digest": pa.binary(), "words": pa.int64(), "last": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def prefixes(conversations: DataFrame) -> DataFrame:
    """PREFIXES: a row for each conversation and prefix of its rebuilt turns, the longest marked ``last``; a conversation
    without turns has the empty prefix alone."""
    ship(conversations.sparkSession)
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        (conv - conv % BLOCK).alias("block"), conv.alias("conv"), turn_digest().alias("digest"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("words"), F.col("turn").alias("turn")
    )
    order = ["block", F.col("conv") != F.col("block"), "conv", F.asc_nulls_first("turn"), "digest"]
    return turns.repartition("block").sortWithinPartitions(*order).select("block", "conv", "digest", "words").mapInArrow(_chained, PREFIXES)


LISTS = "conv long, depth int, at long, ids string, ends_sha256 string"


def _lists(batches):
    """LISTS of sorted rows (conv, depth, member): a list's digest, or its ids as texts with their first one (``at``) where
    it may go on in another range or is longer than CHUNK."""
    out: list[tuple] = []
    key, ids, whole = None, [], False

    def write(whole: bool) -> None:
        text = ",".join(map(str, ids))
        if ids:
            out.append((*key, ids[0], *((None, hashlib.sha256(text.encode()).hexdigest()) if whole else (text, None))))
        ids.clear()

    for batch in batches:
        for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (conv, depth) != key:
                write(whole)
                whole = key is not None  # the first list may have begun in the range before
                key = (conv, depth)
            ids.append(member)
            if len(ids) == CHUNK:
                whole = False
                write(False)
        if len(out) >= BATCH:
            yield _rows(out)
            out.clear()
    write(False)  # the last one may go on
    yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "depth": pa.int32(), "at": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _joined(batches):
    """Digests of lists whose texts come in order, one at a time."""
    out: list[tuple] = []
    key, hashing = None, hashlib.sha256()
    for batch in batches:
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids")), strict=True):
            if (conv, depth) != key:
                if key is not None:
                    out.append((*key, None, None, hashing.hexdigest()))
                key, hashing = (conv, depth), hashlib.sha256(text.encode())
            else:
                hashing.update(b"," + text.encode())
    if key is not None:
        out.append((*key, None, None, hashing.hexdigest()))
    yield _rows(out)


def ends(members: DataFrame) -> DataFrame:
    """conv, depth, ends_sha256: of rows (conv, depth, member) the SHA-256 of each list of members, ascending, by commas."""
    order = ["conv", "depth", "member"]
    lists = checkpointed(members.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_lists, LISTS))
    cut = lists.where("ids is not null").repartition("conv", "depth").sortWithinPartitions("conv", "depth", "at")
    return lists.where("ids is null").unionByName(cut.mapInArrow(_joined, LISTS)).select("conv", "depth", "ends_sha256")


def owners(found: DataFrame) -> DataFrame:
    """conv, depth, owner, n_convs, words, last: prefixes() (checkpointed) with their node's smallest member and number of
    members, and the root's row for each conversation."""
    own = found.where("depth > 0")
    nodes = checkpointed(own.groupBy("depth", "digest").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")))
    joined = checkpointed(own.join(nodes, ["depth", "digest"]).select("conv", "depth", "owner", "n_convs", "words", "last"))
    every = found.where("last").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).first()
    root = found.where("last").select(
        "conv", F.lit(0).alias("depth"), F.lit(every["owner"]).cast("long").alias("owner"), F.lit(every["n_convs"]).alias("n_convs"), F.lit(0).cast("long").alias("words"), (F.col("depth") == 0).alias("last")
    )
    released(nodes)
    return joined.unionByName(root)


def nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node; conv_id
    and depth name it."""
    found = checkpointed(prefixes(conversations))
    members = owners(found)
    saved = (F.col("n_convs") - 1) * F.col("words")
    # One row for each conversation and owner on its path, with the stretch of depths that the owner has of it.
    own = F.col("owner") == F.col("conv")
    path = members.groupBy("conv", "owner").agg(F.min("depth").alias("first"), F.max("depth").alias("exit"), F.sum(saved).alias("saved"))
    same = Window.partitionBy("conv")
    of_own = lambda c: F.max(F.when(own, F.col(c))).over(same)  # noqa: E731
    path = path.select("conv", "owner", "first", "exit", of_own("first").alias("top"), of_own("saved").alias("segment"))
    path = checkpointed(path.where("top is not null"))
    hangs = (F.col("exit") == F.col("top") - 1) & ~own
    hung = path.where(hangs).groupBy(F.col("owner").alias("conv"), "exit").agg(F.count(F.lit(1)).alias("n"))
    leaves = path.where(own).join(hung, ["conv", "exit"], "left").select("conv", F.col("n").isNull().cast("long").alias("leaf"))
    up = path.where(~own).join(leaves, "conv")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    rows = members.where(own).select("conv", "depth", "n_convs", saved.alias("saved"), zero.alias("leaves"), zero.alias("hung"), none.alias("parent"))
    below = up.select(F.col("owner").alias("conv"), F.col("exit").alias("depth"), none.alias("n_convs"), F.col("segment").alias("saved"), F.col("leaf").alias("leaves"), hangs.cast("long").alias("hung"), none.alias("parent"))
    above = path.where(hangs).select("conv", F.col("top").alias("depth"), none.alias("n_convs"), zero.alias("saved"), zero.alias("leaves"), zero.alias("hung"), F.col("owner").alias("parent"))
    each = rows.unionByName(below).unionByName(above).groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("n_convs", "parent")], *[F.sum(c).alias(c) for c in ("saved", "leaves", "hung")])
    down = Window.partitionBy("conv").orderBy(F.col("depth").desc())
    bottom = F.lag("depth").over(down).isNull()
    each = each.withColumns({"bottom": bottom, "leaves": F.when(bottom & (F.col("hung") == 0), F.lit(1).cast("long")).otherwise(F.col("leaves"))})
    sums = down.rowsBetween(Window.unboundedPreceding, 0)
    listed = ends(members.where("last").select(F.col("owner").alias("conv"), "depth", F.col("conv").alias("member")))
    each = each.select(
        F.col("conv"),
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + (~F.col("bottom")).cast("long")).alias("n_children"),
        F.sum("leaves").over(sums).alias("n_leaves"),
        F.sum("saved").over(sums).alias("saved_tokens"),
    )
    return each.join(listed, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )  # fmt: skip


#: DuckDB SQL for nodes(): prefixes as lists of digests, each node joined to all its ancestors.
SQL = rf"""with t as (select conv_id c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || octet_length(encode(coalesce(text, ''))) || ':' || coalesce(text, '')) d,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) w, turn from conversations where conv_id is not null),
o as (select c, d, w, row_number() over (partition by c order by turn nulls first, d) - 1 p from t),
h as (select c, {crc32_sql("c::varchar")} % {HEADS} h from (select distinct c from t)),
r as (select h.c, o.d, o.w, o.p from h join o on o.c = h.c - h.c % {BLOCK} and o.p < h.h union all select h.c, o.d, o.w, o.p + {HEADS} from h join o using (c) where o.p >= h.h),
l as (select h.c, coalesce(list(r.d order by r.p) filter (r.d is not null), []) ds, coalesce(list(r.w order by r.p) filter (r.d is not null), []) ws from h left join r using (c) group by 1),
m as (select c, unnest(range(len(ds) + 1)) n, ds, ws from l),
p as (select c, n, sha256(array_to_string(ds[1:n], '')) k, case when n > 0 then sha256(array_to_string(ds[1:n - 1], '')) end up, case when n > 0 then ws[n] else 0 end w, n = len(ds) ends from m),
g as (select n, k, any_value(up) up, min(c) c, count(*) convs, any_value(w) w, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) ends from p group by 1, 2),
a as (select distinct x.k node, x.n, y.k top, y.n top_n from p x join p y on x.c = y.c and y.n <= x.n),
kids as (select up k, n - 1 n, count(*) kids from g where n > 0 group by 1, 2),
s as (select a.top k, a.top_n n, sum((g.convs - 1) * g.w) saved, count(*) filter (kids.kids is null) leaves from a join g on g.k = a.node and g.n = a.n left join kids on kids.k = g.k and kids.n = g.n group by 1, 2)
select g.c conv_id, g.n::bigint depth, q.c parent_conv_id, g.convs n_convs, coalesce(kids.kids, 0) n_children, s.leaves n_leaves, s.saved::bigint saved_tokens, g.ends ends_sha256
from g join s using (k, n) left join kids on kids.k = g.k and kids.n = g.n left join g q on q.k = g.up and q.n = g.n - 1"""
