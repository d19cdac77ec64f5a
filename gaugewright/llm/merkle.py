"""Merkle manifest of a table: digests of rows, a tree of base FANOUT for each source, one root over the sources' trees.

H is the lowercase hex SHA-256 of its inputs one after the other; digests go in as hex text.  A row's leaf is H of its
fields, each ``-`` if null, else the count of its UTF-8 bytes, ``:`` and the value.  A tree's nodes are taken FANOUT at a
time; the last run is shorter, and even a run of one is hashed again: nothing is padded.  A lone leaf is its tree's root.

Leaves are dealt by ranges of (tree, order), sorted and checkpointed.  A row of counts for each partition then says where
in its tree the partition begins.  Over each partition goes a stack of mountains: digests wait by level, and a run that is
full carries one digest to the level above, as in counting to the base FANOUT.  A run whose members all lie in the
partition is written whole; runs that the partition's edges cut are written as pieces, two a level at most.  Pieces meet by
(tree, level, run), level by level, and carry on.  So a run is one record of FANOUT digests at most, however large its tree
is, and a tree with a third of all rows is more ranges, no more.  Paths go down from the root to the runs of leaves.

Memory is linear in a single text where rows are hashed, and in FANOUT digests a level elsewhere.

Cases: null fields count as stated, an empty text as ``0:``; a null doc_id comes before all others, rows of equal doc_id
go by their leaf, and repeated rows are a leaf each; a null source is a tree of its own, before all others; an empty table
gives no rows; columns other than the five are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, crc32_sql, released, ship

FANOUT, HEX = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Records that a task hands on at a time.
BATCH = 2000


def leaf(**other: Column) -> Column:
    """H of a row's FIELDS; a keyword gives another value for one of them."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(other.get(f, F.col(f))) for f in FIELDS]), 256)


def hashed(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


class Mountains:
    """The stack over the leaves of one tree that lie in one partition, the first of them the tree's leaf ``start``.

    put(level, run, at, digests, items, whole, top) is called for each run or piece of one: its level (that of the nodes in
    it, 0 for leaves), its number in its level, its first node's place in the run.
    """

    def __init__(self, start: int, put):
        self.next, self.put = start, put
        self.waiting: list[list[str]] = [[]]
        self.first = [start]
        self.items: list = []
        #: A full run of the first nodes: it is the tree's top if no leaf follows.
        self.held: tuple | None = None

    def push(self, digest: str, item) -> None:
        self._release(False)
        self.items.append(item)
        at, level = self.next, 0
        self.next += 1
        while digest is not None:
            self._wait(level, at, digest)
            if (at + 1) % FANOUT:
                return
            digest = self._write(level)
            at, level = at // FANOUT, level + 1

    def _wait(self, level: int, at: int, digest: str) -> None:
        if level == len(self.waiting):
            self.waiting.append([])
            self.first.append(at)
        if not self.waiting[level]:
            self.first[level] = at
        self.waiting[level].append(digest)

    def _write(self, level: int, ended: bool = True, top: bool = False) -> str | None:
        """Writes what waits at a level; the run's digest if all of the run is here."""
        digests, (run, at) = "".join(self.waiting[level]), divmod(self.first[level], FANOUT)
        whole = ended and at == 0
        record = (level, run, at, digests, self.items if level == 0 else None, whole)
        if whole and run == 0 and not top:
            self.held = record
        else:
            self.put(*record, top)
        self.waiting[level] = []
        if level == 0:
            self.items = []
        return hashed(digests) if whole else None

    def _release(self, top: bool) -> None:
        if self.held:
            self.put(*self.held, top)
            self.held = None

    def close(self, ends: bool) -> None:
        """After the last leaf here; ``ends`` if it is the tree's last one."""
        self._release(ends)
        count, level, carried = self.next, 0, None
        if ends and count == 1:
            self._write(0, top=True)
            return
        while level < len(self.waiting) or carried:
            if carried:
                self._wait(level, count - 1, carried)
                carried = None
            if ends and count == 1:
                return  # the root waits here, and nothing is above it
            count = -(-count // FANOUT)
            if self.waiting[level]:
                carried = self._write(level, ends, ends and count == 1)
            level += 1


def _summary(batches):
    """For the partition's first tree and its last one, if that is another: ``place`` (its partition's number, then 0 or 1),
    the tree, its rows here."""
    trees: list[list] = []
    part = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("__at")[0].as_py() >> 33
        runs = pc.run_end_encode(batch.column("tree"))
        at = 0
        for tree, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if trees and trees[-1][0] == tree:
                trees[-1][1] += end - at
            else:
                trees = [*trees[:1], [tree, end - at]]
            at = end
    rows = [(2 * part + i, tree, n) for i, (tree, n) in enumerate(trees)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["place", "tree", "n"])


def _edges(leaves: DataFrame) -> DataFrame:
    """part, start, ends, first_total, last_total: a row for each partition, from one or two rows of counts each."""
    edge = leaves.select("__at", "tree").mapInArrow(_summary, "place long, tree string, n long")
    order = Window.orderBy("place")
    split = edge.withColumn("new", F.coalesce((F.lag("tree").over(order) != F.col("tree")).cast("int"), F.lit(1)))
    split = split.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy("island")
    inside = same.orderBy("place")
    split = split.select(
        F.shiftright("place", 1).alias("part"),
        "place",
        F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(same).alias("total"),
        F.lead("n").over(inside).isNull().alias("ends"),
    )
    return split.groupBy("part").agg(
        F.min_by("start", "place").alias("start"), F.max_by("ends", "place").alias("ends"), F.min_by("total", "place").alias("first_total"), F.max_by("total", "place").alias("last_total")
    )


def _stacked(schema: pa.Schema):
    """Runs and pieces of a partition's rows (tree, digest, item, and what _edges() says of the partition)."""

    def run(batches):
        rows: list[tuple] = []
        stack, tree, total, edge = None, None, None, None

        def put(*record):
            rows.append((tree, *record, total))

        for batch in batches:
            if not batch.num_rows:
                continue
            if edge is None:
                edge = [batch.column(c)[0].as_py() for c in ("start", "ends", "first_total", "last_total")]
            for new, digest, item in zip(batch.column("tree").to_pylist(), batch.column("digest").to_pylist(), batch.column("item").to_pylist(), strict=True):
                if stack is None or new != tree:
                    first = stack is None
                    if stack:
                        stack.close(True)
                    # A tree between the first and the last one lies here whole, as does one that begins and ends here.
                    tree, total = new, edge[2] if first else None
                    stack = Mountains(edge[0] if first else 0, put)
                stack.push(digest, item)
                if len(rows) >= BATCH:
                    yield _records(rows, schema)
                    rows.clear()
        if stack:
            total = edge[3]
            stack.close(edge[1])
        yield _records(rows, schema)

    return run


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _merged(pieces: DataFrame, levels: int) -> list[DataFrame]:
    """The runs that pieces make, a frame for each level; a run's digest is a piece of the level above."""
    out: list[DataFrame] = []
    carried = None
    for level in range(levels):
        here = pieces.where(F.col("level") == level).select("tree", "run", "at", "digests", "items", "total")
        if carried is not None:
            here = here.unionByName(carried)
        piece = F.array_sort(F.collect_list(F.struct("at", "digests", "items")))  # FANOUT pieces at most
        whole = here.groupBy("tree", "run").agg(piece.alias("pieces"), F.max("total").alias("total"))
        power = FANOUT ** (level + 1)
        whole = whole.select(
            "tree",
            F.lit(level).alias("level"),
            "run",
            F.array_join(F.col("pieces.digests"), "").alias("digests"),
            (F.flatten("pieces.items") if level == 0 else F.lit(None)).cast(pieces.schema["items"].dataType).alias("items"),
            (F.col("total") <= power).alias("top"),
            "total",
        )
        out.append(whole)
        up = whole.where("not top")
        carried = up.select(
            "tree", F.floor(F.col("run") / FANOUT).cast("long").alias("run"), (F.col("run") % FANOUT).cast("int").alias("at"),
            F.sha2("digests", 256).alias("digests"), F.lit(None).cast(pieces.schema["items"].dataType).alias("items"), "total",
        )
    return out


def runs(nodes: DataFrame, order: list) -> tuple[DataFrame, int]:
    """All whole runs of nodes(tree, digest, item, columns of ``order``): tree, level, run, digests, items, top; and the
    number of levels.

    ``tree`` is a text without nulls.  Rows that are equal in tree, order and digest must have equal items.
    """
    spark = nodes.sparkSession
    ship(spark)
    keys = ["tree", *order, "digest"]
    # The id tells equal rows apart, so that ranges can part them.
    ranged = nodes.withColumn("__id", F.monotonically_increasing_id()).repartitionByRange(*keys, "__id").sortWithinPartitions(*keys)
    leaves = checkpointed(ranged.select("tree", "digest", "item", F.monotonically_increasing_id().alias("__at")))
    edges = checkpointed(_edges(leaves))  # a row a partition
    placed = leaves.withColumn("part", F.shiftright("__at", 33)).join(F.broadcast(edges), "part").select("tree", "digest", "item", "start", "ends", "first_total", "last_total")
    kind = leaves.schema["item"].dataType.simpleString()
    schema = f"tree string, level int, run long, at int, digests string, items array<{kind}>, whole boolean, top boolean, total long"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    found = checkpointed(placed.mapInArrow(_stacked(arrow), schema))
    released(leaves)
    largest = edges.agg(F.max(F.greatest("first_total", "last_total"))).first()[0] or 0
    levels = 1
    while FANOUT**levels < largest:
        levels += 1
    whole = ["tree", "level", "run", "digests", "items", "top"]
    every = found.where("whole").select(whole)
    pieces = found.where("not whole")
    for merged in _merged(pieces, levels):
        every = every.unionByName(merged.select(whole))
    deepest = found.agg(F.max("level")).first()[0]
    kept = checkpointed(every)
    released(found)
    released(edges)
    return kept, max(levels, (deepest or 0) + 1)


def roots(every: DataFrame) -> DataFrame:
    """tree, digest: each tree's root, from its top run; a lone leaf is its tree's root itself."""
    return every.where("top").select("tree", F.when(_lone(), F.col("digests")).otherwise(F.sha2("digests", 256)).alias("digest"))


def _lone() -> Column:
    return F.col("top") & (F.col("level") == 0) & (F.length("digests") == HEX)


def _siblings(digests: Column, at: Column) -> Column:
    place = at.cast("int") * HEX
    return F.struct(F.substring(digests, F.lit(1), place).alias("left"), F.substring(digests, place + HEX + 1, F.length(digests)).alias("right"))


def paths(every: DataFrame, levels: int, tops: DataFrame) -> DataFrame:
    """item, leaf, path, more columns: a row for each leaf of runs().

    ``tops`` has (tree, path, more columns) for each tree, with the path from its root on.  A path's elements are the left
    and the right siblings of a node, the leaf's own first.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    keep = ["tree", "run", "digests", "items", "path", "lone", *more]
    found = None
    for level in reversed(range(levels)):
        here = every.where(F.col("level") == level).withColumn("lone", _lone())
        up = here.where("not top").withColumn("up", F.floor(F.col("run") / FANOUT).cast("long"))
        here = here.where("top").join(tops, "tree").select(keep)
        if found is not None:
            above = found.select("tree", F.col("run").alias("up"), F.col("digests").alias("around"), "path", *more)
            path = F.concat(F.array(_siblings(F.col("around"), F.col("run") % FANOUT)), F.col("path"))
            here = here.unionByName(up.join(above, ["tree", "up"]).withColumn("path", path).select(keep))
        found = here
    each = found.select("digests", "path", "lone", F.posexplode("items").alias("at", "item"), *more)
    own = F.substring("digests", F.col("at") * HEX + 1, F.lit(HEX))
    path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_siblings(F.col("digests"), F.col("at"))), F.col("path")))
    return each.select("item", own.alias("leaf"), path.alias("path"), *more)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame, *more: Column) -> DataFrame:
    """item, leaf, subroot, root, path: a row for each document; item holds doc_id and the columns ``more``.

    The subroots are the leaves of a tree of their own, which goes through the same steps.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # null before all others
    rows = docs.select(tree.alias("tree"), "doc_id", leaf().alias("digest"), F.struct("doc_id", *more).alias("item"))
    every, levels = runs(rows, ["doc_id"])
    subroots = roots(every).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree").alias("item"))
    upper, upper_levels = runs(subroots, ["key"])
    root = roots(upper).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    found = paths(upper, upper_levels, root)
    tops = checkpointed(found.select("item.tree", "path", F.col("leaf").alias("subroot"), "root"))  # a row for each source
    return paths(every, levels, tops)


def tampered() -> Column:
    """Which rows the check tampers with: 5 divides the CRC of their doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf's proof, and whether the row as it is
    found after some were tampered with leads to the root."""
    upper = "".join(chr(c) for c in range(65, 91))
    changed = F.when(tampered(), leaf(text=F.translate("text", upper, upper.lower())))
    found = manifest(docs, changed.alias("changed"))
    folded = found.select("item.doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("item.changed", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs {name}_n0.. (tree, i, d) and {name}_r1.. (tree, j, ds): nodes and runs of ``leaves`` (tree, i, d), level by level."""
    out = [f"{name}_n0 as (select tree, i, d from {leaves})"]
    for k in range(1, levels + 1):
        below = f"{name}_n{k - 1}"
        out.append(f"{name}_r{k} as (select tree, i // {FANOUT} j, list(d order by i) ds from {below} where tree in (select tree from {below} group by 1 having count(*) > 1) group by 1, 2)")
        out.append(f"{name}_n{k} as (select tree, j i, sha256(array_to_string(ds, '')) d from {name}_r{k})")
    tops = " union all ".join(f"select tree, any_value(d) d from {name}_n{k} group by 1 having count(*) = 1" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_top as ({tops})"])


def _path_sql(name: str, levels: int, folded: str) -> tuple[str, str, str]:
    """Joins for the runs on the way up from leaf l (tree, i); the siblings' texts; ``folded`` with them as a root."""
    joins, texts = [], []
    for k in range(1, levels + 1):
        joins.append(f"left join {name}_r{k} {name}{k} on {name}{k}.tree = l.tree and {name}{k}.j = l.i // {FANOUT**k}")
        at = f"(l.i // {FANOUT ** (k - 1)} % {FANOUT})"
        left, right = f"array_to_string({name}{k}.ds[1:{at}], '')", f"array_to_string({name}{k}.ds[{at} + 2:], '')"
        texts.append(f"coalesce({left} || {right}, '')")
        folded = f"case when {name}{k}.ds is null then {folded} else sha256({left} || {folded} || {right}) end"
    return " ".join(joins), " || ".join(texts), folded


def _framed_sql(field: str, value: str | None = None) -> str:
    value = value or f"{field}::varchar"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def sql(levels: int = 5, upper: int = 3) -> str:
    """DuckDB SQL for verify(), for trees and a tree of subroots of so many levels."""
    joins, texts, folded = _path_sql("a", levels, "coalesce(l.changed, l.d)")
    up_joins, up_texts, up_folded = _path_sql("b", upper, "l.folded")
    letters = "".join(chr(c) for c in range(65, 91))
    h = lambda text: "sha256(" + " || ".join(_framed_sql(f, text if f == "text" else None) for f in FIELDS) + ")"
    lowered = f"translate(text, '{letters}', '{letters.lower()}')"
    return f"""with d as (select doc_id, coalesce('s' || source, '') tree, {h(None)} d, case when {crc32_sql("doc_id::varchar")} % 5 = 0 then {h(lowered)} end changed from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 i from d), {_levels_sql("a", "l", levels)},
s as (select '' tree, tree name, row_number() over (order by tree) - 1 i, d from a_top), {_levels_sql("b", "s", upper)},
p as (select l.doc_id, l.d leaf, l.tree of, {texts} proof, {folded} folded from l {joins}),
q as (select p.*, s.tree, s.i, s.d subroot, b_top.d root from p join s on p.of = s.name cross join b_top)
select l.doc_id, l.leaf, l.subroot, l.root, sha256(l.proof || {up_texts}) proof_sha256, {up_folded} folded_root, {up_folded} = l.root verified from q l {up_joins}"""
